"""What a search by block bounds shuffles and writes: no lists a block and item, no postings of common terms."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import ranked, search
from tessera.sources.tables import table

DATA = "/root/testdata/sf0.01"


def test_an_item_and_block_are_one_number(spark, monkeypatch):
    """Nothing that grows with items and blocks has lists of terms, and sums alone are shuffled for it."""
    kept, real = {}, ranked.written

    def written(df, label):
        kept[label] = (df, real(df, label))
        return kept[label][1]

    monkeypatch.setattr(ranked, "written", written)
    docs, items = table(spark, DATA, "documents").select("doc_id", "text"), table(spark, DATA, "benchmark")
    assert ranked.tfidf_search(docs, items).count() == 5 * items.count()
    plan, bounds = kept["bounds"][0]._jdf.queryExecution().executedPlan().toString(), kept["bounds"][1]
    assert [kind for _, kind in bounds.dtypes if kind not in ("bigint", "int", "double")] == []
    assert plan.count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("common", [1, 4, 1000])
def test_norms_of_common_and_rare_terms(spark, monkeypatch, common):
    monkeypatch.setattr(ranked, "COMMON", common)
    docs = table(spark, DATA, "documents").select("doc_id", "text")
    index = search.inverted_index(docs).cache()
    idf = search.idf_table(index, docs).cache()
    got = {r["doc_id"]: (r["norm"], r["doc_terms"]) for r in ranked._norms(index, idf).collect()}
    w = F.col("tf") * F.col("idf")
    want = index.join(idf, "term").groupBy("doc_id").agg(F.sqrt(F.sum(w * w)).alias("norm"), F.count("*").alias("n")).collect()
    assert {r["doc_id"]: (pytest.approx(r["norm"]), r["n"]) for r in want} == got
