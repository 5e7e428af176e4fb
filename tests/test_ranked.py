"""Block bounds, gram filters and row numbers against doing all of the work."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.functions.text import kgrams
from tessera.operators import ranked, retrieval, search
from tessera.operators.numbering import numbered
from tessera.plans import catalogue
from tessera.sources.tables import table

DATA = "/root/testdata/sf0.01"


def asked_and_blocks(spark, size=ranked.BLOCK):
    docs, items = table(spark, DATA, "documents").select("doc_id", "text"), table(spark, DATA, "benchmark")
    index = search.inverted_index(docs).cache()
    idf = search.idf_table(index, docs)
    asked = ranked.query_terms(items, idf)
    return asked, ranked.block_index(index, idf, asked.select("term", "idf").distinct(), size=size)


def test_few_documents_are_scored(spark):
    """Rows before the top k: a fraction of the items x documents that share a term."""
    asked, blocks = asked_and_blocks(spark)
    held = ranked.bounded(asked, blocks).cache()
    found = ranked.candidates(held, blocks, 5).count()
    every = asked.join(blocks.postings, "term").select("item_id", "doc_id").distinct().count()
    assert 5 * asked.select("item_id").distinct().count() <= found < 0.25 * every


def test_bounds_hold(spark):
    asked, blocks = asked_and_blocks(spark, size=16)
    held = ranked.bounded(asked, blocks)
    dots = asked.join(blocks.postings, "term").groupBy("item_id", "block", "doc_id").agg(F.sum(F.col("qw") * F.col("w") / F.col("norm") / F.col("qnorm")).alias("score"))
    assert dots.join(held, ["item_id", "block"]).filter(F.col("score") > F.col("most") + 1e-9).count() == 0
    assert dots.join(held, ["item_id", "block"], "left_anti").count() == 0


@pytest.mark.parametrize("options", [{}, {"size": 3, "probes": 1}, {"least_idf": 2.0, "least_jaccard": 0.05, "size": 2}, {"k": 60}])
def test_same_as_scoring_everything(spark, options):
    docs, items = table(spark, DATA, "documents").select("doc_id", "text"), table(spark, DATA, "benchmark")
    plain = {k: v for k, v in options.items() if k not in ("size", "probes")}
    got, want = ([tuple(r) for r in f(docs, items, **o).collect()] for f, o in ((ranked.tfidf_search, options), (search.tfidf_search, plain)))
    assert sorted(got) == sorted(want)


def test_empty_documents_and_queries(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None), (3, "")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "b zz"), (2, None), (3, "nothing here")], "item_id long, text string")
    assert [(r["item_id"], r["doc_id"]) for r in ranked.tfidf_search(docs, items).collect()] == [(1, 1)]
    assert ranked.tfidf_search(docs.limit(0), items).count() == 0 and ranked.tfidf_search(docs, items.limit(0)).count() == 0


def test_rare_grams_lose_no_pair(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abç ") for _ in range(rng.randrange(0, 12)))
    terms = sorted({word() for _ in range(250)} | {word().upper() for _ in range(30)})
    asked = sorted({word() for _ in range(120)} | {t.lower()[1:] for t in terms[:60]})
    v = spark.createDataFrame([(t,) for t in terms], "term string")
    q = spark.createDataFrame([(t,) for t in asked], "query string")
    got = {tuple(r) for r in retrieval.near_pairs(q, v).collect()}
    full = retrieval.kgram_candidates(q, retrieval.kgram_index(v)).withColumn("distance", F.levenshtein("query", F.lower("term"), 2)).filter("distance >= 0")
    assert got == {tuple(r) for r in full.select("query", "term", "overlap", "distance").collect()} and len(got) > 100


def test_frequent_grams_are_not_joined(spark):
    """Names that all begin alike: the shared beginning joins nothing."""
    names = spark.range(400).select(F.concat(F.lit("abcd"), F.lpad(F.hex(F.xxhash64("id")), 16, "0")).alias("term"))
    counts = names.select(F.explode(kgrams(F.col("term"))).alias("gram")).groupBy("gram").agg(F.count("*").alias("terms"))
    rare = retrieval.rare_grams(names, "term", counts, 3, 2)
    assert rare.filter("gram in ('$ab', 'abc', 'bcd')").count() == 0 and rare.count() == 400 * 7


def test_sound_ranks_depend_on_the_code(spark):
    v = spark.createDataFrame([(i, t) for i, t in enumerate(["robert", "rupert", "rubard", "rabart", "ribert", "rebert", "zoo"])], "ord int, term string")
    got = retrieval.sound_matches(spark.createDataFrame([("robart",), ("rapert",), ("zu",)], "query string"), v).collect()
    assert sorted((r["query"], r["term"], r["rank"]) for r in got) == sorted([(q, t, i + 1) for q in ("robart", "rapert") for i, t in enumerate(["robert", "rupert", "rubard", "rabart", "ribert"])] + [("zu", "zoo", 1)])


def test_numbers_of_hashed_keys(spark):
    """Keys all over 64 bits and one hot key: numbers have no gap and follow the keys."""
    df = spark.range(5000).select(F.when(F.col("id") < 1500, F.lit(7)).otherwise(F.xxhash64("id")).alias("key"), "id").repartition(6)
    rows = sorted((r["no"], r["key"]) for r in numbered(df, ["key"], "no").collect())
    assert [n for n, _ in rows] == list(range(1, 5001)) and [k for _, k in rows] == sorted(k for _, k in rows)
    assert numbered(df.limit(0), ["key"], "no").count() == 0


def test_alerts_are_still_in_order(spark):
    rows = catalogue.queries()["alert_queue"](spark, "/root/testdata/sf0.001").orderBy("alert_id").collect()
    assert [r["alert_id"] for r in rows] == [f"ALT_{i + 1:04d}" for i in range(len(rows))]
