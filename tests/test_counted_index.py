"""Indexes are counted where whole documents lie: texts are shuffled, never their words."""

from tessera.operators import search
from tessera.sources.tables import table

DATA = "/root/testdata/sf0.01"


def test_words_are_not_shuffled(spark):
    docs = table(spark, DATA, "documents").select("doc_id", "text")
    index = search.counted_index(docs)
    plan = index._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.index("Generate") < plan.index("Exchange hashpartitioning")
    assert index.exceptAll(search.inverted_index(docs)).count() == 0 and index.count() == search.inverted_index(docs).count()
