"""Names: grams, phonetic codes, cascade, wildcards, and the thirty golden queries."""

import pytest
from pyspark.sql import functions as F

from tessera.functions.text import kgrams, sound_code
from tessera.operators import metrics, retrieval
from tessera.sources import tables

GOLDEN = """Q001,toluene,exact,toluene
Q002,acetone,exact,acetone
Q003,sodium hydroxide,exact,sodium hydroxide
Q004,hydrochloric acid,exact,hydrochloric acid
Q005,ethanol,exact,ethanol
Q006,ammonia,exact,ammonia
Q007,hydrogen peroxide,exact,hydrogen peroxide
Q008,xylene,exact,xylene
Q009,ferric chloride,exact,ferric chloride
Q010,potassium permanganate,exact,potassium permanganate
Q011,tolune,misspelled,toluene
Q012,acetne,misspelled,acetone
Q013,sodum hydroxide,misspelled,sodium hydroxide
Q014,hydrocloric acid,misspelled,hydrochloric acid
Q015,ethnol,misspelled,ethanol
Q016,amonia,misspelled,ammonia
Q017,hydrogen peroxde,misspelled,hydrogen peroxide
Q018,xylen,misspelled,xylene
Q019,feric chloride,misspelled,ferric chloride
Q020,potasium permanganate,misspelled,potassium permanganate
Q021,*chlorate,wildcard,sodium chlorate
Q022,*chloride,wildcard,ferric chloride
Q023,*ol,wildcard,ethanol; methanol; isopropyl alcohol
Q024,sodium *,wildcard,sodium hydroxide; sodium chlorate; sodium hypochlorite
Q025,*acid,wildcard,hydrochloric acid; sulfuric acid; nitric acid
Q026,hydro*,wildcard,hydrochloric acid; hydrogen peroxide; sodium hydroxide
Q027,*peroxide,wildcard,hydrogen peroxide
Q028,*ate,wildcard,sodium chlorate; potassium permanganate; ethyl acetate
Q029,per*,wildcard,hydrogen peroxide; potassium permanganate
Q030,*ane,wildcard,
"""


def one(spark, c, value):
    return spark.createDataFrame([(value,)], "t string").select(c(F.col("t")).alias("x")).first()["x"]


def ask(spark, *texts):
    rows = retrieval.resolve(spark.createDataFrame([(t,) for t in texts], "query string"), tables.vocabulary(spark)).orderBy("query", "rank").collect()
    return [(r["query"], r["term"], r["stage"], r["distance"]) for r in rows]


def test_grams(spark):
    assert {"$to", "ne$"} <= set(one(spark, kgrams, "toluene"))
    assert set(one(spark, kgrams, "ol")) == {"$ol", "ol$"}
    assert one(spark, kgrams, "") == ["$$"]


@pytest.mark.parametrize("text,code", [("", "0000"), ("123", "0000"), ("ashcraft", "A226"), ("1-butanol", "B354"), ("ksylene", "K450"), ("xylene", "X450")])
def test_sound_codes(spark, text, code):
    assert one(spark, sound_code, text) == code


def test_cascade(spark):
    assert ask(spark, "tolune") == [("tolune", "toluene", "edit_distance", 1)]
    assert ("tolueen", "toluene", "edit_distance", 2) in ask(spark, "tolueen")
    assert ask(spark, "  TOLUENE  ") == [("  TOLUENE  ", "toluene", "exact", 0)]
    assert ask(spark, "zzzqqqxxx") == []
    assert ask(spark, "taeoleuieeanee") == [("taeoleuieeanee", "toluene", "soundex", None)]


def wild(spark, pattern):
    found = retrieval.wildcard_matches(spark.createDataFrame([(pattern,)], "pattern string"), tables.vocabulary(spark))
    return {r["term"] for r in found.collect()}


@pytest.mark.parametrize("pattern", ["toluene", "*chlor*ate", "hy*ide", "*", ""])
def test_malformed_wildcards_match_nothing(spark, pattern):
    assert wild(spark, pattern) == set()


def test_golden_set(spark, tmp_path):
    path = tmp_path / "queries.csv"
    path.write_text("query_id,query_text,category,expected_chemicals,notes\n" + "".join(line + ",\n" for line in GOLDEN.strip().split("\n")))
    q = tables.read_query_set(spark, str(path), ["exact", "misspelled", "wildcard"])
    assert q.count() == 30
    v = tables.vocabulary(spark)
    names = q.filter("category <> 'wildcard'")
    top = retrieval.resolve(names.select(F.col("query_text").alias("query")), v).filter("rank = 1").select(F.col("query").alias("query_text"), "term")
    wilds = retrieval.wildcard_matches(q.filter("category = 'wildcard'").select(F.col("query_text").alias("pattern")), v).select(F.col("pattern").alias("query_text"), "term")
    found = top.union(wilds).groupBy("query_text").agg(F.collect_set("term").alias("found"))
    from tessera.functions.text import term_set

    empty = F.array().cast("array<string>")
    rows = q.join(found, "query_text", "left").select("category", F.coalesce("found", empty).alias("predicted"), term_set(F.col("expected_chemicals")).alias("expected"))
    report = metrics.evaluate_sets(rows)
    assert all((r["pass_rate"], r["precision"], r["recall"], r["f1"]) == (1.0,) * 4 for r in report.collect())
    text = tables.write_report(report, str(tmp_path / "report.md"))
    assert text.count("100%") == 3


def test_prefix_with_space(spark):
    """``sodium *`` asks for tokens that begin with ``sodium``."""
    assert wild(spark, "sodium *") == {"sodium hydroxide", "sodium chlorate", "sodium hypochlorite"}
