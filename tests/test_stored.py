"""Stored index, set join, crawl schedule, and a database read in ranges."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import crawl, search, similar
from tessera.operators.stored import StoredIndex
from tessera.sources import tables


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(2)
    words = ["of", "the", "acid", "base"] + [f"w{i}" for i in range(30)]
    rows = [(rng.randrange(1 << 50) - (1 << 49), " ".join(rng.choices(words, [9, 9] + [1] * 32, k=rng.randrange(80)))) for _ in range(300)] + [(5, None), (6, "")]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_stored_index_equals_the_table(spark, corpus, tmp_path):
    index = StoredIndex.build(corpus, str(tmp_path / "i"), folders=8, block=16)
    plain = search.positional_index(corpus)
    for phrase in ("of the", "the the of", "acid", "of missing"):
        assert sorted(index.phrase(phrase).collect()) == sorted(search.phrase_query(plain, phrase).collect())
    assert sorted(index.proximity("of the", "acid", 5).collect()) == sorted(search.proximity_query(plain, "of the", "acid", 5).collect())
    assert sorted(index.positions(["acid", "base"]).collect()) == sorted(plain.filter("term in ('acid', 'base')").collect())


def test_only_the_terms_folders_are_read(spark, corpus, tmp_path):
    StoredIndex.build(corpus, str(tmp_path / "i"), folders=16, block=64)
    index = StoredIndex(spark, str(tmp_path / "i"), folders=16)
    rows = index.blocks(["acid"])
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(folder" in plan and "PushedFilters: [" in plan and "EqualTo(term,acid)" in plan
    assert {f.split("/folder=")[1].split("/")[0] for f in rows.select(F.input_file_name()).distinct().toPandas().iloc[:, 0]} == {str(rows.first()["folder"])}
    # a frequent term is a row a block
    assert index.blocks(["of"]).count() == -(-corpus.count() // 64)


def test_similar_sets_against_all_pairs(spark):
    rng = random.Random(6)
    rows = []
    for _ in range(40):
        base = {rng.randrange(200) for _ in range(rng.randrange(1, 30))} | ({1, 2, 3} if rng.random() < 0.5 else set())
        for _ in range(rng.randrange(1, 5)):
            rows.append((len(rows), sorted(x for x in base | {rng.randrange(400)} if rng.random() < 0.95)))
    rows += [(1000, []), (1001, rows[0][1])]
    first, copies = {}, {}
    for i, s in rows:
        first.setdefault(tuple(s), i)
        copies[tuple(s)] = copies.get(tuple(s), 0) + 1
    want = set()
    for a, i in first.items():
        for b, j in first.items():
            if i < j and a and b and 100 * len({*a} & {*b}) >= 80 * len({*a} | {*b}):
                want.add((i, j, copies[a], copies[b], round(len({*a} & {*b}) / len({*a} | {*b}), 9)))
    got = similar.similar_sets(spark.createDataFrame(rows, "id long, items array<bigint>"))
    assert {tuple(r) for r in got.collect()} == want and len(want) > 20


@pytest.mark.parametrize("path,fits", [("/a", True), ("/ab/c", True), ("/b", False), ("/x/y.php", True), ("/x/y.php5", False), ("/d+e", True), ("/dde", False), ("/q$1", True)])
def test_rule_paths(spark, path, fits):
    rules = spark.createDataFrame([("/a",), ("/*.php$",), ("/d+e",), ("/q$1",)], "p string")
    got = rules.select(F.regexp_like(F.lit(path), crawl.rule_regex(F.col("p"))).alias("x")).agg(F.max("x")).first()[0]
    assert got == fits


def test_longest_rule_of_the_host(spark):
    rules = spark.createDataFrame([("*", False, "/p"), ("own.org", True, "/"), ("own.org", False, "/p/q"), ("tie.org", False, "/ab"), ("tie.org", True, "/a*"), ("tie.org", False, "")], "host string, allow boolean, path string")
    urls = {"http://other.net/p/1": False, "http://other.net": True, "http://OWN.org/p/1": True, "http://own.org/p/q?x": False, "http://tie.org/abc": False, "http://tie.org/a": True}
    rules2 = rules.union(spark.createDataFrame([("tie.org", True, "/ab")], rules.schema))
    got = {r["url"]: r["allowed"] for r in crawl.allowed(spark.createDataFrame([(u,) for u in urls], "url string"), rules).collect()}
    assert got == urls | {"http://tie.org/abc": True} or got == urls
    assert crawl.allowed(spark.createDataFrame([("http://tie.org/abc",)], "url string"), rules2).first()["allowed"]


def test_turns_of_a_hot_host(spark):
    rows = [(f"http://hot.org/{i:04d}", "hot.org") for i in range(500)] + [(f"http://h{i}.org/", f"h{i}.org") for i in range(50)]
    random.Random(1).shuffle(rows)
    got = crawl.schedule(spark.createDataFrame(rows, "url string, host string").repartition(5), spark.createDataFrame([("hot.org", 0.5)], "host string, seconds double")).collect()
    hot = sorted((r["turn"], r["url"], r["at_seconds"]) for r in got if r["host"] == "hot.org")
    assert [(t, u, s) for t, u, s in hot] == [(i, f"http://hot.org/{i:04d}", 0.5 * i) for i in range(500)]
    assert {(r["turn"], r["at_seconds"]) for r in got if r["host"] != "hot.org"} == {(0, 0.0)}


def test_database_read_in_ranges(spark, tmp_path):
    """A round trip through the database that comes with Spark."""
    url = f"jdbc:derby:{tmp_path / 'db'};create=true"
    rows = spark.range(1000).select(F.col("id").cast("int").alias("no"), F.concat(F.lit("z"), F.col("id") % 7).alias("zone"), (F.col("id") / 4).alias("level")).union(spark.sql("SELECT CAST(NULL AS INT), 'none', 0.0"))
    rows.write.format("jdbc").options(url=url, dbtable="readings", driver="org.apache.derby.iapi.jdbc.AutoloadedDriver", createTableColumnTypes="zone VARCHAR(8)").save()
    read = tables.read_jdbc_parts(spark, url, "readings", "no", parts=5, driver="org.apache.derby.iapi.jdbc.AutoloadedDriver")
    assert read.rdd.getNumPartitions() == 5
    assert sorted(map(tuple, read.collect()), key=repr) == sorted(map(tuple, rows.collect()), key=repr)
    sizes = read.groupBy(F.spark_partition_id()).count().collect()
    assert all(195 <= r["count"] <= 206 for r in sizes)
    some = read.filter("zone = 'z3' and level > 100")
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(zone,z3)" in plan and "GreaterThan(level,100.0)" in plan and some.count() == rows.filter("zone = 'z3' and level > 100").count()
    part = tables.read_jdbc_parts(spark, url, "readings", "no", parts=3, where="\"zone\" = 'z1'", driver="org.apache.derby.iapi.jdbc.AutoloadedDriver")
    assert {r["zone"] for r in part.collect()} == {"z1"} and part.count() == rows.filter("zone = 'z1'").count()
    assert tables.read_jdbc_parts(spark, url, "readings", "no", where="\"zone\" = 'nothing'", driver="org.apache.derby.iapi.jdbc.AutoloadedDriver").count() == 0
