"""Sources, sinks and streams that no query covers."""

import pytest
from pyspark.sql import functions as F

from tessera.functions.text import query_id
from tessera.operators import mining, retrieval, severity
from tessera.sources import shared, tables
from tessera.streaming import monitor


def test_appended_rows_add_up(spark, tmp_path):
    path = str(tmp_path / "alerts")
    for zone in ("Z1", "Z2"):
        tables.append_rows(spark.createDataFrame([(zone, "PENDING")], "zone_id string, status string"), path)
    assert {r["zone_id"] for r in spark.read.parquet(path).collect()} == {"Z1", "Z2"}


def test_catalog_columns(spark):
    spark.createDataFrame([(1, "a")], "x long, y string").createOrReplaceTempView("seen_columns")
    assert tables.catalog_columns(spark)["seen_columns"] == ["x", "y"]
    spark.catalog.dropTempView("seen_columns")


def test_jdbc_needs_a_driver(spark):
    """The reader passes its options on: without a driver for the address Spark says so."""
    with pytest.raises(Exception, match="(?i)driver"):
        tables.read_jdbc(spark, "jdbc:nothing://host/db", "readings", user="u").count()


def test_simulated_readings_are_valid(spark):
    stream = monitor.simulated(spark, rows_per_second=200)
    assert stream.isStreaming
    query = stream.writeStream.format("memory").queryName("simulated").start()
    try:
        for _ in range(60):
            query.processAllAvailable()
            rows = spark.table("simulated")
            if rows.count() > 20:
                break
        good, bad = tables.validated(rows)
        assert good.count() > 20 and bad.count() == 0
    finally:
        query.stop()


def test_optional_fields_may_be_missing(spark, tmp_path):
    path = tmp_path / "r.json"
    path.write_text('{"zone_id": "Z1", "temperature_celsius": 20.5, "humidity_percent": 40.0}\n{"zone_id": "Z2", "humidity_percent": 10.0}\n')
    rows = spark.read.schema(tables.READING).json(str(path))
    good, bad = tables.validated(rows)
    assert [(r["zone_id"], r["gas_ppm"]) for r in good.collect()] == [("Z1", None)] and [r["zone_id"] for r in bad.collect()] == ["Z2"]


def test_query_ids_are_stable(spark):
    rows = spark.createDataFrame([("toluene",), ("toluene",), ("acetone",)], "t string").select(query_id(F.col("t")).alias("q")).collect()
    assert rows[0] == rows[1] and all(0 <= r["q"] < 10000 for r in rows)


def test_severity_from_text(spark):
    rows = spark.createDataFrame([("harmless water", 0), ("water mild", 0), ("fatal poison explosive", 3), ("explosive fatal gas", 3)], "text string, label int")
    model = severity.fit_text(rows)
    from tessera.functions.text import content_terms

    got = model.transform(rows.withColumn("terms", content_terms(F.col("text")))).select("label", "prediction").collect()
    assert all(r["label"] == r["prediction"] for r in got)


def test_names_are_numbered_in_order(spark):
    names = ["b", "a", "ab", "abc", "abcd", "abce", "zz", "é", "a"]
    got = {r["term"]: r["ord"] for r in retrieval.ordered(spark.createDataFrame([(n,) for n in names], "term string")).collect()}
    assert sorted(got, key=got.get) == sorted(set(names)) and sorted(got.values()) == list(range(1, 9))


def test_report_names_every_category(spark, tmp_path):
    rows = spark.range(1500).select(F.concat(F.lit("c"), F.col("id").cast("string")).alias("category"), F.lit(1).alias("n_queries"), *[F.lit(1.0).alias(c) for c in ("pass_rate", "precision", "recall", "f1")])
    assert tables.write_report(rows, str(tmp_path / "r.md")).count("100%") == 1500


def test_rules_of_large_itemsets(spark):
    """Every split of an itemset is there once."""
    items = [chr(97 + i) for i in range(6)]
    rows = spark.createDataFrame([(items,)] * 4 + [([],)], "items array<string>")
    rules = mining.association_rules(mining.frequent_itemsets(rows, 0.5), 0.0)
    assert rules.filter(F.size("antecedents") + F.size("consequents") == 6).count() == 2 ** 6 - 2


def test_watermarked_windows_close(spark, tmp_path):
    """In append mode a window comes out once the watermark has passed its end."""
    path = str(tmp_path / "events")
    rows = [(i, f"2024-01-01 {h:02d}:10:00", 1, "click", 1.0, "{}") for i, h in enumerate((0, 0, 1, 5))]
    spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string").withColumn("ts", F.col("ts").cast("timestamp_ntz")).write.parquet(path)
    for made, first in ((monitor.window_counts, "window_start"), (monitor.session_counts, "session_start")):
        out = monitor.run_available(made(monitor.event_stream(spark, path), watermark="10 minutes"), shared.shared_dir(spark), "append")
        assert [(r[first], r["n"]) for r in out.orderBy(first).collect()][:2] == ([("2024-01-01 00:00:00", 2), ("2024-01-01 01:00:00", 1)] if first == "window_start" else [("2024-01-01 00:10:00", 2), ("2024-01-01 01:10:00", 1)])


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"
        _jsc = spark.sparkContext._jsc

    class Session:
        conf = spark.conf
        sparkContext = Context

    if spark.conf.get("spark.checkpoint.dir", None) is None and not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            shared.shared_dir(Session)
    assert shared.shared_dir(spark)
