"""Telemetry monitor: the same transformations for streams and for tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.operators.verdict import unsafe
from tessera.sources.committed import batch_sink

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, path: str, **options) -> DataFrame:
    """Stream over event files, event time as a timestamp fit for watermarks."""
    raw = spark.readStream.schema(EVENTS).options(**options).parquet(path)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def simulated(spark: SparkSession, rows_per_second: int = 10, zones: int = 8) -> DataFrame:
    """Endless stream of made-up readings with the columns of the real ones."""
    r = spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load()
    h = F.pmod(F.xxhash64("value"), F.lit(1000)) / 1000.0
    return r.select(F.concat(F.lit("Z"), (F.col("value") % zones).cast("string")).alias("zone_id"), (15.0 + 20.0 * h).alias("temperature_celsius"), (30.0 + 40.0 * h).alias("humidity_percent"), F.col("timestamp"), F.concat(F.lit("sim-"), (F.col("value") % zones).cast("string")).alias("device_id"))


def validation(events: DataFrame, low: float, high: float) -> DataFrame:
    """Each event with ``reason``: no_value, out_of_range, bad_props or ok, and k of its props."""
    k = F.from_json("props", "k int", {"mode": "PERMISSIVE"})["k"]
    v = F.col("value")
    reason = F.when(v.isNull() | F.isnan(v), "no_value").when(~v.between(low, high), "out_of_range").when(k.isNull(), "bad_props").otherwise("ok")
    return events.select("event_id", "user_id", "event_type", "value", k.alias("k"), reason.alias("reason"))


def rate_limited(events: DataFrame, limit: int, window: str = "1 hour") -> DataFrame:
    """(user_id, window_start, n) of devices that sent more than ``limit`` in a window."""
    n = events.groupBy("user_id", F.window(F.col("ts").cast("timestamp"), window).alias("w")).agg(F.count("*").alias("n"))
    return n.filter(F.col("n") > limit).select("user_id", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "n")


def zone_state(events: DataFrame, excursion_above: float) -> DataFrame:
    """Last event of each zone, and whether it is beyond the bound."""
    last = F.max_by(F.struct("event_id", "event_type", "value"), F.struct("ts", "event_id"))
    return events.groupBy("user_id").agg(last.alias("l"), F.count("*").alias("n_events")).select(
        "user_id", F.col("l.event_id").alias("last_event"), F.col("l.event_type").alias("last_type"), F.col("l.value").alias("last_value"), "n_events", (F.col("l.value") > excursion_above).alias("excursion"))


def excursions(events: DataFrame, limits: DataFrame) -> DataFrame:
    """Events at or beyond their metric's limit; ``limits`` has event_type, bound, direction.

    Works on streams too: the limits are a table.
    """
    j = events.join(limits, "event_type")
    return j.filter(unsafe(F.col("value"), F.col("bound"), F.col("direction"))).select("event_id", "user_id", "event_type", "value", "bound")


def zone_excursions(readings: DataFrame, inventory: DataFrame, limits: DataFrame) -> DataFrame:
    """(event_id, zone_id, chemical, metric_name, current_value, control_ceiling, control_floor).

    Readings of a zone are held against the limits of every chemical stored there;
    ``inventory`` has zone_id and chemical, ``limits`` chemical, metric_name and the bounds.
    Readings may be a stream.
    """
    j = readings.select("event_id", "zone_id", "metric_name", "current_value").join(inventory.select("zone_id", "chemical").distinct(), "zone_id").join(limits, ["chemical", "metric_name"])
    beyond = F.coalesce(F.col("current_value") >= F.col("control_ceiling"), F.lit(False)) | F.coalesce(F.col("current_value") <= F.col("control_floor"), F.lit(False))
    return j.filter(beyond).select("event_id", "zone_id", "chemical", "metric_name", "current_value", "control_ceiling", "control_floor")


def last_alerts(alerts: DataFrame, events: DataFrame) -> DataFrame:
    """(zone_id, last_alert): time of the last alert of each zone."""
    return alerts.select("event_id", "zone_id").join(events.select("event_id", "ts"), "event_id").groupBy("zone_id").agg(F.max("ts").alias("last_alert"))


def session_counts(events: DataFrame, gap: str = "30 minutes", watermark: str | None = None) -> DataFrame:
    """Events of each device's sessions, which end after ``gap`` without any."""
    e = events.withWatermark("ts", watermark) if watermark else events.withColumn("ts", F.col("ts").cast("timestamp"))
    w = F.session_window("ts", gap).alias("w")
    return e.groupBy("user_id", w).agg(F.count("*").alias("n")).select("user_id", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("session_start"), "n")


def window_counts(events: DataFrame, window: str = "1 hour", watermark: str | None = None, slide: str | None = None) -> DataFrame:
    """Counts and greatest values of each window and type; tumbling, or sliding by ``slide``."""
    e = events.withWatermark("ts", watermark) if watermark else events
    return e.groupBy(F.window("ts", window, slide).alias("w"), "event_type").agg(F.count("*").alias("n"), F.max("value").alias("max_value")).select(
        F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type", "n", "max_value")


def compliance(alerts: DataFrame) -> DataFrame:
    """Alerts of each status by zone."""
    return alerts.groupBy("zone_id", "status").agg(F.count("*").alias("n_alerts"))


def run_available(stream: DataFrame, shared: str, mode: str = "complete") -> DataFrame:
    """Run a stream over what is there now and return its result as a table.

    Every micro-batch replaces (complete) or adds to (append) a table in a shared folder;
    a batch that is run again writes the same folder again.
    """
    spark = stream.sparkSession
    base = f"{shared.rstrip('/')}/tessera-stream-{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(base)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)  # when the driver ends

    def write(batch: DataFrame, number: int) -> None:
        part = "result" if mode == "complete" else f"result/batch={number}"
        batch.write.mode("overwrite").parquet(f"{base}/{part}")

    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/result")


def as_messages(events: DataFrame) -> DataFrame:
    """Events as messages (topic, key, value, ts) on a topic for each type, by device."""
    value = F.to_json(F.struct("event_id", "user_id", "event_type", "value", "props"))
    return events.select(F.concat(F.lit("events/"), "event_type").alias("topic"), F.col("user_id").cast("string").alias("key"), value.alias("value"), F.col("ts").cast("timestamp").alias("ts"))


def clock(spark: SparkSession, ts: str) -> DataFrame:
    """One message that only says what time it is."""
    return spark.sql("SELECT 'clock' AS topic, '-1' AS key, '{\"user_id\": -1, \"event_type\": \"clock\"}' AS value, CAST(:ts AS timestamp) AS ts", args={"ts": ts})


def as_events(messages: DataFrame) -> DataFrame:
    """The events again, of a table or a stream of messages."""
    fields = "event_id long, user_id long, event_type string, value double, props string"
    return messages.select(F.from_json("value", fields).alias("v"), "ts").select("v.*", "ts")


def run_to_end(stream: DataFrame, table, checkpoint: str) -> None:
    """Run a stream over what is there now, into a table of committed batches.

    Started again with the same checkpoint it goes on where it was; a batch that Spark runs
    twice is added once.
    """
    # batches without rows run too, so that timers see the last watermark
    query = stream.writeStream.outputMode("append").foreachBatch(batch_sink(table)).option("checkpointLocation", checkpoint).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
