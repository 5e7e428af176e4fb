"""Committed batches, topic logs with replay, stateful alarms with late events."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tessera.plans import catalogue
from tessera.sources import topics
from tessera.sources.committed import CommittedTable
from tessera.streaming import monitor, stateful

ROW = "x long, y string"


def test_a_batch_counts_once(spark, tmp_path):
    t = CommittedTable(spark, str(tmp_path / "t"), ROW)
    assert t.read().count() == 0 and t.commits() == []
    a = spark.createDataFrame([(1, "a"), (2, None)], ROW)
    assert t.append(a, 0) and not t.append(a, 0) and t.append(a, 1) and t.append(a, 0, writer="other")
    assert t.read().count() == 6 and len(t.commits()) == 3


def test_rows_of_a_failed_try_are_not_read(spark, tmp_path):
    t = CommittedTable(spark, str(tmp_path / "t"), ROW)
    a = spark.createDataFrame([(1, "a")], ROW)
    t.append(a, 0)
    a.write.parquet(str(tmp_path / "t" / "data" / "attempt=main-000000000001-lost"))  # written, never committed
    assert t.read().count() == 1 and t.vacuum() == 1 and t.read().count() == 1 and t.append(a, 1) and t.read().count() == 2


def test_two_tries_at_once(spark, tmp_path, monkeypatch):
    """Both have written their rows before either commits."""
    one, two = (CommittedTable(spark, str(tmp_path / "t"), ROW) for _ in range(2))
    a = spark.createDataFrame([(1, "a")], ROW)
    monkeypatch.setattr(two, "committed", lambda *x: False)  # it looked before the other was done
    assert one.append(a, 0) and not two.append(a, 0)
    assert one.read().count() == 1


@pytest.mark.parametrize("pattern,topic,fits", [("a/+/c", "a/b/c", True), ("a/+/c", "a/b/d/c", False), ("a/#", "a/b/c", True), ("a/#", "a", True), ("#", "x/y", True), ("a.b", "axb", False), ("+", "a/b", False)])
def test_topic_patterns(pattern, topic, fits):
    import re

    assert bool(re.match(topics.topic_pattern(pattern), topic)) == fits


def messages(spark, rows):
    return spark.createDataFrame(rows, "topic string, key string, value string, ts string")


def test_offsets_follow_each_other(spark, tmp_path):
    log = topics.topic_log(spark, str(tmp_path / "log"))
    for batch in range(3):
        topics.publish(log, messages(spark, [(f"z/{i % 2}", f"k{i % 5}", f"{batch}-{i}", f"2024-01-01 00:00:{i:02d}") for i in range(20)]), batch, parts=3)
    assert not topics.publish(log, messages(spark, [("z/0", "k", "again", "2024-01-01 00:00:00")]), 2)
    rows = topics.read_topics(log).collect()
    assert len(rows) == 60
    by = {}
    for r in rows:
        by.setdefault((r["topic"], r["part"]), []).append(r["offset"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and len(by) > 2
    spark.dataSource.register(topics.TopicSource)
    source = spark.read.format(topics.FORMAT).option("path", str(tmp_path / "log")).option("topics", "z/1").load()
    assert {tuple(r) for r in source.collect()} == {tuple(r) for r in rows if r["topic"] == "z/1"}


def test_replay_after_a_crash(spark, tmp_path):
    """The last batch is run again from its offsets, although the log has grown; rows come once."""
    path = str(tmp_path / "log")
    log = topics.topic_log(spark, path)
    out = CommittedTable(spark, str(tmp_path / "out"), topics.MESSAGE)
    check = tmp_path / "check"
    make = lambda b: messages(spark, [("z/%7", f"k{i}", f"{b}-{i}", "2024-01-01 00:00:00") for i in range(10)])
    topics.publish(log, make(0), 0)
    monitor.run_to_end(topics.stream_topics(spark, path), out, str(check))
    first = sorted(p.name for p in (check / "commits").iterdir() if p.name.isdigit())
    topics.publish(log, make(1), 1)
    (check / "commits" / first[-1]).unlink()  # as if the driver had gone before it noted the batch
    (check / "commits" / f".{first[-1]}.crc").unlink(missing_ok=True)
    monitor.run_to_end(topics.stream_topics(spark, path), out, str(check))
    got = [r["value"] for r in out.read().collect()]
    assert len(got) == len(set(got)) == 20
    assert {tuple(r) for r in out.read().collect()} == {tuple(r) for r in topics.read_topics(log).collect()}


def alarms(spark, tmp_path, make, batches, name):
    """Results of a stream that gets one batch of (user, time) after the other."""
    path = str(tmp_path / f"log-{name}")
    log = topics.topic_log(spark, path)
    stream = lambda: make(monitor.as_events(topics.stream_topics(spark, path)))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in stream().schema)
    out = CommittedTable(spark, str(tmp_path / f"out-{name}"), schema)
    for i, batch in enumerate(batches):
        events = spark.createDataFrame([(n, t, u, "click", 1.0, "{}") for n, (u, t) in enumerate(batch)], "event_id long, ts string, user_id long, event_type string, value double, props string")
        rows = monitor.as_messages(events) if batch else monitor.clock(spark, "2200-01-01 00:00:00")
        topics.publish(log, rows, i)
        monitor.run_to_end(stream(), out, str(tmp_path / f"check-{name}"))
    return sorted(tuple(r) for r in out.read().collect())


def test_late_events_of_a_rate_limit(spark, tmp_path):
    day = "2024-01-01 "
    got = alarms(spark, tmp_path, lambda e: stateful.rate_limited(e, 1, watermark="10 minutes"), [
        [(1, day + "00:05:00"), (1, day + "00:50:00"), (2, day + "00:10:00")],
        [(2, day + "00:45:00"), (1, day + "01:05:00")],   # in time: the watermark stands at 00:40
        [(1, day + "03:00:00")],                          # closes the first two hours
        [(1, day + "01:10:00"), (2, day + "03:05:00")],   # late for the window that is closed
        [],
    ], "rate")
    assert got == [(1, day + "00:00:00", 2), (2, day + "00:00:00", 2)]


def test_silence_waits_for_the_watermark(spark, tmp_path):
    day = "2024-01-01 "
    got = alarms(spark, tmp_path, lambda e: stateful.silent(e, gap_seconds=3600, watermark="30 minutes"), [
        [(1, day + "00:00:00"), (1, day + "01:25:00"), (2, day + "00:20:00")],
        [(1, day + "01:00:00"), (2, day + "01:10:00")],   # out of order, but in time: no gap above an hour is left
        [(1, day + "02:15:00")],
        [],
    ], "silence")
    assert got == [(1, day + "02:15:00"), (2, day + "01:10:00")]


def state_rows(spark, tmp_path, make, n):
    """Rows of state and timers after ``n`` events, days apart, of each of three devices."""
    path = str(tmp_path / f"log-{n}")
    times = "timestamp'2024-01-01' + make_interval(0, 0, 0, 3 * CAST(id AS int))"
    events = spark.range(n).selectExpr("id AS event_id", f"date_format({times}, 'yyyy-MM-dd HH:mm:ss') AS ts", "explode(array(1L, 2L, 3L)) AS user_id", "'click' AS event_type", "1.0D AS value", "'{}' AS props")
    topics.publish(topics.topic_log(spark, path), monitor.as_messages(events), 0)
    stream = make(monitor.as_events(topics.stream_topics(spark, path)))
    query = stream.writeStream.format("noop").outputMode("append").option("checkpointLocation", str(tmp_path / f"check-{n}")).start()
    try:
        query.processAllAvailable()
        first = [p for p in query.recentProgress if p["numInputRows"]][0]["stateOperators"][0]
    finally:
        query.stop()
    return first["numRowsUpdated"], first["customMetrics"]["numRegisteredTimers"]


def test_silence_state_grows_with_devices_alone(spark, tmp_path):
    make = lambda e: stateful.silent(e, gap_seconds=86_400)
    few, many = (state_rows(spark, tmp_path, make, n) for n in (2, 200))
    assert few == many and many[1] == 3, (few, many)


def test_rate_limit_state_grows_with_devices_alone(spark, tmp_path):
    make = lambda e: stateful.rate_limited(e, 1)
    few, many = (state_rows(spark, tmp_path, make, n) for n in (2, 200))
    assert few == many and many[1] == 3, (few, many)


def test_one_timer_closes_windows_of_many_batches(spark, tmp_path):
    day = "2024-01-01 "
    got = alarms(spark, tmp_path, lambda e: stateful.rate_limited(e, 1, watermark="2 hours"), [
        [(1, day + "03:05:00"), (1, day + "03:06:00"), (1, day + "04:30:00")],
        [(1, day + "02:40:00"), (1, day + "02:50:00"), (1, day + "04:40:00")],  # an earlier window than the timer's
        [(1, day + "06:10:00")],                                                # closes two, leaves one
        [(1, day + "04:50:00"), (1, day + "06:20:00")],
        [],
    ], "rate-many")
    assert got == [(1, day + "02:00:00", 2), (1, day + "03:00:00", 2), (1, day + "04:00:00", 3), (1, day + "06:00:00", 2)]


def silent_in(rows, gap):
    """Model of the silence alarms over all events."""
    by = {}
    for u, t in rows:
        by.setdefault(u, set()).add(t)
    return sorted((u, a) for u, ts in by.items() for a, b in zip(sorted(ts), [*sorted(ts)[1:], None]) if b is None or b - a > gap)


def test_silence_in_batches_equals_all_at_once(spark, tmp_path):
    """Batches overlap by less than the watermark: runs grow at both ends and grow together."""
    rng, day = random.Random(7), datetime(2024, 1, 1)
    rows = [(rng.randrange(4), day + timedelta(minutes=rng.randrange(0, 3000, 30))) for _ in range(120)]
    rows.sort(key=lambda r: r[1] + timedelta(minutes=rng.randrange(240)))
    cuts = [[(u, f"{t:%Y-%m-%d %H:%M:%S}") for u, t in rows[i:i + 30]] for i in range(0, 120, 30)]
    got = alarms(spark, tmp_path, lambda e: stateful.silent(e, gap_seconds=3600, watermark="300 minutes"), [*cuts, []], "silence-cuts")
    assert got == [(u, f"{t:%Y-%m-%d %H:%M:%S}") for u, t in silent_in(rows, timedelta(hours=1))]


def test_topic_stream_equals_the_table(spark):
    got = catalogue.queries()["topic_window_counts"](spark, "/root/testdata/sf0.001")
    want = catalogue.queries()["streaming_window_counts"](spark, "/root/testdata/sf0.001")
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.select(got.columns).collect()}
    assert got.agg(F.sum("n")).first()[0] == spark.read.parquet("/root/testdata/sf0.001/events.parquet").count()
