"""Alarms of streams that keep state: rate limits and silent devices, closed by watermarks.

State is held for what the watermark has not passed, and timers take it away: a device's
counts of open windows, and its runs of events that a later one may still follow.  Each
call of Spark's state interface goes to the JVM and back, so a device's state is one value
that a batch reads and writes once, and one timer stands for the first window or run to end.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _OneValue(StatefulProcessor):
    """A device's state: two lists beside each other, and when it is looked at next."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "a array<long>, b array<long>, timer long")

    def read(self) -> tuple[list[int], list[int], int | None]:
        return self.state.get() or ([], [], None)

    def write(self, a: list[int], b: list[int], due: int, timer: int | None) -> None:
        """``due``: when the first of the lists ends; a timer before that looks again."""
        if timer is None or due < timer:
            self.handle.registerTimer(due)
            timer = due
        self.state.update((a, b, timer))


class RateLimit(_OneValue):
    """Windows in which a device sent more than ``limit`` events, once each is over."""

    def __init__(self, limit: int, window_ms: int):
        self.limit, self.window = limit, window_ms

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        us = 1000 * self.window
        came = Counter(at // us * self.window for _, at in rows if at is not None)
        # Spark itself lets pass what came one watermark too late
        now = timerValues.getCurrentWatermarkInMs()
        came = {at: n for at, n in came.items() if at + self.window > now}
        if came:
            starts, counts, timer = self.read()
            had = dict(zip(starts, counts))
            for at, n in came.items():
                had[at] = had.get(at, 0) + n
            self.write(list(had), list(had.values()), min(had) + self.window, timer)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        starts, counts, _ = self.read()
        now = timerValues.getCurrentWatermarkInMs()
        left = {at: n for at, n in zip(starts, counts) if at + self.window > now}
        if left:
            self.write(list(left), list(left.values()), min(left) + self.window, None)
        else:
            self.state.clear()
        for at, n in zip(starts, counts):
            if at not in left and n > self.limit:
                yield Row(user_id=key[0], at_us=1000 * at, n=n)


class Silence(_OneValue):
    """Events that none of the same device follows within the gap, once it is over.

    A run of events with no longer gap between them is held as its first and its last.
    """

    def __init__(self, gap_us: int):
        self.gap = gap_us

    def _timer(self, at: int) -> int:
        return (at + self.gap) // 1000 + 1

    def _runs(self, pieces: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
        firsts, lasts = [], []
        for first, last in sorted(pieces):
            if lasts and first - lasts[-1] <= self.gap:
                lasts[-1] = max(last, lasts[-1])
            else:
                firsts.append(first)
                lasts.append(last)
        return firsts, lasts

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        since = 1000 * timerValues.getCurrentWatermarkInMs()
        came = {at for _, at in rows if at is not None and at >= since}
        if came:
            firsts, lasts, timer = self.read()
            firsts, lasts = self._runs([*zip(firsts, lasts), *((at, at) for at in came)])
            self.write(firsts, lasts, self._timer(lasts[0]), timer)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        firsts, lasts, _ = self.read()
        now = timerValues.getCurrentWatermarkInMs()
        over = sum(self._timer(at) <= now for at in lasts)  # the first ones: runs follow each other
        if over < len(lasts):
            self.write(firsts[over:], lasts[over:], self._timer(lasts[over]), None)
        else:
            self.state.clear()
        for at in lasts[:over]:
            yield Row(user_id=key[0], at_us=at)


def _keyed(events: DataFrame, watermark: str):
    """Times by device; rows of the clock have none and only move the watermark."""
    rows = events.withWatermark("ts", watermark).select("user_id", F.when(F.col("event_type") != "clock", F.unix_micros("ts")).alias("at_us"))
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return rows.groupBy("user_id")


def _clock_text(us):
    return F.date_format(F.timestamp_micros(us), "yyyy-MM-dd HH:mm:ss")


def rate_limited(events: DataFrame, limit: int, *, window_ms: int = 3_600_000, watermark: str = "10 minutes") -> DataFrame:
    """Stream of (user_id, window_start, n) as ``monitor.rate_limited`` gives for tables.

    A window comes out once the watermark has passed its end; later events are left out.
    """
    out = _keyed(events, watermark).transformWithState(RateLimit(limit, window_ms), "user_id long, at_us long, n long", "append", "EventTime")
    return out.select("user_id", _clock_text(F.col("at_us")).alias("window_start"), "n")


def silent(events: DataFrame, *, gap_seconds: int, watermark: str = "10 minutes") -> DataFrame:
    """Stream of (user_id, silent_since): no event for longer than the gap after that time."""
    out = _keyed(events, watermark).transformWithState(Silence(1_000_000 * gap_seconds), "user_id long, at_us long", "append", "EventTime")
    return out.select("user_id", _clock_text(F.col("at_us")).alias("silent_since"))


# tasks get these classes by value: executors need not have this package
cloudpickle.register_pickle_by_value(__import__(__name__, fromlist=["_"]))
