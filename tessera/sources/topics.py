"""Topics of messages as a Spark data source: a log with offsets that streams replay.

Messages lie in a table of committed batches, cut by topic and part.  Inside a part they are
numbered 0, 1, ..., and each commit says which offsets it added, so a reader knows from the
commits how far a topic goes and which folders hold a range of offsets.  A stream's
checkpoint holds offsets alone: after a restart it reads the same ranges again, as often as
needed, whatever has been added since.

Topics are named in levels, ``zone/7/temperature``.  A pattern's ``+`` is any one level, and
``#`` at its end any rest.  The log's folder must be one that pyarrow's file systems reach
(a local or mounted path, HDFS, S3), as tasks read it without the JVM.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from tessera.sources.committed import CommittedTable

MESSAGE = "topic string, part int, offset long, key string, value string, ts timestamp"
FORMAT = "tessera_topics"


def topic_pattern(pattern: str) -> str:
    """Regex for the topics that a pattern with ``+`` and ``#`` names."""
    levels = pattern.split("/")
    parts = ["[^/]+" if x == "+" else re.escape(x) for x in levels if x != "#"]
    if levels[-1] != "#":
        return "^" + "/".join(parts) + "$"
    return "^" + "/".join(parts) + "(/.*)?$" if parts else "^.*$"


def topic_log(spark: SparkSession, path: str) -> CommittedTable:
    return CommittedTable(spark, path, MESSAGE)


def heads(commits: list[dict]) -> dict[str, int]:
    """The offset after the last one of every ``topic:part``."""
    out: dict[str, int] = {}
    for c in commits:
        for place, (_, end) in c["ranges"].items():
            out[place] = max(end, out.get(place, 0))
    return out


def publish(log: CommittedTable, messages: DataFrame, batch: int, *, parts: int = 4, writer: str = "main") -> bool:
    """Add messages (topic, key, value, ts) as a batch; a batch that is there adds nothing.

    One writer publishes at a time.  A part is a topic's unit of order: its messages follow
    each other by time, so a batch's share of a part is sorted in one task; ``parts`` sets
    how many there are.
    """
    if log.committed(batch, writer):
        return False
    spark = messages.sparkSession
    before = heads(log.commits())
    cut = messages.select("topic", F.pmod(F.xxhash64("key"), F.lit(parts)).cast("int").alias("part"), "key", "value", F.col("ts").cast("timestamp").alias("ts"))
    counts = {f"{r['topic']}:{r['part']}": r["n"] for r in cut.groupBy("topic", "part").agg(F.count("*").alias("n")).collect()}  # a row a topic and part
    ranges = {place: (before.get(place, 0), before.get(place, 0) + n) for place, n in counts.items()}
    first = spark.createDataFrame([(*p.rsplit(":", 1), lo) for p, (lo, _) in ranges.items()], "topic string, part string, lo long")
    own = F.row_number().over(W.partitionBy("topic", "part").orderBy("ts", "key", "value"))
    placed = cut.withColumn("_n", own).join(F.broadcast(first.withColumn("part", F.col("part").cast("int"))), ["topic", "part"])
    rows = placed.select("topic", "part", (F.col("lo") + F.col("_n") - 1).alias("offset"), "key", "value", "ts")
    return log.append(rows, batch, writer=writer, partition_by=("topic", "part"), facts={"ranges": ranges})


def read_topics(log: CommittedTable, pattern: str = "#") -> DataFrame:
    """All messages of the topics so far, as a table."""
    return log.read().filter(F.col("topic").rlike(topic_pattern(pattern)))


def stream_topics(spark: SparkSession, path: str, pattern: str = "#", *, starting: str = "earliest") -> DataFrame:
    """Stream of the topics' messages, from their first offsets or from those after the last."""
    spark.dataSource.register(TopicSource)
    return spark.readStream.format(FORMAT).option("path", path).option("topics", pattern).option("starting", starting).load()


@dataclass
class Span(InputPartition):
    folder: str
    topic: str
    part: int
    lo: int
    hi: int


class _Log:
    """A log as tasks and the stream's planner see it."""

    def __init__(self, options):
        from pyarrow import fs

        path = re.sub(r"^file:/+", "/", options["path"]).rstrip("/")
        self.fs, self.root = fs.FileSystem.from_uri(path)
        self.wanted = re.compile(topic_pattern(options.get("topics", "#")))

    def commits(self) -> list[dict]:
        from pyarrow import fs

        found = self.fs.get_file_info(fs.FileSelector(f"{self.root}/_commits", allow_not_found=True))
        out = []
        for f in sorted((f for f in found if f.base_name.endswith(".json") and not f.base_name.startswith(".")), key=lambda f: f.base_name):
            with self.fs.open_input_stream(f.path) as s:
                out.append(json.loads(s.read()))
        return out

    def heads(self) -> dict[str, int]:
        return {p: n for p, n in heads(self.commits()).items() if self.wanted.match(p.rsplit(":", 1)[0])}

    def spans(self, start: dict, end: dict) -> list[Span]:
        out = []
        for c in self.commits():
            for place, (lo, hi) in c["ranges"].items():
                lo, hi = max(lo, start.get(place, 0)), min(hi, end.get(place, 0))
                if lo < hi:
                    topic, part = place.rsplit(":", 1)
                    out.append(Span(c["folder"], topic, int(part), lo, hi))
        return out

    def rows(self, span: Span):
        import pyarrow as pa
        import pyarrow.dataset as ds

        name = re.sub(r"""[\x01-\x1f"#%'*/:=?\\\x7f{\[\]^]""", lambda m: f"%{ord(m[0]):02X}", span.topic)  # as Spark names folders
        folder = f"{self.root}/{span.folder}/topic={name}/part={span.part}"
        offset = ds.field("offset")
        data = ds.dataset(folder, filesystem=self.fs, format="parquet", partitioning=None)
        for b in data.to_batches(columns=["offset", "key", "value", "ts"], filter=(offset >= span.lo) & (offset < span.hi)):
            if b.num_rows:
                ts = b.column(3).cast(pa.timestamp("us", "UTC"))
                yield pa.RecordBatch.from_arrays([pa.array([span.topic] * b.num_rows), pa.array([span.part] * b.num_rows, pa.int32()), b.column(0), b.column(1), b.column(2), ts],
                                                 names=["topic", "part", "offset", "key", "value", "ts"])


class TopicSource(DataSource):
    """Options: path of the log, topics (a pattern), starting (earliest or latest)."""

    @classmethod
    def name(cls):
        return FORMAT

    def schema(self):
        return MESSAGE

    def reader(self, schema):
        return TopicReader(self.options)

    def streamReader(self, schema):
        return TopicStreamReader(self.options)


class TopicReader(DataSourceReader):
    def __init__(self, options):
        self.options = dict(options)

    def partitions(self):
        log = _Log(self.options)
        return log.spans({}, log.heads())

    def read(self, partition):
        yield from _Log(self.options).rows(partition)


class TopicStreamReader(DataSourceStreamReader):
    """Offsets are the next one to read of every topic and part."""

    def __init__(self, options):
        self.options = dict(options)

    def initialOffset(self):
        return _Log(self.options).heads() if self.options.get("starting") == "latest" else {}

    def latestOffset(self):
        return _Log(self.options).heads()

    def partitions(self, start, end):
        return _Log(self.options).spans(start, end)

    def read(self, partition):
        yield from _Log(self.options).rows(partition)

    def commit(self, end):
        """Nothing to give back: the log keeps its messages."""


# tasks get these classes by value: executors need not have this package
cloudpickle.register_pickle_by_value(__import__(__name__, fromlist=["_"]))
