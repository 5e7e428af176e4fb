"""Tables of committed batches: what a batch adds is there once, however often it is tried.

A batch writes its rows to a folder of its own, then a commit file that names the folder.
The commit file is made only if it is not there yet, so of several tries of one batch one
counts; rows of the others are in folders that no commit names, and ``vacuum`` deletes
them.  Readers take their folders from the commits alone: they never see half a batch, and
adding to the table never rewrites it.  All files go through the file system that Spark
itself uses for the path.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession


class CommittedTable:
    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs

    def _at(self, *names: str):
        where = self._hadoop.Path("/".join([self.path, *names]))
        return where, where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _text(self, where, fs) -> str:
        jvm = self.spark.sparkContext._jvm
        stream = fs.open(where)
        try:
            return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def commits(self) -> list[dict]:
        """Commits in the order of writer and batch: a small file each."""
        where, fs = self._at("_commits")
        if not fs.exists(where):
            return []
        files = [f.getPath() for f in fs.listStatus(where) if f.getPath().getName().endswith(".json")]
        return sorted((json.loads(self._text(f, fs)) for f in files), key=lambda c: (c["writer"], c["batch"]))

    def committed(self, batch: int, writer: str = "main") -> bool:
        where, fs = self._at("_commits", f"{writer}-{batch:012d}.json")
        return fs.exists(where)

    def append(self, df: DataFrame, batch: int, *, writer: str = "main", partition_by: tuple[str, ...] = (), facts: dict | None = None) -> bool:
        """Add ``df`` as a writer's batch; False, and nothing added, if that batch is there.

        ``facts`` go into the commit.  Two tries that run at once may both write rows; the
        commit file of the second one fails to be made and its rows count for nothing.
        """
        if self.committed(batch, writer):
            return False
        folder = f"data/attempt={writer}-{batch:012d}-{uuid.uuid4().hex}"
        df.write.partitionBy(*partition_by).parquet(f"{self.path}/{folder}")
        where, fs = self._at("_commits", f"{writer}-{batch:012d}.json")
        # written aside and moved, so that a commit is never read half
        aside, _ = self._at("_commits", f".{uuid.uuid4().hex}")
        out = fs.create(aside, False)
        out.write(json.dumps({"writer": writer, "batch": batch, "folder": folder, **(facts or {})}).encode())
        out.close()
        won = not fs.exists(where) and fs.rename(aside, where)
        if not won:
            fs.delete(aside, False)
        return won

    def read(self) -> DataFrame:
        folders = [f"{self.path}/{c['folder']}" for c in self.commits()]
        none = self.spark.createDataFrame([], self.schema)
        if not folders:
            return none
        rows = self.spark.read.schema(f"{self.schema}, attempt string").option("basePath", f"{self.path}/data")
        return rows.parquet(*folders).select(*none.columns)

    def vacuum(self) -> int:
        """Delete the folders of tries that never counted; not while one is under way."""
        kept = {c["folder"].split("/")[1] for c in self.commits()}
        where, fs = self._at("data")
        lost = [f.getPath() for f in fs.listStatus(where) if f.getPath().getName() not in kept] if fs.exists(where) else []
        for f in lost:
            fs.delete(f, True)
        return len(lost)


def batch_sink(table: CommittedTable, writer: str = "stream"):
    """Function for ``foreachBatch``: a batch that Spark runs again adds nothing."""
    def add(batch: DataFrame, number: int) -> None:
        table.append(batch, number, writer=writer)
    return add
