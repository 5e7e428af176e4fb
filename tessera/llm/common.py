"""Helpers shared by the operators of this subpackage: shared storage and numpy state sums."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
import zipfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tessera.sources.shared import shared_dir

_c = ctypes.CDLL(None)


def materialise(df: DataFrame, label: str, *, free: bool = False) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    This cuts the lineage in a way that survives lost executors: later jobs read the
    table and never depend on blocks that one executor holds.  With ``free`` the driver
    collects garbage afterwards, whereupon Spark removes the shuffle files that only the
    finished write needed; for large shuffles, as it would do so late by itself.

    ``discard`` deletes the table early; the others go when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/tessera/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    where, fs = _hadoop(spark, path)
    fs.deleteOnExit(where)
    if free:
        spark.sparkContext._jvm.System.gc()
    out = spark.read.schema(df.schema).parquet(path)
    out._tessera_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the table behind a result of ``materialise`` that nothing reads any more."""
    where, fs = _hadoop(df.sparkSession, df._tessera_path)
    fs.delete(where, True)


def _hadoop(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def unused(columns: list[str], name: str) -> str:
    """``name``, or a longer one that none of ``columns`` has, whatever the case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def ship_package(spark: SparkSession) -> None:
    """Send this subpackage's code to the Python workers, once for each Spark context.

    Workers need it wherever they start; Spark's file server hands it to every executor,
    also to those that replace lost ones.
    """
    sc = spark.sparkContext
    if getattr(sc, "_tessera_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="tessera-code-"), "tessera_code.zip")
    with zipfile.ZipFile(path, "w") as z:
        for name in ("__init__.py", "sources/__init__.py", "sources/shared.py"):
            z.write(os.path.join(os.path.dirname(here), name), f"tessera/{name}")
        for name in sorted(os.listdir(here)):
            if name.endswith(".py"):
                z.write(os.path.join(here, name), f"tessera/llm/{name}")
    sc.addPyFile(path)
    sc._tessera_shipped = True


def map_arrow(df: DataFrame, function, schema) -> DataFrame:
    """``df.mapInArrow`` with this subpackage importable on the workers.

    Workers live on after a task, so each task gives back the memory that its arrays took.
    """
    ship_package(df.sparkSession)

    def run(batches):
        yield from function(batches)
        _give_back()

    return df.mapInArrow(run, schema)


def _give_back() -> None:
    pa.default_memory_pool().release_unused()
    if hasattr(_c, "malloc_trim"):
        _c.malloc_trim(0)


#: Arrays that a task of ``tree_fold`` takes together.
FAN_IN = 24


def tree_fold(df: DataFrame, dtype, fold=np.add) -> np.ndarray | None:
    """Fold the fixed-size binary arrays in the only column of ``df``; None without rows.

    Each round writes the arrays of ``FAN_IN`` partitions as one, so neither the driver nor
    a task ever holds more than two of them, however many partitions there are.
    """
    name = df.columns[0]

    def together(batches):
        total = None
        for b in batches:
            for x in b.column(0):
                x = np.frombuffer(x.as_buffer(), dtype)
                total = x.copy() if total is None else fold(total, x, out=total)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=[name])

    while True:
        level = materialise(df, "fold")
        parts = -(-level.rdd.getNumPartitions() // FAN_IN)
        df = map_arrow(level.coalesce(max(1, parts)), together, df.schema)
        if parts <= 1:
            rows = df.collect()  # one row at most
            discard(level)
            return np.frombuffer(rows[0][0], dtype) if rows else None


def tree_sum(df: DataFrame, dtype) -> np.ndarray | None:
    """``tree_fold`` by addition."""
    return tree_fold(df, dtype)
