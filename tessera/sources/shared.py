"""Tables that a query writes for itself in the folder that all machines share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only where the session names no shared folder and everything runs in one process.
LOCAL_SHARED_DIR = "file:///tmp/tessera-shared"


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors see, from ``spark.checkpoint.dir``.

    Without that setting only a master that runs in this process has a folder, as in
    tests; on a cluster a local one would lose rows silently, so there it is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    own = spark.sparkContext._jsc.sc().getCheckpointDir()
    if own.isDefined():
        return own.get()
    master = spark.sparkContext.master
    if master == "local" or master.startswith("local["):
        return LOCAL_SHARED_DIR
    raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")


def temporary(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder; what comes to lie there goes when the driver ends."""
    path = f"{shared_dir(spark).rstrip('/')}/tessera/{label}-{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table in the shared folder, where a plan reads it more than once.

    It is computed once, its lineage ends there, and no lost executor takes it along.  The
    table goes when the driver ends.
    """
    spark = df.sparkSession
    path = temporary(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
