"""Row numbers in an order of their own, without all rows in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from tessera.sources.shared import written


def numbered(df: DataFrame, keys: list[str], name: str, *, start: int = 1) -> DataFrame:
    """``df`` with ``name``: start, start + 1, ... in the order of ``keys``.

    Spark deals the rows out by ranges of sampled quantiles, so the ranges are even however
    the keys are spread; each is sorted where it is and written with a row's place in it.
    The counts of the ranges before are added, one row a partition.  ``df`` is computed
    once.
    """
    placed = df.repartitionByRange(*[F.col(k) for k in keys]).sortWithinPartitions(*keys)
    placed = written(placed.withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part = placed.withColumn("_part", F.shiftright("_at", 33))
    counts = part.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("_part", before.alias("_before"))  # a row a partition
    inside = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return part.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_before") + inside + start).drop("_part", "_before", "_at")
