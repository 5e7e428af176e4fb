"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tessera.llm.common import materialise


def connected_components(edges: DataFrame, *, max_rounds: int = 60) -> DataFrame:
    """Label the ends of ``edges`` (columns ``a``, ``b`` of one ordered type).

    Returns ``node`` and ``root``, the smallest node reachable, for every node that has a
    link to another node.  Each round points every node at the smallest member of its
    neighbourhood (large star, then small star); rounds needed grow with the logarithm of
    the longest chain.  Nodes reach their neighbourhood's minimum by a grouped minimum
    and a join with it, so a node with very many links is pre-aggregated, never
    collected.  Null ends and self links are left out; an empty table gives an empty one.
    """
    e = edges.filter("a is not null and b is not null and a <> b").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = materialise(e, "components")
    if e.isEmpty():
        return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    before = None
    for _ in range(max_rounds):
        # large star: larger neighbours of each node, to the least node around it
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = materialise(large, "components")
        # small star: smaller neighbours and the node itself, to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").union(low.select("u", F.col("m").alias("v"))).distinct()
        e = materialise(small, "components")
        r = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if (r["n"], r["s"]) == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = (r["n"], r["s"])
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
