"""Co-occurrence mining: frequent itemsets, association rules, rule lookup.

Transactions are rows with an ``items`` array; repeats inside one count once.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame, SparkSession, functions as F

# Item pairs known not to go together.
INCOMPATIBLE = [
    (["Ethanol", "Nitric Acid"], "REACTIVE: Strong oxidizer + organic flammable liquid (Fire/Explosion Risk)"),
    (["Sodium Cyanide", "Sulfuric Acid"], "TOXIC GAS: Cyanide salt + Strong acid releases Hydrogen Cyanide gas"),
    (["Ammonium Nitrate", "Fuel Oil"], "EXPLOSIVE: Oxidizer + Fuel mixture (ANFO explosive risk)"),
]
COMPATIBLE = "COMPATIBLE: No known CAMEO reactivity warning."


def frequent_itemsets(transactions: DataFrame, min_support: float = 0.2) -> DataFrame:
    """(items sorted, freq, n): itemsets in at least ``min_support`` of the n transactions."""
    sets = transactions.filter(F.size("items") > 0).select(F.array_distinct("items").alias("items"))
    n = transactions.count()
    schema = "items array<string>, freq long, n long"
    if n == 0:
        return transactions.sparkSession.createDataFrame([], schema)
    model = FPGrowth(itemsCol="items", minSupport=min_support * 0.999999).fit(sets)
    found = model.freqItemsets.select(F.array_sort("items").alias("items"), "freq", F.lit(n).cast("long").alias("n"))
    return found.filter(F.col("freq") >= F.lit(min_support) * F.col("n") - F.lit(1e-9))


def association_rules(itemsets: DataFrame, min_lift: float = 1.0) -> DataFrame:
    """Rules over all non-empty splits of each itemset, with lift of at least ``min_lift``.

    Splits are numbered by bit masks and both sides' counts come by equality joins.  For a
    lift of one the bound is checked on whole numbers.
    """
    wide = itemsets.filter(F.size("items") > 1)
    masks = F.sequence(F.lit(1).cast("long"), F.pow(F.lit(2.0), F.size("items")).cast("long") - 2)
    split = wide.select("items", "freq", "n", F.explode(masks).alias("mask"))
    bit = lambda i: F.floor(F.col("mask") / F.pow(F.lit(2.0), i)) % 2 == 1
    sides = split.select("items", "freq", "n", F.filter("items", lambda x, i: bit(i)).alias("antecedents"), F.filter("items", lambda x, i: ~bit(i)).alias("consequents"))
    a = itemsets.select(F.col("items").alias("antecedents"), F.col("freq").alias("fa"))
    c = itemsets.select(F.col("items").alias("consequents"), F.col("freq").alias("fc"))
    rules = sides.join(a, "antecedents").join(c, "consequents")
    product = F.col("fa") * F.col("fc")
    enough = F.col("n") * F.col("freq") >= (product if min_lift == 1.0 else product * F.lit(min_lift))
    return rules.filter(enough).select(
        "antecedents", "consequents", F.round(F.col("freq") / F.col("n"), 4).alias("support"),
        F.round(F.col("freq") / F.col("fa"), 4).alias("confidence"), F.round(F.col("n") * F.col("freq") / product, 4).alias("lift"))


def lookup(rules: DataFrame, table: list[tuple[list[str], str]] = INCOMPATIBLE, default: str = COMPATIBLE) -> DataFrame:
    """Add the status of each rule's whole itemset from a small fixed table."""
    spark: SparkSession = rules.sparkSession
    known = spark.createDataFrame([(sorted(k), v) for k, v in table], "_key array<string>, _status string")
    keyed = rules.withColumn("_key", F.array_sort(F.array_union("antecedents", "consequents")))
    return keyed.join(F.broadcast(known), "_key", "left").withColumn("incompatibility_status", F.coalesce("_status", F.lit(default))).drop("_key", "_status")


def mine(transactions: DataFrame, min_support: float = 0.2, min_lift: float = 1.0) -> DataFrame:
    """Rules of the transactions with their status."""
    return lookup(association_rules(frequent_itemsets(transactions, min_support), min_lift))
