"""Quality metrics of retrieval and classification, as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

STATES = ["SAFE", "WARNING", "UNKNOWN"]


def set_scores(predicted: Column, expected: Column) -> tuple[Column, Column, Column]:
    """Precision, recall and F1 of two sets; 1 each if both are empty, 0 for an empty side."""
    hit = F.size(F.array_intersect(predicted, expected))
    np, ne = F.size(F.array_distinct(predicted)), F.size(F.array_distinct(expected))
    both = (np == 0) & (ne == 0)
    p = F.when(both, 1.0).when(np == 0, 0.0).otherwise(hit / F.greatest(np, F.lit(1)))
    r = F.when(both, 1.0).when(ne == 0, 0.0).otherwise(hit / F.greatest(ne, F.lit(1)))
    f = F.when(both, 1.0).when(hit == 0, 0.0).otherwise(2.0 * hit / F.greatest(np + ne, F.lit(1)))
    return p, r, f


def evaluate_sets(results: DataFrame) -> DataFrame:
    """Metrics of each category from rows (category, predicted, expected).

    Wildcard results must equal what is expected; others must be non-empty and contained.
    F1 is averaged over queries.
    """
    p, r, f = set_scores(F.col("predicted"), F.col("expected"))
    inside = F.size(F.array_except("predicted", "expected")) == 0
    equal = inside & (F.size(F.array_except("expected", "predicted")) == 0)
    right = F.when(F.col("category") == "wildcard", equal).otherwise(inside & (F.size("predicted") > 0))
    scored = results.select("category", right.cast("double").alias("ok"), p.alias("p"), r.alias("r"), f.alias("f"))
    return scored.groupBy("category").agg(F.count("*").alias("n_queries"), F.avg("ok").alias("pass_rate"), F.avg("p").alias("precision"), F.avg("r").alias("recall"), F.avg("f").alias("f1"))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / F.when(b > 0, b)).otherwise(F.lit(0.0))


def classification_report(rows: DataFrame, classes: list) -> DataFrame:
    """Per class, macro and weighted precision, recall, F1 and support.

    ``rows`` has truth and predicted; all classes come out of one aggregate.
    """
    parts = []
    for i, c in enumerate(classes):
        t, p = F.col("truth") == F.lit(c), F.col("predicted") == F.lit(c)
        parts += [F.count_if(t & p).alias(f"tp{i}"), F.count_if(p).alias(f"pp{i}"), F.count_if(t).alias(f"ap{i}")]
    one = rows.agg(*parts)
    made = []
    for i, c in enumerate(classes):
        tp, pp, ap = F.col(f"tp{i}"), F.col(f"pp{i}"), F.col(f"ap{i}")
        made.append(F.struct(F.lit(str(c)).alias("class"), _ratio(tp, pp).alias("precision"), _ratio(tp, ap).alias("recall"), _ratio(2 * tp, pp + ap).alias("f1"), ap.alias("support")))
    each = one.select(F.inline(F.array(*made)))
    total = each.agg(
        F.avg("precision").alias("mp"), F.avg("recall").alias("mr"), F.avg("f1").alias("mf"), F.sum("support").alias("n"),
        *[_ratio(F.sum(F.col(c) * F.col("support")), F.sum("support")).alias("w" + c[0]) for c in ("precision", "recall", "f1")])
    rows2 = total.select(F.inline(F.array(
        F.struct(F.lit("macro avg").alias("class"), F.col("mp").alias("precision"), F.col("mr").alias("recall"), F.col("mf").alias("f1"), F.col("n").alias("support")),
        F.struct(F.lit("weighted avg").alias("class"), F.col("wp").alias("precision"), F.col("wr").alias("recall"), F.col("wf").alias("f1"), F.col("n").alias("support")))))
    return each.unionByName(rows2)


def confusion_matrix(rows: DataFrame, classes: list[str] = STATES) -> DataFrame:
    """One row for each truth with a count column for each predicted class."""
    return rows.groupBy("truth").agg(*[F.count_if(F.col("predicted") == c).alias(f"pred_{c.lower()}") for c in classes])


def accuracy(rows: DataFrame) -> DataFrame:
    return rows.agg(F.avg((F.col("truth") == F.col("predicted")).cast("double")).alias("accuracy"), F.count("*").alias("n"))


def stage_table(results: DataFrame) -> DataFrame:
    """Counts of queries by category and the stage that resolved them."""
    stages = ["exact", "edit_distance", "soundex", "none"]
    stage = F.coalesce("stage", F.lit("none"))
    return results.groupBy("category").agg(*[F.count_if(stage == s).alias(f"n_{s}") for s in stages])


def ranked_metrics(ranked: DataFrame, relevant: DataFrame, *, precision_at: int = 5, recall_at: int = 10) -> DataFrame:
    """Precision@k, recall@k and average precision of each item_id.

    ``ranked`` has item_id, doc_id, rank; ``relevant`` has item_id, doc_id.  Average
    precision is over all relevant documents of the item.
    """
    from pyspark.sql import Window as W

    good = relevant.select("item_id", "doc_id").distinct()
    totals = good.groupBy("item_id").agg(F.count("*").alias("n_relevant"))
    hits = ranked.join(good.withColumn("hit", F.lit(1)), ["item_id", "doc_id"], "left").withColumn("hit", F.coalesce("hit", F.lit(0)))
    seen = F.sum("hit").over(W.partitionBy("item_id").orderBy("rank").rowsBetween(W.unboundedPreceding, 0))
    scored = hits.withColumn("seen", seen)
    agg = scored.groupBy("item_id").agg(
        (F.sum(F.when(F.col("rank") <= precision_at, F.col("hit")).otherwise(0)) / F.lit(float(precision_at))).alias("precision_at"),
        F.sum(F.when(F.col("rank") <= recall_at, F.col("hit")).otherwise(0)).alias("_found"),
        F.sum(F.when(F.col("hit") == 1, F.col("seen") / F.col("rank")).otherwise(0.0)).alias("_ap"))
    j = agg.join(totals, "item_id", "left").withColumn("n_relevant", F.coalesce("n_relevant", F.lit(0)))
    return j.select("item_id", "precision_at", _ratio(F.col("_found"), F.col("n_relevant")).alias("recall_at"), _ratio(F.col("_ap"), F.col("n_relevant")).alias("average_precision"), "n_relevant")


def conflict_counts(rows: DataFrame) -> DataFrame:
    """True, false and missed conflicts from Boolean columns truth and predicted."""
    t, p = F.col("truth"), F.col("predicted")
    return rows.agg(F.count_if(t & p).alias("true_conflicts"), F.count_if(~t & p).alias("false_conflicts"), F.count_if(t & ~p).alias("missed_conflicts"))


def extraction_scores(rows: DataFrame) -> DataFrame:
    """Micro precision, recall and F1 of each kind from rows (kind, predicted, expected).

    Predicted and expected are arrays of the values of one document.
    """
    hit = F.size(F.array_intersect("predicted", "expected"))
    n = rows.groupBy("kind").agg(F.sum(hit).alias("h"), F.sum(F.size(F.array_distinct("predicted"))).alias("p"), F.sum(F.size(F.array_distinct("expected"))).alias("e"))
    return n.select("kind", _ratio(F.col("h"), F.col("p")).alias("precision"), _ratio(F.col("h"), F.col("e")).alias("recall"), _ratio(2 * F.col("h"), F.col("p") + F.col("e")).alias("f1"))
