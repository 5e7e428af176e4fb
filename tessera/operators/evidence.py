"""Evidence: authority, citations, conflicts and the authoritative threshold.

Thresholds are rows (chemical, ord, metric_name, value, unit, direction, sds_id,
supplier_name, section_number, authority_score, citation, hazard_statements); ``ord`` is
the order in which sources were given and settles ties.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tessera.functions.text import jaccard

# Authority of supplier tiers, and of a supplier outside them.
AUTHORITY = {
    "Primary Manufacturer": 1.0,
    "Authorized Distributor": 0.85,
    "Generic Safety Registry": 0.70,
    "Unverified Third-Party": 0.50,
}
UNRECOGNISED = 0.40
TOLERANCE_PERCENT = 5.0
HAZARD_JACCARD = 0.6
KEYS = ["chemical", "metric_name"]

# Preferred and second source by type of question.
ROUTES = [
    ("storage conditions", "supplier section 7", "niosh"),
    ("ppe", "supplier section 8", "niosh"),
    ("exposure limits", "niosh", "supplier"),
    ("identity and synonyms", "pubchem", "supplier"),
    ("reactivity", "cameo", "supplier section 10"),
    ("historical incidents", "chemical safety board", None),
]


def authority(supplier: Column, custom: Column | None = None) -> Column:
    """Custom score if there is one (an error outside 0 to 1), else the tier's, else 0.40."""
    tier = None
    for name, score in AUTHORITY.items():
        tier = F.when(supplier == name, score) if tier is None else tier.when(supplier == name, score)
    tier = tier.otherwise(F.lit(UNRECOGNISED))
    if custom is None:
        return tier
    bad = F.raise_error(F.concat(F.lit("custom score must be between 0.0 and 1.0, got "), custom.cast("string")))
    return F.when(custom.isNull(), tier).when(custom.between(0.0, 1.0), custom).otherwise(bad.cast("double"))


def citation(chemical: Column, sds_id: Column, supplier: Column, section: Column, metric: Column, value: Column, unit: Column) -> Column:
    """``[id] section - supplier: chemical metric threshold = value unit``."""
    return F.concat(F.lit("["), sds_id, F.lit("] "), section, F.lit(" - "), supplier, F.lit(": "), chemical, F.lit(" "), metric, F.lit(" threshold = "), value.cast("string"), F.lit(" "), unit)


def hazard_conflict(a: Column, b: Column, threshold: float = HAZARD_JACCARD) -> tuple[Column, Column]:
    """(conflict, similarity) of two hazard sets; two empty sets conflict."""
    empty = (F.size(a) == 0) & (F.size(b) == 0)
    sim = jaccard(a, b)
    return empty | (sim < threshold), sim


def hazard_conflicts(thresholds: DataFrame, keys: list[str] = KEYS, threshold: float = HAZARD_JACCARD) -> DataFrame:
    """First conflicting pair of sources (i < j by ord) of each group that has one.

    Sources without hazard statements take no part.  Sources are first reduced to the
    first one of each distinct set, as pairs of equal sets cannot conflict and the first
    pair between two sets is that of their first sources; so a group's pairs grow with
    its distinct sets only.
    """
    have = thresholds.filter(F.size("hazard_statements") > 0).withColumn("_set", F.array_sort(F.array_distinct("hazard_statements")))
    sets = have.groupBy(*keys, "_set").agg(F.min(F.struct("ord", "supplier_name")).alias("_who"))
    a, b = sets.alias("a"), sets.alias("b")
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    pairs = a.join(b, [*same, F.col("a._set") < F.col("b._set")])
    conflict, sim = hazard_conflict(F.col("a._set"), F.col("b._set"), threshold)
    x, y = F.col("a._who"), F.col("b._who")
    low, high = F.least(x, y), F.greatest(x, y)
    found = pairs.filter(conflict).select(*[F.col(f"a.{k}").alias(k) for k in keys], F.struct(low.getField("ord").alias("i"), high.getField("ord").alias("j")).alias("_pair"), low.getField("supplier_name").alias("left_supplier"), high.getField("supplier_name").alias("right_supplier"), sim.alias("similarity"))
    first = found.groupBy(*keys).agg(F.min_by(F.struct("_pair", "left_supplier", "right_supplier", "similarity"), F.col("_pair")).alias("f"))
    return first.select(*keys, F.col("f._pair.i").alias("left_ord"), F.col("f._pair.j").alias("right_ord"), "f.left_supplier", "f.right_supplier", "f.similarity")


def reconcile(thresholds: DataFrame, keys: list[str] = KEYS, tolerance: float = TOLERANCE_PERCENT) -> DataFrame:
    """The authoritative threshold of each group, or a conflict.

    Among the sources of top authority, values that spread over more than ``tolerance``
    percent of the largest magnitude conflict; else the first of them is primary.  Returns
    the keys, n_sources, n_top, top_authority, spread_percent, conflict, mixed_units and
    the primary source's columns in ``primary`` (null on conflict).

    Sources are dealt out once, by their group, as they are: their sums are wider than they
    are.  A group with very many is sorted in its task, which spills, and never held there.
    """
    fields = [c for c in thresholds.columns if c not in keys]
    unit = F.xxhash64(F.lower(F.trim("unit")))
    own_unit = F.when(F.col("unit").isNotNull(), unit)
    tiers = thresholds.repartition(*keys).groupBy(*keys, "authority_score").agg(
        F.count("*").alias("n"), F.max("value").alias("hi"), F.min("value").alias("lo"), F.max(F.abs("value")).alias("abs"),
        F.min_by(F.struct(*fields), F.struct("ord", "supplier_name")).alias("first"), F.coalesce(F.min(own_unit) < F.max(own_unit), F.lit(False)).alias("mixed"))
    top = tiers.groupBy(*keys).agg(F.sum("n").alias("n_sources"), F.max_by(F.struct("n", "hi", "lo", "abs", "first", "mixed", "authority_score"), "authority_score").alias("t"))
    magnitude = F.col("t.abs")
    spread = F.when((F.col("t.n") > 1) & (magnitude > 0), (F.col("t.hi") - F.col("t.lo")) / F.when(magnitude > 0, magnitude) * 100.0).otherwise(F.lit(0.0))
    conflict = (F.col("t.n") > 1) & (spread > tolerance)
    return top.select(*keys, "n_sources", F.col("t.n").alias("n_top"), F.col("t.authority_score").alias("top_authority"), spread.alias("spread_percent"), conflict.alias("conflict"),
                      F.col("t.mixed").alias("mixed_units"), F.when(~conflict, F.col("t.first")).alias("primary"))


def audit_notes(thresholds: DataFrame, reconciled: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """(keys, ord, note): each source's part in the outcome, one row a source.

    Sources are selected, superseded, or, in a conflict, named with their value if they
    have top authority.
    """
    r = reconciled.select(*keys, "top_authority", "conflict", F.col("primary.ord").alias("_ord"))
    # dealt out as ``reconcile`` does it, so that one exchange serves both
    j = thresholds.repartition(*keys).join(r, keys)
    score = F.col("authority_score").cast("string")
    # fixed values: the texts of the notes on selected and superseded sources
    note = (F.when(F.col("conflict") & (F.col("authority_score") == F.col("top_authority")), F.concat(F.lit("Conflict: "), F.col("supplier_name"), F.lit("="), F.col("value").cast("string"), F.col("unit")))
            .when(~F.col("conflict") & (F.col("ord") == F.col("_ord")), F.concat(F.lit("Selected primary authority '"), F.col("supplier_name"), F.lit("' (score="), score, F.lit(")")))
            .when(~F.col("conflict"), F.concat(F.lit("Superseded secondary source '"), F.col("supplier_name"), F.lit("' (score="), score, F.lit(")"))))
    return j.select(*keys, "ord", note.alias("note")).filter("note is not null")


def conflict_summary(notes: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Names of all sources in each conflict, in order, as one text."""
    named = notes.filter(F.col("note").startswith("Conflict: ")).select(*keys, "ord", F.substring("note", 11, 1 << 20).alias("name"))
    return named.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "name"))), lambda x: x["name"]), ", ").alias("conflict_sources"))


def conservative(thresholds: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Temporary control values: the least ceiling and the greatest floor of each group."""
    return thresholds.groupBy(*keys).agg(
        F.min(F.when(F.col("direction") == "max", F.col("value"))).alias("control_ceiling"),
        F.max(F.when(F.col("direction") == "min", F.col("value"))).alias("control_floor"),
        F.count("*").alias("n_sources"))


def current_versions(documents: DataFrame, keys: list[str], date: str, value: str, ties: list[str], tolerance: float = TOLERANCE_PERCENT) -> DataFrame:
    """The latest version of each key, the number of versions, and whether they disagree."""
    latest = F.max_by(F.struct(date, value), F.struct(date, *ties))
    spread = (F.max(value) - F.min(value)) / F.when(F.max(F.abs(value)) > 0, F.max(F.abs(value))) * 100.0
    out = documents.groupBy(*keys).agg(latest.alias("l"), F.count("*").alias("n_versions"), F.coalesce(spread > tolerance, F.lit(False)).alias("version_conflict"))
    return out.select(*keys, F.col(f"l.{date}").alias(date), F.col(f"l.{value}").alias(value), "n_versions", "version_conflict")


def route(questions: DataFrame, spark: SparkSession) -> DataFrame:
    """Add the preferred and second source of each row's ``question_type`` (six fixed rows)."""
    table = spark.createDataFrame(ROUTES, "question_type string, preferred string, fallback string")
    return questions.join(F.broadcast(table), "question_type", "left")
