"""Safety verdicts, alerts and sign-off.

Readings are rows (chemical, zone_id, metric_name, current_value, unit, and any others).
Names and metrics must match after normalisation of the name; a reading that cannot be
judged is UNKNOWN, never SAFE, also if its value is null or NaN.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tessera.functions.text import normalised
from tessera.operators.numbering import numbered
from tessera.operators.evidence import HAZARD_JACCARD, TOLERANCE_PERCENT, hazard_conflicts, reconcile

SAFE, WARNING, UNKNOWN = "SAFE", "WARNING", "UNKNOWN"


def unsafe(value: Column, limit: Column, direction: Column) -> Column:
    """At or beyond the limit: from it up for a ceiling, from it down for a floor."""
    return F.when(direction == "max", value >= limit).otherwise(value <= limit)


def evaluate(readings: DataFrame, thresholds: DataFrame, *, tolerance: float = TOLERANCE_PERCENT, hazard_jaccard: float = HAZARD_JACCARD) -> DataFrame:
    """Verdict of every reading: its columns, state, cause, threshold_value, provenance, reasoning.

    The causes are tried in a fixed order: no thresholds, no matching metric, hazard
    conflict, numeric conflict, unit mismatch, no value; then the value is compared.
    """
    t = thresholds.withColumn("_key", normalised(F.col("chemical")))
    keys = ["_key", "metric_name"]
    known = t.select("_key").distinct().withColumn("_known", F.lit(True))
    rec = reconcile(t.withColumnRenamed("chemical", "chemical_name"), keys, tolerance)
    haz = hazard_conflicts(t, keys, hazard_jaccard).select(*keys, F.lit(True).alias("_hazard"), "left_supplier", "right_supplier", "similarity")
    r = readings.withColumn("_key", normalised(F.col("chemical")))
    j = r.join(known, "_key", "left").join(rec, keys, "left").join(haz, keys, "left")
    p = F.col("primary")
    value, limit = F.col("current_value"), p["value"]
    cause = (F.when(F.col("_known").isNull(), "no_thresholds").when(F.col("n_sources").isNull(), "no_metric").when(F.col("_hazard"), "hazard_conflict")
             .when(F.col("conflict"), "numeric_conflict").when(limit.isNull() | F.isnan(limit), "no_value")
             .when(F.coalesce(normalised(p["unit"]) != normalised(F.col("unit")), F.lit(True)), "unit_mismatch")
             .when(value.isNull() | F.isnan(value), "no_value").otherwise("compared"))
    state = F.when(cause != "compared", UNKNOWN).when(unsafe(value, limit, p["direction"]), WARNING).otherwise(SAFE)
    judged = j.withColumn("cause", cause).withColumn("state", state)
    compared = F.col("cause") == "compared"
    bound = F.when(p["direction"] == "max", ", ceiling ").otherwise(", floor ")
    reached = F.when(F.col("state") == WARNING, " reached (").otherwise(" not reached (")
    what = F.concat(F.col("state"), F.lit(": "), F.col("metric_name"), F.lit(" "), value.cast("string"), F.lit(" "), F.col("unit"),
                    bound, limit.cast("string"), F.lit(" "), p["unit"], reached, p["citation"], F.lit(")"))
    why = (F.when(F.col("cause") == "no_thresholds", "no threshold was retrieved for the chemical")
           .when(F.col("cause") == "no_metric", "no retrieved threshold has the metric")
           .when(F.col("cause") == "hazard_conflict", F.concat(F.lit("hazard statements of "), F.col("left_supplier"), F.lit(" and "), F.col("right_supplier"), F.lit(" conflict")))
           .when(F.col("cause") == "numeric_conflict", F.concat(F.col("n_top").cast("string"), F.lit(" sources of equal authority diverge by "), F.format_number("spread_percent", 1), F.lit("%")))
           .when(F.col("cause") == "unit_mismatch", F.concat(F.lit("threshold unit "), p["unit"], F.lit(" cannot be compared with reading unit "), F.coalesce(F.col("unit"), F.lit("none"))))
           .otherwise("the reading has no value"))
    return judged.select(*[F.col(c) for c in readings.columns], "state", "cause", F.when(compared, limit).alias("threshold_value"),
                         F.when(compared, p).alias("provenance"), F.when(compared, what).otherwise(F.concat(F.lit("UNKNOWN: "), why)).alias("reasoning"))


def alerts(verdicts: DataFrame, key: str = "event_id") -> DataFrame:
    """One pending alert for each WARNING, numbered by ``key``."""
    return numbered(verdicts.filter(F.col("state") == WARNING), [key], "alert_no").withColumn("alert_id", F.concat(F.lit("ALT_"), F.when(F.col("alert_no") < 10000, F.lpad(F.col("alert_no").cast("string"), 4, "0")).otherwise(F.col("alert_no").cast("string")))).withColumn("status", F.lit("PENDING_SIGN_OFF"))


def sign_off(alert_queue: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Alerts with their last decision applied, and decisions that name no alert.

    Decisions are rows (alert_id, approved, signed_by, notes, signed_at).
    """
    last = decisions.groupBy("alert_id").agg(F.max_by(F.struct("approved", "signed_by", "notes", "signed_at"), "signed_at").alias("d"))
    done = alert_queue.join(last, "alert_id", "left")
    status = F.when(F.col("d").isNull(), F.col("status")).when(F.col("d.approved"), "APPROVED").otherwise("REJECTED")
    done = done.withColumn("status", status).withColumn("signed_by", F.col("d.signed_by")).withColumn("notes", F.col("d.notes")).withColumn("signed_at", F.col("d.signed_at")).drop("d")
    return done, decisions.join(alert_queue.select("alert_id"), "alert_id", "left_anti")


def evidence(names: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Thresholds of each asked chemical, as evidence only: the state is always UNKNOWN."""
    asked = names.select("chemical").distinct().withColumn("_key", normalised(F.col("chemical")))
    t = thresholds.select(normalised(F.col("chemical")).alias("_key"), F.col("metric_name").alias("parameter"), "value", "unit", F.col("sds_id").alias("source_doc_id"), F.col("citation").alias("version"))
    return asked.join(t, "_key", "left").drop("_key").withColumn("state", F.lit(UNKNOWN))


def narrate(verdicts: DataFrame) -> DataFrame:
    """Add the plain explanation of a verdict that needs no language service."""
    # fixed values: the fallback texts here and below
    return verdicts.withColumn("explanation", F.concat(F.lit("FALLBACK: The safety state is "), F.col("state"), F.lit(". "), F.col("reasoning")))


def safety_card(verdicts: DataFrame, reply: Column | None = None) -> DataFrame:
    """Card fields of each verdict, from a translation service's JSON reply where it has them.

    A reply that is missing or no JSON object leaves the fallback; single fields that it
    lacks are filled from the fallback.  The state is always the verdict's own.
    """
    said = F.from_json(reply if reply is not None else F.lit(None).cast("string"), "map<string,string>", {"mode": "PERMISSIVE"})
    fallback = {
        "chemical_name": F.col("chemical"),
        "reasoning": F.concat(F.lit("[Translation Unavailable] "), F.col("reasoning")),
        "citation": F.coalesce(F.col("provenance.citation"), F.lit("N/A")),
    }
    fields = [F.coalesce(F.try_element_at(said, F.lit(k)), v).alias(k) for k, v in fallback.items()]
    return verdicts.select(*[c for c in verdicts.columns if c not in ("reasoning", "provenance", "chemical_name", "citation")], *fields)
