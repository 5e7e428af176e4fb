"""How much of the thresholds verdicts take in, and how often authority deals them out."""

from tessera.operators import evidence, verdict
from tessera.plans import catalogue

DATA = "/root/testdata/sf0.001"


def test_verdicts_take_in_what_readings_name(spark, monkeypatch):
    seen, real = [], verdict.evaluate
    monkeypatch.setattr(verdict, "evaluate", lambda r, t, **o: seen.append(t) or real(r, t, **o))
    for name in ("safety_verdict", "confusion_matrix"):
        catalogue.queries()[name](spark, DATA)
    named = catalogue._readings(spark, DATA).select("chemical").distinct()
    every = catalogue._sources(spark, DATA).join(named, "chemical", "left_semi").count()
    for t in seen:
        assert t.join(named, "chemical", "left_anti").count() == 0
        assert t.count() == every > 0


def test_sources_are_dealt_out_once(spark):
    rows = [("c", i, "click", float(i), "C", f"s{i}", 1.0 if i % 2 else 0.5) for i in range(40)]
    src = spark.createDataFrame(rows, "chemical string, ord long, metric_name string, value double, unit string, supplier_name string, authority_score double")
    rec = evidence.reconcile(src)
    plan = rec._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    (r,) = rec.collect()
    assert (r["n_sources"], r["n_top"], r["conflict"]) == (40, 20, True)
    notes = evidence.audit_notes(src, rec)
    assert notes.count() == 20
    notes.collect()
    final = notes._jdf.queryExecution().executedPlan().toString()
    assert final.count("ReusedExchange") >= 1
