"""Conflicts, reconciliation, verdicts, mining, answers, severity, search, extraction."""

import pytest
from pyspark.sql import functions as F

from tessera.functions.text import domain_tokens, jaccard, stem
from tessera.operators import chat, evidence, metrics, mining, search, severity, verdict
from tessera.sources import tables
from tessera.streaming import monitor


def source(ord, value, *, unit="C", direction="max", supplier=None, authority=1.0, hazards=None, metric="m", chemical="X"):
    return (chemical, ord, metric, value, unit, direction, f"D{ord}", supplier or f"S{ord}", "Section 7", authority, f"cite {ord}", hazards)


def judge(spark, value, *sources, unit="C", metric="m"):
    t = spark.createDataFrame(list(sources), tables.THRESHOLD)
    r = spark.createDataFrame([(1, " x ", "Z", metric, value, unit)], "event_id long, chemical string, zone_id string, metric_name string, current_value double, unit string")
    row = verdict.evaluate(r, t).first()
    return row["state"], row["cause"]


@pytest.mark.parametrize("a,b,want", [(["a", "b", "c"], ["a", "b"], 2 / 3), ([], [], 0.0), (["a"], ["b"], 0.0)])
def test_jaccard(spark, a, b, want):
    got = spark.createDataFrame([(a, b)], "a array<string>, b array<string>").select(jaccard(F.col("a"), F.col("b")).alias("j")).first()["j"]
    assert abs(got - want) < 1e-9


def test_verdicts(spark):
    assert judge(spark, 21.5, source(0, 25.0)) == ("SAFE", "compared")
    assert judge(spark, 26.2, source(0, 25.0)) == ("WARNING", "compared")
    assert judge(spark, 25.0, source(0, 25.0)) == ("WARNING", "compared")
    assert judge(spark, 2.0, source(0, 10.0, direction="min")) == ("WARNING", "compared")
    assert judge(spark, 1.0) == ("UNKNOWN", "no_thresholds")
    assert judge(spark, 1.0, source(0, 10.0), metric="other") == ("UNKNOWN", "no_metric")
    assert judge(spark, 20.0, source(0, 25.0), source(1, 26.0), source(2, 100.0)) == ("UNKNOWN", "numeric_conflict")
    assert judge(spark, 20.0, source(0, 25.0), source(1, 100.0, authority=0.85)) == ("SAFE", "compared")
    assert judge(spark, 20.0, source(0, 25.0), unit="F") == ("UNKNOWN", "unit_mismatch")
    assert judge(spark, 20.0, source(0, 25.0, hazards=["H1", "H2"]), source(1, 25.0, hazards=["H3"])) == ("UNKNOWN", "hazard_conflict")
    assert judge(spark, 20.0, source(0, 25.0, hazards=["H1"]), source(1, 25.0, hazards=[])) == ("SAFE", "compared")
    assert judge(spark, float("nan"), source(0, 25.0)) == ("UNKNOWN", "no_value")
    assert judge(spark, None, source(0, 25.0)) == ("UNKNOWN", "no_value")


def test_reconcile_notes(spark):
    t = spark.createDataFrame([source(0, 30.0, authority=0.85, supplier="B"), source(1, 25.0, supplier="A")], tables.THRESHOLD)
    r = evidence.reconcile(t).first()
    assert r["primary"]["supplier_name"] == "A" and not r["conflict"]
    notes = [n["note"] for n in evidence.audit_notes(t, evidence.reconcile(t)).orderBy("ord").collect()]
    assert notes == ["Superseded secondary source 'B' (score=0.85)", "Selected primary authority 'A' (score=1.0)"]
    t = spark.createDataFrame([source(0, 25.0), source(1, 100.0)], tables.THRESHOLD)
    r = evidence.reconcile(t).first()
    assert r["conflict"] and r["primary"] is None and r["spread_percent"] == 75.0
    named = evidence.conflict_summary(evidence.audit_notes(t, evidence.reconcile(t)))
    assert named.first()["conflict_sources"] == "S0=25.0C, S1=100.0C"


def test_conflict_names_all_sources(spark):
    t = spark.createDataFrame([source(i, 25.0 + i) for i in range(130)], tables.THRESHOLD)
    named = evidence.conflict_summary(evidence.audit_notes(t, evidence.reconcile(t))).first()["conflict_sources"]
    assert named.split(", ") == [f"S{i}={25.0 + i}C" for i in range(130)]


def test_previous_over_ranges(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 5), ("a", 17), ("b", 16), ("a", 40), ("b", 99)], "g string, k long")
    got = {r["k"]: r["previous"] for r in search.previous_of(rows, "g", "k", bucket=10).collect()}
    assert got == {5: 1, 17: 5, 40: 17, 99: 16}


def test_first_hazard_pair(spark):
    t = spark.createDataFrame([source(0, 1.0, hazards=["a"]), source(1, 1.0, hazards=["a"]), source(2, 1.0, hazards=["b"]), source(3, 1.0, hazards=["a"])], tables.THRESHOLD)
    r = evidence.hazard_conflicts(t).first()
    assert (r["left_ord"], r["right_ord"]) == (0, 2)


def test_authority_and_citation(spark):
    df = spark.createDataFrame([("Primary Manufacturer", None), ("Authorized Distributor", None), ("Nobody", None), ("Nobody", 0.9)], "s string, c double")
    assert [r["a"] for r in df.select(evidence.authority(F.col("s"), F.col("c")).alias("a")).collect()] == [1.0, 0.85, 0.40, 0.9]
    bad = spark.createDataFrame([("x", 1.5)], "s string, c double").select(evidence.authority(F.col("s"), F.col("c")).alias("a"))
    with pytest.raises(Exception, match="between 0.0 and 1.0"):
        bad.collect()
    c = evidence.citation(*[F.lit(x) for x in ("Ethanol", "SDS-ETH-101", "Merck", "Section 7", "flash_point")], F.lit(13.0), F.lit("C"))
    assert spark.range(1).select(c.alias("c")).first()["c"] == "[SDS-ETH-101] Section 7 - Merck: Ethanol flash_point threshold = 13.0 C"


def test_alerts_and_sign_off(spark):
    v = spark.createDataFrame([(5, "WARNING"), (3, "SAFE"), (200_007, "WARNING"), (1, "WARNING")], "event_id long, state string")
    a = verdict.alerts(v)
    assert [(r["event_id"], r["alert_id"]) for r in a.orderBy("alert_no").collect()] == [(1, "ALT_0001"), (5, "ALT_0002"), (200_007, "ALT_0003")]
    d = spark.createDataFrame([("ALT_0001", True, "x", "", 1), ("ALT_0001", False, "y", "", 2), ("ALT_0009", True, "x", "", 1)], "alert_id string, approved boolean, signed_by string, notes string, signed_at int")
    done, unknown = verdict.sign_off(a, d)
    assert {r["alert_id"]: (r["status"], r["signed_by"]) for r in done.collect()} == {"ALT_0001": ("REJECTED", "y"), "ALT_0002": ("PENDING_SIGN_OFF", None), "ALT_0003": ("PENDING_SIGN_OFF", None)}
    assert [r["alert_id"] for r in unknown.collect()] == ["ALT_0009"]


def test_evidence_is_unknown(spark):
    rows = verdict.evidence(spark.createDataFrame([("Toluene",), ("nothing",)], "chemical string"), tables.thresholds(spark)).collect()
    assert {r["state"] for r in rows} == {"UNKNOWN"} and sum(r["value"] is not None for r in rows) == 2


def test_mining(spark):
    t = spark.createDataFrame([(["Nitric Acid", "Ethanol"],)] * 3 + [(["Water", "Water"],)], "items array<string>")
    rules = mining.mine(t, 0.2).collect()
    assert {tuple(r["antecedents"]) for r in rules} == {("Ethanol",), ("Nitric Acid",)}
    assert all(r["incompatibility_status"].startswith("REACTIVE") and r["lift"] == 1.3333 and r["support"] == 0.75 for r in rules)
    assert mining.mine(t.limit(0), 0.2).count() == 0


def test_multi_item_consequents(spark):
    t = spark.createDataFrame([(["a", "b", "c"],), (["a", "b", "c"],), (["d"],), (["a"],)], "items array<string>")
    rules = {(tuple(r["antecedents"]), tuple(r["consequents"])) for r in mining.association_rules(mining.frequent_itemsets(t, 0.4)).collect()}
    assert (("a",), ("b", "c")) in rules and (("b", "c"), ("a",)) in rules


@pytest.mark.parametrize("question,part", [("What is the flash point of toluene?", "flash point for toluene"), ("Is acetone flammable?", "status for acetone"), ("max storage temp for xylene", "limit for xylene"), ("max storage temperature for xylene", "limit for xylene"), ("hello", None)])
def test_fast_answers(spark, question, part):
    got = spark.createDataFrame([(question,)], "q string").select(chat.fast_answer(F.col("q")).alias("a")).first()["a"]
    assert got is None if part is None else part.split(" for ")[1] in got


def test_registry(spark):
    r = chat.Registry()
    r.register("n", "numbers", lambda n: spark.range(n))
    r.register("bad", "fails", lambda: 1 / 0)
    assert r.call("n", n=3).count() == 3 and r.call("none") is None and "bad failed" in r.call("bad")


def test_severity(spark):
    model = severity.fit(severity.baseline(spark))
    rows = spark.createDataFrame([(0, 0, 0, 0), (4, 4, 3, 7)], ", ".join(f"{c} int" for c in severity.FEATURES))
    assert [r["severity"] for r in severity.predict(model, rows).collect()] == ["LOW", "CRITICAL"]
    assert [r["confidence"] for r in severity.predict(model, rows).collect()] == [1.0, 1.0]


def test_phrase_and_proximity(spark):
    docs = spark.createDataFrame([(1, "Keep away from heat. away from"), (2, "from away keep heat"), (3, None), (4, "")], "doc_id long, text string")
    p = search.positional_index(docs)
    assert {r["doc_id"]: r["occurrences"] for r in search.phrase_query(p, "away from").collect()} == {1: 2}
    assert {r["doc_id"]: r["distance"] for r in search.proximity_query(p, "keep", "heat", 3).collect()} == {1: 3, 2: 1}
    assert {r["doc_id"] for r in search.proximity_query(p, "keep", "away from", 1).collect()} == {1}
    assert search.parse_proximity("sodium hypochlorite /10 incompatible") == ("sodium hypochlorite", 10, "incompatible")


def test_repeated_phrase_word(spark):
    docs = spark.createDataFrame([(1, "a a b a a a")], "doc_id long, text string")
    assert search.phrase_query(search.positional_index(docs), "a a").first()["occurrences"] == 3


def test_extraction(spark):
    docs = spark.createDataFrame([(1, "CAS 108-88-3 and 108-88-4, H225 at 50 ppm"), (2, None)], "doc_id long, text string")
    found = {(r["kind"], r["value"]) for r in tables.identifiers(docs, ["cas", "hazard", "limit"]).collect()}
    assert found == {("cas", "108-88-3"), ("hazard", "H225"), ("limit", "50 ppm")}
    text = spark.createDataFrame([(1, "x\nSection 1: Name\nfoo\nSECTION 2 - Hazards\nbar")], "doc_id long, text string")
    assert {(r["section"], r["body"].split("\n")[-1]) for r in tables.sections(text).collect()} == {(1, "foo"), (2, "bar")}


def test_tokens_protect_identifiers(spark):
    row = spark.createDataFrame([("1,2-Dichloroethane 108-88-3 H225 chlorates chloride",)], "t string")
    got = row.select(domain_tokens(F.col("t")).alias("w")).first()["w"]
    assert got == ["1,2-dichloroethane", "108-88-3", "h225", "chlorates", "chloride"]
    stems = spark.createDataFrame([("chlorates",), ("chloride",), ("heating",), ("gas",)], "w string").select(stem(F.col("w")).alias("s")).collect()
    assert [r["s"] for r in stems] == ["chlorat", "chloride", "heat", "gas"] or stems[0]["s"] != stems[1]["s"]


def test_metrics(spark):
    rows = spark.createDataFrame([("wildcard", [], []), ("wildcard", ["a"], ["b"]), ("exact", ["a"], ["a", "b"])], "category string, predicted array<string>, expected array<string>")
    got = {r["category"]: r for r in metrics.evaluate_sets(rows).collect()}
    assert got["wildcard"]["pass_rate"] == 0.5 and got["exact"]["recall"] == 0.5 and got["exact"]["pass_rate"] == 1.0
    ranked = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (1, 12, 3)], "item_id long, doc_id long, rank int")
    relevant = spark.createDataFrame([(1, 11), (1, 12), (1, 99), (1, 98)], "item_id long, doc_id long")
    m = metrics.ranked_metrics(ranked, relevant).first()
    assert m["precision_at"] == 0.4 and m["recall_at"] == 0.5 and abs(m["average_precision"] - (1 / 2 + 2 / 3) / 4) < 1e-9


def test_readings_out_of_range_are_set_aside(spark):
    r = spark.createDataFrame([("Z", 20.0, 50.0), ("Z", 90.0, 50.0), ("Z", None, 50.0), ("Z", float("nan"), 1.0)], "zone_id string, temperature_celsius double, humidity_percent double")
    ok, rest = tables.validated(r)
    assert ok.count() == 1 and rest.count() == 3


def test_stream_equals_batch(spark, tmp_path):
    stream = monitor.excursions(monitor.event_stream(spark, "/root/testdata/sf0.001/events.parque[t]"), spark.createDataFrame([("click", 30.0, "max")], "event_type string, bound double, direction string"))
    got = monitor.run_available(stream, f"file://{tmp_path}", "append").count()
    batch = spark.read.parquet("/root/testdata/sf0.001/events.parquet").filter("event_type = 'click' and value >= 30").count()
    assert got == batch


def test_versions(spark):
    rows = spark.createDataFrame([("a", 1, 10.0), ("a", 2, 20.0), ("b", 1, 5.0)], "k string, d int, v double")
    got = {r["k"]: (r["v"], r["n_versions"], r["version_conflict"]) for r in evidence.current_versions(rows, ["k"], "d", "v", ["v"]).collect()}
    assert got == {"a": (20.0, 2, True), "b": (5.0, 1, False)}


def test_cards_keep_the_state(spark):
    t = spark.createDataFrame([source(0, 25.0)], tables.THRESHOLD)
    r = spark.createDataFrame([(1, "X", "Z", "m", 30.0, "C", '{"state": "SAFE", "reasoning": "R"}'), (2, "X", "Z", "m", 30.0, "C", "[1]"), (3, "Y", "Z", "m", 1.0, "C", None)],
                              "event_id long, chemical string, zone_id string, metric_name string, current_value double, unit string, reply string")
    v = verdict.evaluate(r, t)
    cards = {c["event_id"]: c for c in verdict.safety_card(v, F.col("reply")).collect()}
    assert cards[1]["state"] == "WARNING" and cards[1]["reasoning"] == "R" and cards[1]["citation"] == "cite 0"
    assert cards[2]["reasoning"].startswith("[Translation Unavailable] WARNING") and cards[3]["citation"] == "N/A" and cards[3]["state"] == "UNKNOWN"
    assert verdict.narrate(v).filter("event_id = 1").first()["explanation"].startswith("FALLBACK: The safety state is WARNING. WARNING:")
