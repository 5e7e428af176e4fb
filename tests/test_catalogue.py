"""Every driver query against its SQL twin."""

import pytest
from oracle import differences

from tessera.plans import catalogue

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_equals_sql(spark, name):
    assert differences(spark, catalogue.queries()[name], catalogue.oracle_sql()[name], DATA) is None


def test_severity_query(spark):
    df = catalogue.queries()["severity_predictions"](spark, DATA)
    assert {r["severity"] for r in df.select("severity").distinct().collect()} <= {"LOW", "MEDIUM", "HIGH", "CRITICAL"}


def test_cascade_has_no_cartesian_product(spark):
    plan = catalogue.queries()["tolerant_cascade"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_entry_imports_without_pipeline():
    import __spark_entry__ as e

    assert "edit_distance_match" in e.queries()
    assert set(e.oracle_sql()) <= set(e.queries())
