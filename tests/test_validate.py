import pytest
from pyspark.sql import functions as F

from auditflow.operators import validate as v


def _status(spark, values, warnings=()):
    figures = spark.createDataFrame([("R", f, x) for f, x in values.items()], "result_id string, field string, value double")
    results = spark.createDataFrame([("R", list(warnings))], "result_id string, warnings array<string>")
    return v.result_statuses(results, v.finite_checks(figures)).first().validation_status


def test_finite(spark):
    assert _status(spark, {"sales": float("nan"), "valid_metric": 100.0}) == "rejected"
    assert _status(spark, {"sales": float("-inf")}) == "rejected"
    assert _status(spark, {"sales": None, "valid_metric": 100.0}) == "approved"
    assert _status(spark, {"sales": 1.0}, ["short history"]) == "approved_with_warnings"


PARTS = "result_id string, metric string, baseline_period string, current_period string, dimension_value string, absolute_change double"
TOTALS = "metric string, baseline_period string, current_period string, absolute_change double"


def test_reconciliation(spark):
    parts = spark.createDataFrame(
        [
            ("R1", "net", "03", "05", "a", -50000.0), ("R1", "net", "03", "05", "b", -20000.0),
            ("R2", "net", "03", "05", "a", -99999.96), ("R2", "net", "03", "05", "b", 0.0),
            ("R3", "units", "03", "05", "a", 3.0), ("R4", "units", "01", "02", "a", 4.0),
        ],
        PARTS,
    )
    totals = spark.createDataFrame([("net", "03", "05", -100000.0), ("units", "03", "05", 3.0)], TOTALS)
    found = {r.result_id: r for r in v.reconcile(parts, totals).collect()}
    assert (found["R1"].difference, found["R1"].is_reconciled) == (30000.0, False)
    assert found["R2"].is_reconciled  # within the tolerance
    assert found["R3"].is_reconciled  # compared with its own metric
    assert found["R4"].is_reconciled and found["R4"].expected_change is None
    checks = {r.result_id: r for r in v.reconciliation_checks(v.reconcile(parts, totals)).collect()}
    assert (checks["R1"].severity, checks["R1"].passed) == ("blocking", False)


def test_self_flagged_result_is_not_reconciled(spark):
    parts = spark.createDataFrame([("R", "net", "03", "05", "a", 1.0)], PARTS).withColumns({"is_reconciled": F.lit(False), "total_change": F.lit(1.0)})
    totals = spark.createDataFrame([], TOTALS)
    assert not v.reconcile(parts, totals).first().is_reconciled


def test_report_status(spark):
    schema = "result_id string, check_name string, passed boolean, severity string, evidence string"
    good, warn, bad = ("R", "a", True, "info", ""), ("R", "b", True, "warning", ""), ("R", "c", False, "blocking", "")
    for checks, status, retry in [([good], "approved", False), ([good, warn], "approved_with_warnings", False), ([bad, warn], "rejected", True)]:
        row = v.report_status(spark.createDataFrame(checks, schema)).first()
        assert (row.overall_status, row.can_retry) == (status, retry)
    assert not v.report_status(spark.createDataFrame([bad], schema), repair_attempt=2).first().can_retry


def test_presentation(spark):
    results = spark.createDataFrame([("r1", "R1", "approved"), ("r1", "R2", "rejected")], "run_id string, result_id string, validation_status string")
    components = spark.createDataFrame(
        [
            ("r1", 1, "card", "R1", "Total Net Change", "03 vs 05", False, None),
            ("r1", 2, "card", "R2", "Peak", "03", False, None),
            ("r1", 3, "chart", "R1", "Waterfall", "03 vs 04", True, 0),
            ("r1", 4, "chart", "R9", "Trend", "all", False, 5),
            ("r2", 5, "card", "R1", "Peak", "03", False, None),
        ],
        "run_id string, component_id int, kind string, result_id string, title string, period string, is_primary boolean, points int",
    )
    checks = v.presentation_checks(components, results, run=["run_id"])
    assert {r.component_id: r.problem for r in checks.collect()} == {
        1: None, 2: "cites a rejected result", 3: "is empty", 4: "cites an unknown result",
        5: "cites an unknown result",
    }
    alignment = v.period_alignment(components, run=["run_id"])
    assert {r.run_id: r.is_aligned for r in alignment.collect()} == {"r1": False, "r2": True}
    status = {r.run_id: r for r in v.presentation_status(checks, alignment, run=["run_id"]).collect()}
    assert (status["r1"].invalid_components, status["r1"].is_dashboard_valid) == (3, False)


def test_plan_gate(spark):
    registry = spark.createDataFrame([("S1",), ("S2",), ("S3",)], "step_id string")
    catalog = spark.createDataFrame([("Net_Sales",), ("channel",)], "column_name string")
    steps = spark.createDataFrame(
        [
            ("p", 1, "S1", ["NET_SALES"]), ("p", 2, "S2", ["non_existent_fake_column_xyz", "channel"]), ("p", 3, "HACK", []),
            ("q", 1, "S1", []), ("q", 2, "S2", None), ("q", 3, "S3", ["channel"]),
        ],
        "plan_id string, step_order int, step_id string, columns array<string>",
    )
    gated = v.plan_gate(steps, registry, catalog)
    assert {(r.plan_id, r.step_order): r.rejection for r in gated.collect()} == {
        ("p", 1): None, ("p", 2): "unknown_column", ("p", 3): "unregistered_step", ("q", 1): None, ("q", 2): None, ("q", 3): None,
    }
    plans = {r.plan_id: (r.valid_steps, r.use_default_plan) for r in v.gated_plans(gated).collect()}
    assert plans == {"p": (1, True), "q": (3, False)}


def test_digest_ignores_order_and_partitioning(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    first = v.table_digest(orders).first()
    assert v.table_digest(orders.repartition(7).orderBy("o_totalprice")).first() == first
    assert v.table_digest(orders.select(*reversed(orders.columns))).first() == first
    changed = orders.withColumn("o_totalprice", F.when(F.col("o_orderkey") == 1, 0.0).otherwise(F.col("o_totalprice")))
    assert v.table_digest(changed).first().digest != first.digest


@pytest.mark.parametrize("second,expected", [([("a", 1)], True), ([("a", 2)], False), ([], False), ([("a", None)], False)])
def test_same_figures(spark, second, expected):
    one = spark.createDataFrame([("a", 1)], "k string, v int")
    other = spark.createDataFrame(second, "k string, v int")
    assert v.same_figures(one, other, keys=["k"], values=["v"]).first().is_same is expected
