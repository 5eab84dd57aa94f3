"""A whole run over the generated fixture, against its truth."""

import json

import pytest
from pyspark.sql import functions as F

from auditflow.operators import runlog, validate
from auditflow.operators.joins import Link
from auditflow.plans import methods
from auditflow.plans.audit import run_audit
from auditflow.session import durable
from auditflow.sources import fixture
from auditflow.sources.manifest import file_changes


@pytest.fixture(scope="module")
def tables(spark):
    return {
        "orders": fixture.orders(spark, draws=2500).cache(),
        "customers": fixture.customers(spark),
        "products": fixture.products(spark),
        "categories": fixture.categories(spark),
    }


@pytest.fixture(scope="module")
def run(spark, tables):
    links = [
        Link("customer_id", "customers", "customer_id"),
        Link("product_id", "products", "product_id"),
        Link("category_id", "categories", "category_id"),
    ]
    return run_audit(spark, tables, baseline="2026-03", current="2026-05", links=links, keep_analytical=True)


def test_no_row_is_lost_or_repeated(run, tables):
    everything = run.ledger.orderBy("step_index").collect()
    steps = [s for s in everything if s.operation != "safe_left_join"]
    made = everything[len(steps):]
    assert [s.transformation_id for s in made] == ["TRF_JOIN_CUSTOMERS", "TRF_JOIN_PRODUCTS", "TRF_JOIN_CATEGORIES"]
    assert {(s.rows_before, s.rows_after) for s in made} == {(steps[-1].rows_after, steps[-1].rows_after)}
    assert [s.parameters["duplicates_removed"] for s in made] == ["1", "0", "0"]
    assert [s.operation for s in steps] == ["filter_invalid_dates", "filter_completed_orders", "filter_date_range"]
    assert steps[0].rows_before == tables["orders"].count() and steps[0].rows_excluded == 2
    assert run.analytical.count() == steps[-1].rows_after
    assert run.quarantine.count() == sum(s.rows_excluded for s in steps)
    assert {"segment", "region", "category_name", "department"} <= set(run.analytical.columns)


def test_figures_match_the_truth(run, tables):
    truth = fixture.truth(tables["orders"]).where("period = '2026-05'").agg(F.sum("net_sales")).first()[0]
    trend = {r.period: r.net_sales for r in run.results["RES_OP_02_TIME_AGGREGATION"].collect()}
    assert list(trend) == ["2026-01", "2026-02", "2026-03", "2026-04", "2026-05"]
    assert trend["2026-05"] == pytest.approx(truth)
    # orphans stay in the figures: five orders of 9,000 in March
    march = fixture.truth(tables["orders"]).where("period = '2026-03'").agg(F.sum("net_sales")).first()[0]
    assert trend["2026-03"] == pytest.approx(march + 45000)
    top = run.findings.where("id = 'FINDING_TOP_CHANNEL'").first()
    assert fixture.WHOLESALE in top.claim and top.result_id == "RES_OP_04_DIMENSION_BREAKDOWN_CHANNEL"


def test_joins_are_safe(run):
    checks = {r.right_table: r for r in run.join_checks.collect()}
    assert all(r.is_safe and r.multiplication_factor == 1.0 for r in checks.values())
    assert checks["customers"].orphans_left == 5 and checks["products"].orphans_left == 3


def test_validation(run):
    status = {r.result_id: r.validation_status for r in run.result_records.collect()}
    assert status["RES_OP_07_BASELINE_FORECAST_EVAL"] == "approved_with_warnings"
    assert {v for k, v in status.items() if "FORECAST" not in k} == {"approved"}
    assert run.report_status.first().overall_status == "approved_with_warnings"
    assert {r.passed for r in run.checks.collect()} == {True}
    assert run.cards.count() == 5 and run.charts.select("chart_id").distinct().count() == 4
    assert run.dashboard.first().is_dashboard_valid and run.dashboard_checks.count() == 9
    assert {r.chart_id: r.is_primary_objective for r in run.chart_records.collect()}["CHART_CHANNEL"]
    parents = {r.node_id: r.parent_id for r in run.provenance.collect()}
    assert parents["TRF_01_CLEAN_DATES"] == "orders" and parents["TRF_JOIN_CUSTOMERS"] == "TRF_03_CUTOFF_INCOMPLETE_PERIOD"
    assert parents["TRF_JOIN_PRODUCTS"] == "TRF_JOIN_CUSTOMERS" and parents["RES_OP_03_PERIOD_COMPARISON"] == "TRF_JOIN_CATEGORIES"


def test_an_infinite_stored_amount_rejects_all_results(spark, tables):
    orders = tables["orders"].withColumn("net_sales", F.when(F.monotonically_increasing_id() == 0, "Infinity").otherwise(F.col("net_sales").cast("string")))
    orders = orders.withColumn("order_date", F.lit("2026-03-10"))
    bad = run_audit(spark, {"orders": orders}, baseline="2026-03", current="2026-05", links=[], dimensions=("channel",), cutoff="2026-05-31", samples=0)
    assert {r.validation_status for r in bad.result_records.collect()} == {"rejected"}
    assert bad.report_status.first().overall_status == "rejected"
    assert bad.cards.count() == bad.charts.count() == bad.findings.count() == 0


def test_a_run_has_events_like_any_log(run):
    events = durable(run.events("R-1", at=F.lit("2026-06-01 10:00:00").cast("timestamp"), first_event=100))
    rows = events.orderBy("event_id").collect()
    assert [r.stage for r in rows] == [
        "UPLOADED", "PROFILED", "PLAN_READY", "PREPARING", "ANALYZING", "VALIDATING", "VALIDATED", "BUILDING_DASHBOARD", "READY"
    ]
    assert [r.event_id for r in rows] == sorted({r.event_id for r in rows}) and rows[0].event_id == 100
    excluded = json.loads(rows[3].metadata_json)["rows_excluded"]
    assert excluded == run.quarantine.count() and json.loads(rows[-1].metadata_json) == {"is_dashboard_valid": True}
    assert runlog.transition_violations(events).count() == 0
    status = runlog.run_status(events).first()
    assert (status.status, status.repair_attempts, status.events) == ("READY", 0, 9)


def test_a_changed_file_rejects_the_run(spark, tables):
    def files(*pairs):
        return spark.createDataFrame(pairs, "path string, sha256 string")

    before = files(("orders.csv", "a"), ("customers.csv", "b"))
    results = spark.createDataFrame([("RES_1",), ("RES_2",)], "result_id string")
    states = [
        (files(("orders.csv", "a"), ("customers.csv", "b"), ("products.csv", "c")), 0),
        (files(("orders.csv", "a"), ("customers.csv", "x")), 1),
        (files(("orders.csv", "a")), 1),
        (files(("other.csv", "a")), 2),
    ]
    for now, altered in states:
        checks = validate.source_file_checks(results, file_changes(now, before)).collect()
        assert [(r.passed, r.evidence.split()[0]) for r in checks] == [(altered == 0, str(altered))] * 2
    bad = run_audit(
        spark, {"orders": tables["orders"]}, baseline="2026-03", current="2026-05", links=[], dimensions=("channel",),
        cutoff="2026-05-31", samples=0, keep_analytical=True, files=states[1][0], files_before=before,
    )
    assert {r.path: r.state for r in bad.file_changes.collect()} == {"orders.csv": "unchanged", "customers.csv": "changed"}
    assert {r.validation_status for r in bad.result_records.collect()} == {"rejected"}
    events = bad.events("R-2").withColumn("failure_reason", F.when(F.col("stage") == "FAILED", F.col("message")))
    events = durable(events)
    assert [r.stage for r in events.orderBy("event_id").collect()][-2:] == ["VALIDATING", "FAILED"]
    assert runlog.transition_violations(events).count() == runlog.misleading_failures(runlog.run_status(events)).count() == 0


def test_plan_keeps_what_is_admissible(spark):
    default = methods.default_plan("2026-03", "2026-05")
    proposed = [*default[:4], methods.Step("X", "no_such_method"), methods.Step("Y", "metric_summary", {"metric": "no_column"})]
    kept = methods.admitted(proposed, ["net_sales", "order_date_clean", "channel"], default)
    assert [s.step_id for s in kept] == [s.step_id for s in default[:4]]
    assert methods.admitted(proposed[4:], ["net_sales"], default) == default


def test_quality(run):
    kinds = {r.issue_type for r in run.issues.collect()}
    assert {"invalid_date", "incomplete_period", "duplicate_keys", "orphan_records", "many_to_many", "returns_cancellations"} <= kinds
    assert run.relationships.count() == 3
    assert run.quality_report.first().is_last_period_incomplete


def test_links_are_found_by_name(spark, tables):
    found = run_audit(spark, {k: tables[k] for k in ("orders", "customers")}, baseline="2026-03", current="2026-05", cutoff="2026-05-31", samples=0)
    assert "segment" in found.analytical.columns


def test_plans(spark):
    with pytest.raises(ValueError):
        methods.method("no_such_method")
    with pytest.raises(ValueError):
        methods.run_plan(spark.range(1), [methods.Step("B", "metric_summary", depends_on=("A",))])
    methods.register("row_count", lambda df: df.groupBy().count())
    done = methods.run_plan(spark.range(3), [methods.Step("N", "row_count")])
    assert done["RES_N"].first()[0] == 3
