import random
from datetime import date
from decimal import Decimal

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from auditflow.operators import metrics as m
from auditflow.operators.joins import safe_left_join

SCHEMA = "order_id int, order_date_clean date, customer_id string, channel string, units long, net_sales decimal(18,4), gross_sales decimal(18,4)"


def _facts(spark, rows):
    return spark.createDataFrame(
        [(i, d, c, ch, 1, Decimal(str(n)), Decimal(str(n)) * 2) for i, (d, c, ch, n) in enumerate(rows)], SCHEMA
    )


@pytest.fixture(scope="module")
def facts(spark):
    return _facts(
        spark,
        [
            (date(2026, 3, 1), "A", "web", 100),
            (date(2026, 3, 1), "A", "shop", 50),
            (date(2026, 3, 20), "A", "web", 30),
            (date(2026, 3, 31), "B", None, 20),
            (date(2026, 5, 1), "B", "web", 10),
            (date(2026, 5, 2), None, "phone", 5),
            (date(2026, 5, 2), "", "phone", 5),
            (date(2026, 6, 1), "C", "web", 999),
        ],
    )


def test_summary_and_missing_columns(facts):
    row = m.metric_summary(facts).first()
    assert (row.net_sales, row.gross_sales, row.total_units, row.total_orders, row.total_discounts) == (1219.0, 2438.0, 8, 8, 0.0)
    empty = m.metric_summary(facts.limit(0)).first()
    assert (empty.net_sales, empty.total_orders, empty.avg_order_value) == (0.0, 0, 0.0)


def test_comparison(facts):
    row = m.period_comparison(facts, baseline="2026-03", current="2026-05").first()
    assert (row.baseline_value, row.current_value, row.absolute_change, row.percentage_change) == (200.0, 20.0, -180.0, -90.0)
    none = m.period_comparison(facts, baseline="2025-01", current="2025-02").first()
    assert (none.absolute_change, none.percentage_change) == (0.0, 0.0)


def test_breakdown(facts):
    found = {r.dimension_value: r for r in m.period_breakdown(facts, "channel", baseline="2026-03", current="2026-05").collect()}
    assert set(found) == {"web", "shop", "phone", "Unclassified"}
    assert (found["web"].absolute_change, found["web"].percentage_change) == (-120.0, -92.31)
    assert (found["phone"].baseline_value, found["phone"].percentage_change) == (0.0, 0.0)
    assert found["web"].contribution_to_total_change == 66.67
    assert all(r.total_change == -180.0 and r.is_reconciled for r in found.values())


def test_breakdown_by_absent_dimension(facts):
    row = m.period_breakdown(facts, "region", baseline="2026-03", current="2026-05").collect()
    assert [(r.dimension_value, r.absolute_change) for r in row] == [("Unclassified", -180.0)]


def test_breakdown_shares_its_shuffle(facts):
    df = m.period_breakdown(facts, "channel", baseline="2026-03", current="2026-05")
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in plan and "NestedLoop" not in plan and "Cartesian" not in plan


def test_breakdown_through_key_equals_breakdown_of_the_join(spark, facts, rows):
    dim = spark.createDataFrame([("A", "retail", "x"), ("A", "other", "y"), ("B", "retail", "x"), ("", None, "z")], "customer_id string, segment string, region string")
    periods = {"baseline": "2026-03", "current": "2026-05"}
    names = ["segment", "channel", "region", "campaign"]
    plain = m.period_breakdown(safe_left_join(facts, dim, "customer_id", order_by=["region"]), names, **periods)
    keyed = m.breakdown_through_key(facts, dim, "customer_id", names, order_by=["region"], **periods)
    assert rows(keyed) == rows(plain)
    assert {r.dimension_value for r in keyed.where("dimension = 'segment'").collect()} == {"retail", "Unclassified"}


def test_months_reach_the_scan(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    df = m.period_comparison(orders, baseline="2001-03", current="2001-07", metric="o_totalprice", date_col="o_orderdate")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [Or(And(GreaterThanOrEqual(o_orderdate" in plan
    assert "ReadSchema: struct<o_totalprice:double,o_orderdate:timestamp_ntz>" in plan


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(
        st.tuples(st.sampled_from(["x", "y", "z", None, ""]), st.integers(-10**7, 10**7), st.booleans()), min_size=1, max_size=40
    )
)
def test_parts_add_up_to_the_total(spark, drawn):
    df = _facts(spark, [(date(2026, 3 if b else 5, 7), "A", c, Decimal(n) / 1000) for c, n, b in drawn])
    parts = m.period_breakdown(df, "channel", baseline="2026-03", current="2026-05").collect()
    exact = sum((Decimal(n) / 1000) * (-1 if b else 1) for _, n, b in drawn)
    assert abs(parts[0].total_change - float(exact)) <= 0.005 + 1e-9
    assert all(r.reconciliation_diff == 0.0 for r in parts)
    again = m.period_breakdown(df.repartition(7), "channel", baseline="2026-03", current="2026-05").collect()
    assert sorted(map(repr, parts)) == sorted(map(repr, again))


def test_customer_dynamics(facts):
    day = {r.period: r for r in m.customer_dynamics(facts).collect()}
    assert (day["2026-03"].new_customers_sales, day["2026-03"].recurring_customers_sales) == (170.0, 30.0)
    assert (day["2026-03"].new_customers_orders, day["2026-03"].recurring_customers_orders) == (3, 1)
    # missing and blank customers are never new
    assert (day["2026-05"].new_customers_orders, day["2026-05"].recurring_customers_orders) == (0, 3)
    month = {r.period: r for r in m.customer_dynamics(facts, grain="month").collect()}
    assert (month["2026-03"].new_customers_sales, month["2026-03"].recurring_customers_sales) == (200.0, 0.0)


def test_forecast(facts, spark):
    short = m.forecast_eligibility(facts).first()
    assert (short.periods, short.missing_periods, short.eligible) == (3, 1, False) and "3 months" in short.reason
    assert m.forecast_eligibility(facts, min_periods=3).first().eligible
    assert m.forecast_eligibility(facts.limit(0)).first().periods == 0


def _brute_force(totals):
    whole, out = sum(totals.values()), {}
    for key, value in totals.items():
        cumulative = sum(v for v in totals.values() if v >= value)
        before = sum(v for v in totals.values() if v > value)
        share_before = float(before) / float(whole) * 100 if whole else 0.0
        out[key] = (round(float(cumulative) / float(whole) * 100, 3) if whole else 0.0, "A" if share_before < 80 else "B" if share_before < 95 else "C")
    return out


@pytest.mark.parametrize("salt_over,per_bucket", [(10**6, 200_000), (20, 60), (20, 5)])
def test_concentration_with_ties(spark, salt_over, per_bucket):
    """A third of the keys have the same value."""
    rng = random.Random(1)
    totals = {f"k{i}": Decimal(7) if i % 3 == 0 else Decimal(rng.randrange(1, 5000)) / 4 for i in range(300)}
    df = spark.createDataFrame([(k, v) for k, v in totals.items() for _ in range(1)], "customer_id string, net_sales decimal(18,4)")
    found = m.concentration(df, "customer_id", salt_over=salt_over, per_bucket=per_bucket).collect()
    assert len(found) == len(totals)
    expected = _brute_force(totals)
    for r in found:
        share, abc_class = expected[r.customer_id]
        assert abs(r.cumulative_share - share) < 0.002 and r.abc_class == abc_class


def test_concentration_is_a_prefix_sum_whose_plan_does_not_grow(spark):
    def curve(n, per_bucket):
        df = spark.range(n).selectExpr("concat('c', id) as customer_id", "cast((id * 7919) % 1009 + id / 1000 as decimal(18,4)) as net_sales")
        return m.concentration(df, "customer_id", per_bucket=per_bucket, salt_over=10**9)

    sizes = [len(curve(n, 40)._jdf.queryExecution().optimizedPlan().toString().splitlines()) for n in (50, 4000)]
    assert sizes[0] == sizes[1]
    whole, cut = (sorted(map(tuple, curve(4000, p).collect())) for p in (10**9, 40))
    assert whole == cut


def test_concentration_of_nothing(spark):
    zero = spark.createDataFrame([("a", Decimal(0)), ("b", Decimal(0))], "customer_id string, net_sales decimal(18,4)")
    assert {(r.share, r.cumulative_share) for r in m.concentration(zero, "customer_id").collect()} == {(0.0, 0.0)}
    assert m.concentration(zero.limit(0), "customer_id").count() == 0


def test_pivot_and_slices(facts):
    pivot = {r.period: r for r in m.month_pivot(facts, "channel", ["web", "shop"]).collect()}
    assert (pivot["2026-03"].web, pivot["2026-03"].shop, pivot["2026-05"].shop) == (130.0, 50.0, 0.0)
    extra = facts.withColumn("channel", F.when(F.col("channel") == "shop", "zz").when(F.col("net_sales") > 100, None).otherwise(F.col("channel")))
    months = m.month_pivot(extra, "channel", ["web"]).collect()
    whole = {r.period: r.net_sales for r in m.monthly_trend(facts).collect()}
    assert all(r.web + r.other + r.unclassified == pytest.approx(whole[r.period]) for r in months) and sum(r.other for r in months) > 0
    assert tuple(m.filtered_totals(facts, F.col("channel") == "web").first()) == (1139.0, 4)
    assert m.closed_months(facts, "2026-03", "2026-05").count() == 7


def test_a_lost_or_repeated_row_is_not_reconciled(spark, facts):
    whole = m._two_months(facts, "2026-03", "2026-05", "net_sales", "order_date_clean", [F.col("channel")])
    for joined in (whole.where("channel <> 'shop'"), whole.unionByName(whole.where("channel = 'web'"))):
        rows = m._decompose(joined, ["channel"], "2026-03", "2026-05", "net_sales", before_join=whole).collect()
        assert {r.is_reconciled for r in rows} == {False} and rows[0].reconciliation_diff > 0
    rows = m._decompose(whole, ["channel"], "2026-03", "2026-05", "net_sales", before_join=whole).collect()
    assert {r.is_reconciled for r in rows} == {True}


def test_dates_and_status_reach_the_scans(spark, sf_dir):
    from auditflow.plans import views

    plan = m.metric_summary(views.prepared_sales(spark, sf_dir))._jdf.queryExecution().executedPlan().toString()
    assert "LessThan(o_orderdate," in plan and "EqualNullSafe(l_returnflag,R)" in plan
