from datetime import date

import pytest

from auditflow.operators import profile, quality
from auditflow.records import COLUMN_PROFILE, QUALITY_ISSUE
from tests.conftest import same_fields

ORDERS = [("O1", "001", "2026-05-30", "COMPLETED"), ("O2", "999", "2026-02-30", "CANCELLED"), ("O3", "002", "2026-06-01", "REFUNDED"), ("O3", "", "", "COMPLETED")]
CUSTOMERS = [("001", "A"), ("001", "A2"), ("002", "B"), ("003", "C")]


@pytest.fixture(scope="module")
def tables(spark):
    return {
        "orders": spark.createDataFrame(ORDERS, "order_id string, customer_id string, order_date string, status string"),
        "customers": spark.createDataFrame(CUSTOMERS, "customer_id string, name string"),
    }


def test_audit(tables):
    issues = quality.audit_tables(tables)
    assert same_fields(issues, QUALITY_ISSUE)
    found = {r.id: r for r in issues.collect()}
    assert set(found) == {
        "INVALID_DATE_orders_order_date", "INCOMPLETE_PERIOD_orders_order_date", "RETURNS_CANCELLATIONS_orders",
        "DUP_KEY_customers_customer_id", "LEADING_ZEROS_orders_customer_id", "LEADING_ZEROS_customers_customer_id",
        "ORPHAN_orders_customers_customer_id", "M2M_orders_customers_customer_id",
    }
    assert (found["INVALID_DATE_orders_order_date"].affected_rows, found["INVALID_DATE_orders_order_date"].evidence_samples) == (1, ["2026-02-30"])
    assert found["DUP_KEY_customers_customer_id"].affected_rows == 2 and found["DUP_KEY_customers_customer_id"].evidence_samples == ["001"]
    assert found["RETURNS_CANCELLATIONS_orders"].evidence_samples == ["CANCELLED: 1", "REFUNDED: 1"]
    assert found["ORPHAN_orders_customers_customer_id"].affected_rows == 2  # blank keys count
    assert found["ORPHAN_orders_customers_customer_id"].evidence_samples == ["", "999"]
    assert found["M2M_orders_customers_customer_id"].affected_rows == 1
    assert found["LEADING_ZEROS_orders_customer_id"].affected_percentage == 75.0
    report = quality.quality_report(issues, tables).first()
    assert (report.issue_count, report.has_blocking_issues, report.is_last_period_incomplete) == (8, False, True)
    assert (report.coverage_start, report.coverage_end) == (date(2026, 5, 30), date(2026, 6, 1))


def test_declared_checks(tables):
    found = {r.issue_type for r in quality.audit_tables(tables, declared_checks=True).collect()}
    assert {"missing_values", "granularity_mismatch"} <= found


def test_empty_table_blocks(spark, tables):
    empty = {"orders": tables["orders"].limit(0), "customers": tables["customers"]}
    issues = quality.audit_tables(empty)
    found = {r.id: r for r in issues.collect()}
    assert found["EMPTY_orders"].severity == "blocking" and found["EMPTY_orders"].affected_percentage == 100.0
    assert not any(i.startswith(("INVALID", "INCOMPLETE", "RETURNS")) for i in found)
    assert quality.quality_report(issues, empty).first().has_blocking_issues


def test_profile_types(spark):
    rows = [
        ("1", "1,5", "2026-01-01", "x", "007", "", "10", "2026-01-01"),
        ("2", "2.5", "2026-01-02", "y", "8", "", "20", "nope"),
        ("", "3", "", "x", "9", "", "30", ""),
    ]
    names = ["whole", "decimal", "order_date", "kind", "zeros", "blank", "paid", "mixed"]
    df = spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names))
    profiled = profile.column_profile(df, "t")
    assert same_fields(profiled, COLUMN_PROFILE)
    found = {r.name: r for r in profiled.collect()}
    assert {n: found[n].inferred_type for n in names} == {
        "whole": "integer", "decimal": "float", "order_date": "date", "kind": "string", "zeros": "string",
        "blank": "string", "paid": "string", "mixed": "string",
    }
    roles = {n: found[n].column_role for n in names}
    assert (roles["zeros"], roles["paid"], roles["kind"], roles["blank"]) == ("id", "id", "categorical", "categorical")
    assert (found["whole"].null_count, found["whole"].null_percentage, found["whole"].unique_count) == (1, 33.33, 2)
    assert (found["decimal"].min_num, found["decimal"].max_num, round(found["decimal"].std_dev, 4)) == (1.5, 3.0, 0.7638)
    assert (found["order_date"].min_date, found["order_date"].max_date) == (date(2026, 1, 1), date(2026, 1, 2))
    assert found["kind"].sample_values == ["x", "y"] and found["blank"].sample_values == []
    # the identifier rule can be replaced
    named = {r.name: r for r in profile.column_profile(df, "t", id_columns=["zeros"]).collect()}
    assert named["paid"].inferred_type == "integer"


def test_dates_without_a_date_name_need_more_than_five(spark):
    for n, expected in ((5, "string"), (6, "date")):
        df = spark.createDataFrame([(f"2026-01-0{i + 1}",) for i in range(n)], "moment string")
        assert profile.column_profile(df, "t").first().inferred_type == expected


def test_profile_of_empty_table(spark):
    found = profile.column_profile(spark.createDataFrame([], "a string, b int"), "t").collect()
    assert [(r.name, r.total_count, r.inferred_type) for r in sorted(found)] == [("a", 0, "string"), ("b", 0, "string")]


def test_table_profile(tables):
    profiled = profile.profile_tables(tables, samples=2)
    found = {r.table_id: r for r in profile.table_profile(profiled, tables, sources={"orders": "orders.csv"}).collect()}
    assert (found["orders"].row_count, found["orders"].column_count, found["orders"].source) == (4, 4, "orders.csv")
    assert found["orders"].id_columns == ["customer_id", "order_id"]
    assert found["customers"].row_semantic_meaning.startswith("Customer dimension")


def test_an_audit_reads_a_table_twice_and_once_per_key(spark, sf_dir):
    """One pass for the rows, one for the profile, one for the keys of each side of a link."""
    from auditflow.plans.queries import QUERIES

    plan = QUERIES["quality_issues"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 3 * 2 + 2


def test_checks_of_one_pass_equal_the_single_ones(spark, rows):
    cells = [
        ("O1", "2026-01-10", "COMPLETED", "x"), ("O2", "2026-02-30", "CANCELLED", "y"), ("O3", "", "REFUNDED", None), ("O4", "nope", "CANCELLED", "z"),
        ("O5", "2026-05-01", None, "2026-01-01"), ("O6", "2026-05-02", "SHIPPED", ""), ("O7", None, "CANCELADO", "bad"),
    ]
    full = spark.createDataFrame(cells, "order_id string, order_date string, status string, ship_date string")
    for df in (full, full.where("false"), full.drop("order_date", "ship_date"), full.drop("status"), full.where("order_date = 'nope'")):
        for table_id in ("orders", "customers"):
            single = quality.empty_table(df, table_id)
            dates = [c for c in ("order_date", "ship_date") if c in df.columns]
            parts = [quality.invalid_dates(df, table_id), quality.returns_and_cancellations(df, table_id)]
            if table_id == "orders":
                parts += [quality.incomplete_last_period(df, table_id, column=c) for c in dates]
            for part in parts:
                single = single if part is None else single.unionByName(part)
            assert rows(quality.table_checks(df, table_id)) == rows(single)


def test_a_column_of_few_values_sends_each_once(spark):
    from auditflow.operators.profile import as_cells, smallest_values

    df = spark.range(5000).selectExpr("cast(id % 3 as string) as flag", "cast(id as string) as number", "cast(null as string) as nothing")
    found = {r["name"]: r["sample_values"] for r in smallest_values(as_cells(df), 5).collect()}
    assert found == {"flag": ["0", "1", "2"], "number": ["0", "1", "10", "100", "1000"]}
