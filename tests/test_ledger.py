from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from auditflow.operators import ledger, periods

ORDERS = [
    ("O1", "2026-01-10", "COMPLETED", "10,5"),
    ("O2", "2026-02-30", "CANCELLED", "1"),
    ("O3", "", "COMPLETED", "2"),
    ("O4", "2026-01-11", "REFUNDED", "x"),
    ("O5", "2026-06-02", "COMPLETED", "4"),
    ("O6", "2026-05-31", None, ""),
    ("O7", "2026-05-30", "SHIPPED", "NaN"),
    ("O8", "CORRUPT_DATE", "COMPLETED", "8"),
]


@pytest.fixture(scope="module")
def orders(spark):
    return spark.createDataFrame(ORDERS, "order_id string, order_date string, status string, net_sales string")


def test_split_and_ledger(orders, rows):
    flagged = ledger.flag_exclusions(orders, cutoff=date(2026, 5, 31))
    assert rows(ledger.clean_rows(flagged), "order_id") == [("O1",), ("O6",), ("O7",)]
    assert rows(ledger.keep_usable(orders, cutoff=date(2026, 5, 31)), "order_id") == [("O1",), ("O6",), ("O7",)]
    assert rows(ledger.quarantined_rows(flagged, cutoff="2026-05-31"), "order_id", "exclusion_reason") == [
        ("O2", "Date is missing or not a date"),
        ("O3", "Date is missing or not a date"),
        ("O4", "Status is excluded"),
        ("O5", "After the cutoff (2026-05-31)"),
        ("O8", "Date is missing or not a date"),
    ]
    found = ledger.exclusion_ledger(flagged, cutoff=date(2026, 5, 31)).orderBy("step_index").collect()
    assert [(r.rows_before, r.rows_after, r.rows_excluded) for r in found] == [(8, 5, 3), (5, 4, 1), (4, 3, 1)]
    assert found[0].exclusion_samples[0] == {"order_id": "O2", "order_date": "2026-02-30"}
    assert [len(r.exclusion_samples) for r in found] == [3, 1, 1]
    for record in found:
        assert record.rows_before - record.rows_excluded == record.rows_after


def test_cutoff_step_is_recorded_only_if_it_cut(orders):
    flagged = ledger.flag_exclusions(orders, cutoff=date(2030, 1, 1))
    assert ledger.exclusion_ledger(flagged, cutoff=date(2030, 1, 1)).count() == 2


def test_sample_limit(orders, spark):
    many = orders.unionByName(
        spark.range(50).select(
            F.concat(F.lit("Z"), "id").alias("order_id"), F.lit("bad").alias("order_date"),
            F.lit("COMPLETED").alias("status"), F.lit("1").alias("net_sales"),
        )
    )
    first = ledger.exclusion_ledger(ledger.flag_exclusions(many)).where("step_index = 1").first()
    assert [s["order_id"] for s in first.exclusion_samples] == ["O2", "O3", "O8", "Z0", "Z1"]


def test_late_hours_of_the_cutoff_day_are_kept(spark):
    df = spark.createDataFrame([(1, datetime(2026, 5, 31, 10)), (2, datetime(2026, 6, 1))], "id int, order_date timestamp")
    assert [r.id for r in ledger.keep_usable(df, cutoff=date(2026, 5, 31)).collect()] == [1]


def test_without_status_or_date(spark):
    df = spark.createDataFrame([(1,), (2,)], "id int")
    flagged = ledger.flag_exclusions(df)
    assert ledger.clean_rows(flagged).count() == 2
    assert ledger.exclusion_ledger(flagged).count() == 0
    with pytest.raises(ValueError):
        ledger.amount_cast_counts(df)


def test_amounts(orders):
    counts = ledger.amount_cast_counts(orders).first()
    assert (counts.column, counts.missing_cells, counts.unreadable_cells, counts.non_finite_cells) == ("net_sales", 1, 2, 1)
    total = ledger.with_amounts(orders).agg(F.sum("net_sales")).first()[0]
    assert float(total) == 25.5


def test_non_finite_doubles_are_counted_before_the_cast(spark):
    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (1.0,), (None,)], "net_sales double")
    counts = ledger.amount_cast_counts(df).first()
    assert (counts.missing_cells, counts.non_finite_cells) == (1, 2)
    assert float(ledger.with_amounts(df).agg(F.sum("net_sales")).first()[0]) == 1.0


def test_incomplete_period(spark):
    days = [f"2026-05-{d:02d}" for d in range(1, 32)] + ["2026-06-01", "2026-06-02", "2026-06-02", "2026-06-04", "", "bad"]
    df = spark.createDataFrame([(d,) for d in days], "order_date string")
    last = periods.incomplete_period(df, "order_date").first()
    assert (last.last_month, last.days_recorded, last.days_in_month, last.rows_in_month, last.total_rows) == ("2026-06", 3, 30, 4, 37)
    assert last.is_incomplete and last.cutoff == date(2026, 5, 31)
    assert periods.infer_cutoff(df, "order_date") == date(2026, 5, 31)
    closed = df.where("order_date < '2026-06'")
    assert periods.infer_cutoff(closed, "order_date") == date(2026, 5, 31)
    assert periods.infer_cutoff(df.limit(0), "order_date") is None
    cover = periods.time_coverage(df, "order_date").first()
    assert (cover.coverage_start, cover.coverage_end, cover.dated_rows) == (date(2026, 5, 1), date(2026, 6, 4), 35)


def test_lazy_cutoff(spark, rows):
    df = spark.createDataFrame([("O1", "2026-05-01"), ("O2", "2026-06-01")], "id string, order_date string")
    lazy = periods.incomplete_period(df, "order_date").select("cutoff").scalar()
    assert rows(ledger.keep_usable(df, cutoff=lazy), "id") == [("O1",)]


def test_written_parts_and_figures_come_from_one_pass(spark, orders, rows, tmp_path):
    """One job reads the fact once, stores both parts and counts; figures equal those of separate passes."""
    cutoff = date(2026, 5, 31)
    context, group = spark.sparkContext, "written-in-one-pass"
    source = str(tmp_path / "fact")
    orders.repartition(3).write.parquet(source)
    fact = spark.read.parquet(source)
    context.setJobGroup(group, "write")
    written = ledger.write_with_ledger(fact, str(tmp_path / "out"), cutoff=cutoff)
    jobs = context.statusTracker().getJobIdsForGroup(group)
    context.setLocalProperty("spark.jobGroup.id", None)
    assert len(jobs) == 1
    flagged = ledger.flag_exclusions(fact, cutoff=cutoff)
    assert rows(written.usable) == rows(ledger.clean_rows(flagged))
    assert rows(written.quarantine.select("order_id", "exclusion_reason")) == rows(ledger.quarantined_rows(flagged, cutoff=cutoff), "order_id", "exclusion_reason")
    assert rows(written.ledger) == rows(ledger.exclusion_ledger(flagged, cutoff=cutoff))
    assert rows(written.amount_counts) == rows(ledger.amount_cast_counts(ledger.keep_usable(fact, cutoff=cutoff)))
    # The parts are read without each other and without the fact.
    plan = written.quarantine._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and source not in plan
    assert source not in written.ledger._jdf.queryExecution().toString()


def test_written_without_rows_or_rules(spark, orders, tmp_path):
    none = ledger.write_with_ledger(orders.where("false"), str(tmp_path / "none"), cutoff="2026-05-31")
    assert none.usable.count() == none.quarantine.count() == 0
    assert [(r.rows_before, r.rows_excluded) for r in none.ledger.orderBy("step_index").collect()] == [(0, 0), (0, 0)]
    plain = ledger.write_with_ledger(orders.select("order_id"), str(tmp_path / "plain"))
    assert plain.ledger.count() == 0 and plain.amount_counts is None and plain.usable.count() == len(ORDERS)
