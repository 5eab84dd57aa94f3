"""Registered metrics over a prepared fact.

Amounts are summed as decimals, so totals do not depend on partitioning and
parts add up to their total exactly. They become doubles in the last projection.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window, functions as F

from auditflow.functions.parsing import (
    as_amount,
    in_month,
    is_missing,
    known_member,
    month_key,
    month_start,
    next_month_start,
    percent,
    ratio,
    round_amount,
)
from auditflow.operators.joins import safe_left_join, salted_lookup
from auditflow.operators.ledger import CLEAN_DATE
from auditflow.records import MONEY, UNKNOWN_MEMBER
from auditflow.session import durable

RECONCILED_BELOW = 0.01
FORECAST_MIN_PERIODS = 12
PIVOT_OTHER, PIVOT_UNKNOWN = "other", "unclassified"


def _amount_or_zero(df: DataFrame, name: str) -> Column:
    return as_amount(df, name) if name in df.columns else F.lit(0).cast(MONEY.simpleString())


def _zero_if_null(c: Column) -> Column:
    return F.coalesce(c, F.lit(0).cast(MONEY.simpleString()))


def _month(date_col: str) -> Column:
    return F.trunc(F.col(date_col).cast("date"), "MM")


def metric_summary(df: DataFrame) -> DataFrame:
    """Totals of the prepared fact in one row; an absent column counts as 0."""
    sums = df.agg(
        *[
            _zero_if_null(F.sum(_amount_or_zero(df, name))).alias(name)
            for name in ("net_sales", "gross_sales", "units", "discount_amount")
        ],
        F.count(F.lit(1)).alias("total_orders"),
    )
    return sums.select(
        round_amount(F.col("net_sales")).alias("net_sales"),
        round_amount(F.col("gross_sales")).alias("gross_sales"),
        F.col("units").cast("long").alias("total_units"),
        F.col("total_orders"),
        round_amount(F.col("discount_amount")).alias("total_discounts"),
        ratio(F.col("net_sales"), F.greatest(F.col("total_orders"), F.lit(1))).alias("avg_order_value"),
    )


def _monthly_sums(df: DataFrame, date_col: str) -> DataFrame:
    return df.groupBy(_month(date_col).alias("month")).agg(
        F.sum(_amount_or_zero(df, "net_sales")).alias("net_sales"),
        F.sum(_amount_or_zero(df, "gross_sales")).alias("gross_sales"),
        F.sum(_amount_or_zero(df, "units")).alias("units"),
        F.count(F.lit(1)).alias("order_count"),
    )


def monthly_trend(df: DataFrame, *, date_col: str = CLEAN_DATE) -> DataFrame:
    """Sales, units, orders and mean order value per month, in month order."""
    return (
        _monthly_sums(df, date_col)
        .select(
            month_key(F.col("month")).alias("period"),
            round_amount(F.col("net_sales")).alias("net_sales"),
            round_amount(F.col("gross_sales")).alias("gross_sales"),
            F.col("units").cast("long").alias("units"),
            F.col("order_count"),
            ratio(F.col("net_sales"), F.col("order_count")).alias("avg_order_value"),
        )
        .orderBy("period")
    )


def _two_months(
    df: DataFrame, baseline: str, current: str, metric: str, date_col: str, keep: Sequence[Column]
) -> DataFrame:
    """Rows of the two months only, the metric split into a column for each."""
    in_baseline, in_current = in_month(df, date_col, baseline), in_month(df, date_col, current)
    amount = as_amount(df, metric)
    zero = F.lit(0).cast(MONEY.simpleString())
    return df.where(in_baseline | in_current).select(
        *keep,
        F.when(in_baseline, amount).otherwise(zero).alias("baseline"),
        F.when(in_current, amount).otherwise(zero).alias("current"),
    )


def period_comparison(
    df: DataFrame, *, baseline: str, current: str, metric: str = "net_sales", date_col: str = CLEAN_DATE
) -> DataFrame:
    """Change of a metric between two months, on amounts rounded to cents."""
    sums = _two_months(df, baseline, current, metric, date_col, []).agg(
        F.round(_zero_if_null(F.sum("baseline")), 2).alias("baseline"),
        F.round(_zero_if_null(F.sum("current")), 2).alias("current"),
    )
    change = F.col("current") - F.col("baseline")
    return sums.select(
        F.lit(metric).alias("metric"),
        F.lit(baseline).alias("baseline_period"),
        F.lit(current).alias("current_period"),
        F.col("baseline").cast("double").alias("baseline_value"),
        F.col("current").cast("double").alias("current_value"),
        change.cast("double").alias("absolute_change"),
        percent(change, F.col("baseline")).alias("percentage_change"),
    )


def _member(df: DataFrame, dimension: str) -> Column:
    return known_member(F.col(f"`{dimension}`")) if dimension in df.columns else F.lit(UNKNOWN_MEMBER)


def period_breakdown(
    df: DataFrame,
    dimensions: str | Sequence[str],
    *,
    baseline: str,
    current: str,
    metric: str = "net_sales",
    date_col: str = CLEAN_DATE,
) -> DataFrame:
    """Additive decomposition of a metric's change by the members of each dimension.

    One aggregate covers both months and all dimensions. A dimension which the
    table lacks has one member, ``Unclassified``.
    """
    names = [dimensions] if isinstance(dimensions, str) else list(dimensions)
    present = [F.col(f"`{n}`") for n in names if n in df.columns]
    return _decompose(_two_months(df, baseline, current, metric, date_col, present), names, baseline, current, metric)


def breakdown_through_key(
    fact: DataFrame,
    dim: DataFrame,
    key: str,
    dimensions: str | Sequence[str],
    *,
    baseline: str,
    current: str,
    metric: str = "net_sales",
    date_col: str = CLEAN_DATE,
    order_by: Sequence[str] | None = None,
) -> DataFrame:
    """``period_breakdown`` of the fact safely joined to ``dim``, without joining its rows.

    The fact is summed per key before it is shuffled, and the join is between one
    row per key on either side. A key with a large share of all rows is one row by
    then. Dimensions may also be columns of the fact itself.
    """
    names = [dimensions] if isinstance(dimensions, str) else list(dimensions)
    own = [n for n in names if n in fact.columns]
    brought = [n for n in names if n not in own and n in dim.columns]
    grouping = [key, *[n for n in own if n != key]]
    per_key = (
        _two_months(fact, baseline, current, metric, date_col, [F.col(f"`{n}`") for n in grouping])
        .groupBy(*grouping)
        .agg(F.sum("baseline").alias("baseline"), F.sum("current").alias("current"))
    )
    attributes = dim.select(*dict.fromkeys([key, *brought, *(order_by or [])]))
    joined = safe_left_join(per_key, attributes, key, order_by=order_by)
    return _decompose(joined, names, baseline, current, metric, before_join=per_key)


def _decompose(
    df: DataFrame, names: Sequence[str], baseline: str, current: str, metric: str, before_join: DataFrame | None = None
) -> DataFrame:
    """Breakdown of rows that hold a ``baseline`` and a ``current`` amount.

    The total comes from the amounts as they were before any join (``before_join``)
    or before rows are spread over members; what the members of a dimension add up
    to is one row per dimension, joined back and compared with it.
    """
    whole = (df if before_join is None else before_join).agg(
        _zero_if_null(F.sum("baseline")).alias("baseline"), _zero_if_null(F.sum("current")).alias("current")
    )
    total = whole.select(F.struct("baseline", "current")).scalar()
    members = [F.struct(F.lit(n).alias("dimension"), _member(df, n).alias("dimension_value")) for n in names]
    sums = (
        df.select(F.inline(F.array(*members)), "baseline", "current")
        .groupBy("dimension", "dimension_value")
        .agg(F.sum("baseline").alias("baseline"), F.sum("current").alias("current"))
    )
    added_up = sums.groupBy("dimension").agg(F.sum(F.col("current") - F.col("baseline")).alias("sum_of_changes"))
    added_up = added_up.withColumns({"total_baseline": total["baseline"], "total_current": total["current"]})
    change = F.col("current") - F.col("baseline")
    total_change = F.col("total_current") - F.col("total_baseline")
    difference = F.abs(total_change - F.col("sum_of_changes"))
    return sums.join(F.broadcast(added_up), "dimension").select(
        "dimension",
        "dimension_value",
        F.lit(metric).alias("metric"),
        F.lit(baseline).alias("baseline_period"),
        F.lit(current).alias("current_period"),
        round_amount(F.col("baseline")).alias("baseline_value"),
        round_amount(F.col("current")).alias("current_value"),
        round_amount(change).alias("absolute_change"),
        percent(change, F.col("baseline")).alias("percentage_change"),
        percent(change, total_change).alias("contribution_to_total_change"),
        round_amount(F.col("total_baseline")).alias("total_baseline"),
        round_amount(F.col("total_current")).alias("total_current"),
        round_amount(total_change).alias("total_change"),
        percent(total_change, F.col("total_baseline")).alias("total_percentage_change"),
        round_amount(difference, 4).alias("reconciliation_diff"),
        (difference < RECONCILED_BELOW).alias("is_reconciled"),
    )


def customer_dynamics(
    df: DataFrame, *, grain: str = "day", customer_col: str = "customer_id", date_col: str = CLEAN_DATE
) -> DataFrame:
    """Monthly sales and orders of new and recurring customers.

    A row is new if it falls on the first day (or, with ``grain='month'``, in the
    first month) of its customer. Rows without a customer are recurring. Sales are
    reduced to one row per customer and day before the window, so even a customer
    with a large share of all rows is a short group.
    """
    unit = F.col(date_col).cast("date") if grain == "day" else _month(date_col)
    customer = F.col(f"`{customer_col}`")
    per_unit = df.groupBy(customer.alias("customer"), unit.alias("unit")).agg(
        F.sum(_amount_or_zero(df, "net_sales")).alias("sales"), F.count(F.lit(1)).alias("orders")
    )
    first = F.min("unit").over(Window.partitionBy("customer"))
    anonymous = is_missing(F.col("customer").cast("string"))
    flagged = per_unit.withColumn("is_new", F.coalesce((F.col("unit") == first) & ~anonymous, F.lit(False)))
    is_new = F.col("is_new")
    zero = F.lit(0).cast(MONEY.simpleString())
    monthly = flagged.groupBy(F.trunc("unit", "MM").alias("month")).agg(
        F.sum(F.when(is_new, F.col("sales")).otherwise(zero)).alias("new_sales"),
        F.sum(F.when(is_new, zero).otherwise(F.col("sales"))).alias("recurring_sales"),
        F.sum(F.when(is_new, F.col("orders")).otherwise(0)).alias("new_customers_orders"),
        F.sum(F.when(is_new, 0).otherwise(F.col("orders"))).alias("recurring_customers_orders"),
        F.sum("sales").alias("total_sales"),
    )
    return monthly.select(
        month_key(F.col("month")).alias("period"),
        round_amount(F.col("new_sales")).alias("new_customers_sales"),
        round_amount(F.col("recurring_sales")).alias("recurring_customers_sales"),
        "new_customers_orders",
        "recurring_customers_orders",
        round_amount(F.col("total_sales")).alias("total_sales"),
    ).orderBy("period")


def forecast_eligibility(
    df: DataFrame, *, min_periods: int = FORECAST_MIN_PERIODS, date_col: str = CLEAN_DATE
) -> DataFrame:
    """Whether the history has enough months to forecast, and how many are missing inside it."""
    months = df.where(F.col(date_col).isNotNull()).select(_month(date_col).alias("month")).distinct()
    span = F.months_between(F.max("month"), F.min("month")).cast("long") + 1
    row = months.agg(
        F.count("month").alias("periods"),
        month_key(F.min("month")).alias("first_period"),
        month_key(F.max("month")).alias("last_period"),
        F.coalesce(span - F.count("month"), F.lit(0).cast("long")).alias("missing_periods"),
    )
    eligible = F.col("periods") >= min_periods
    reason = F.concat(
        F.lit("History has "), F.col("periods").cast("string"), F.lit(f" months; a forecast needs {min_periods}.")
    )
    return row.withColumn("eligible", eligible).withColumn("reason", F.when(~eligible, reason))


def _ranged(values: DataFrame, per_range: int) -> DataFrame:
    """``values`` (distinct ``value``) with the number of their ``bucket``: ranges from the largest value down.

    Spark cuts the ranges by a sample of the values, about ``per_range`` in each. The numbers are
    those of the partitions, stored once in the shared checkpoint folder, so every branch and every
    retry sees the same ones. One job counts the values.
    """
    ranges = max(1, -(-values.count() // per_range))
    parted = values.repartitionByRange(ranges, F.desc("value"))
    return durable(parted.withColumn("bucket", F.spark_partition_id()))


def concentration(
    df: DataFrame,
    key: str,
    *,
    metric: str = "net_sales",
    a_share: float = 80.0,
    b_share: float = 95.0,
    per_bucket: int = 200_000,
    salt_over: int = 1_000_000,
) -> DataFrame:
    """Share and cumulative share of each key, largest first, with its ABC class.

    Keys of equal value share a cumulative figure. A key is in class A while the
    keys before it hold less than ``a_share`` percent of the total, in B below
    ``b_share``, else in C.

    A running total over all keys would be one task. It is a prefix sum over ranges
    instead: distinct values are parted into ranges of about ``per_bucket``, each range
    is summed up, the sums before a range are its offset, and each runs its own total on
    top of that. Ties are one row at that stage, so they cannot fill a range. The plan
    has the same size for any number of values. The sums per key and the ranges are
    computed into the shared checkpoint folder when this is called.
    """
    per_key = durable(df.groupBy(F.col(f"`{key}`").alias("key")).agg(F.sum(as_amount(df, metric)).alias("value")))
    values = per_key.groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    weighted = _ranged(values, per_bucket).withColumn("amount", (F.col("value") * F.col("n")).cast("decimal(38,4)"))

    # One row per bucket from here to `offsets`, so these windows are short.
    bucket_totals = weighted.groupBy("bucket").agg(F.sum("amount").alias("amount"))
    everything = Window.partitionBy(F.lit(0))
    offsets = bucket_totals.select(
        "bucket",
        F.sum("amount").over(everything).alias("total"),
        F.coalesce(
            F.sum("amount").over(everything.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("before_bucket"),
    )
    in_bucket = Window.partitionBy("bucket").orderBy(F.desc("value")).rowsBetween(Window.unboundedPreceding, 0)
    running = (
        weighted.withColumn("running", F.sum("amount").over(in_bucket))
        .join(F.broadcast(offsets), "bucket")
        .select(
            "value",
            "total",
            (F.col("before_bucket") + F.col("running")).alias("cumulative"),
            (F.col("before_bucket") + F.col("running") - F.col("amount")).alias("before"),
        )
    )
    ranked = salted_lookup(per_key, running, ["value"], salt_over=salt_over, fact_counts=values)
    share_before = F.when(F.col("total") != 0, F.col("before").cast("double") / F.col("total").cast("double") * 100).otherwise(0.0)
    return ranked.select(
        F.col("key").alias(key),
        round_amount(F.col("value")).alias("value"),
        percent(F.col("value"), F.col("total"), 4).alias("share"),
        percent(F.col("cumulative"), F.col("total"), 4).alias("cumulative_share"),
        F.when(share_before < a_share, "A").when(share_before < b_share, "B").otherwise("C").alias("abc_class"),
    )


def month_pivot(
    df: DataFrame, dimension: str, values: Sequence[str], *, metric: str = "net_sales", date_col: str = CLEAN_DATE
) -> DataFrame:
    """Months as rows and the given members as columns; the columns add up to the month.

    ``other`` holds all members that are not given, ``unclassified`` missing ones.
    """
    member = F.col(f"`{dimension}`").cast("string")
    group = (
        F.when(member.isin(*values), member).when(is_missing(member), F.lit(PIVOT_UNKNOWN)).otherwise(F.lit(PIVOT_OTHER))
    )
    columns = [*values, PIVOT_OTHER, PIVOT_UNKNOWN]
    pivoted = (
        df.withColumns({"_month": _month(date_col), "_member": group, "_amount": as_amount(df, metric)})
        .groupBy("_month")
        .pivot("_member", columns)
        .agg(F.sum("_amount"))
    )
    return pivoted.select(
        month_key(F.col("_month")).alias("period"),
        *[round_amount(_zero_if_null(F.col(f"`{v}`"))).alias(v) for v in columns],
    ).orderBy("period")


def counted_rows(weight: str | None) -> Column:
    """Row count, or the sum of ``weight`` where rows stand for several rows each."""
    return F.count(F.lit(1)) if weight is None else F.coalesce(F.sum(weight), F.lit(0).cast("long"))


def filtered_totals(
    df: DataFrame, condition: Column | None = None, *, metric: str = "net_sales", weight: str | None = None
) -> DataFrame:
    """Total and row count of a slice. ``weight`` counts the rows that a row was summed from."""
    rows = df if condition is None else df.where(condition)
    return rows.agg(
        round_amount(_zero_if_null(F.sum(_amount_or_zero(df, metric)))).alias("total_value"),
        counted_rows(weight).alias("row_count"),
    )


def closed_months(df: DataFrame, first: str, last: str, *, date_col: str = CLEAN_DATE) -> DataFrame:
    """Rows from the start of month ``first`` to the end of month ``last``."""
    dtype = df.schema[date_col].dataType

    def bound(d: date) -> Column:
        return F.lit(d).cast(dtype)

    c = F.col(f"`{date_col}`")
    return df.where((c >= bound(month_start(first))) & (c < bound(next_month_start(last))))
