"""Time coverage and completeness of the last month of a fact."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, functions as F

from auditflow.functions.parsing import as_date, month_key

MIN_DAYS_IN_LAST_MONTH = 15


def time_coverage(df: DataFrame, date_col: str) -> DataFrame:
    """First and last readable date, with the number of rows that have one."""
    d = as_date(df, date_col)
    return df.agg(
        F.min(d).alias("coverage_start"),
        F.max(d).alias("coverage_end"),
        F.count(d).alias("dated_rows"),
        F.count(F.lit(1)).alias("total_rows"),
    )


def incomplete_period(
    df: DataFrame, date_col: str, *, min_days: int = MIN_DAYS_IN_LAST_MONTH
) -> DataFrame:
    """One row on the last month: days recorded, whether it is incomplete, and the cutoff.

    The cutoff is the last day of the last closed month. The days of a month are
    bits of one number, so that rows are reduced to one per month at once and no
    count of distinct days is needed.
    """
    dated = df.select(as_date(df, date_col).alias("day"))
    months = dated.groupBy(F.trunc("day", "MM").alias("month")).agg(month_days("day").alias("days"), F.count(F.lit(1)).alias("n"))
    picked = months.agg(last_month().alias("last"), F.sum("n").alias("total_rows"))
    incomplete = is_incomplete(F.col("last"), min_days)
    return picked.where(F.col("last").isNotNull()).select(
        month_key(F.col("last.month")).alias("last_month"),
        days_recorded(F.col("last")).alias("days_recorded"),
        days_in_month(F.col("last")).alias("days_in_month"),
        F.col("last.n").alias("rows_in_month"),
        F.col("total_rows"),
        incomplete.alias("is_incomplete"),
        F.when(incomplete, F.date_sub("last.month", 1)).otherwise(F.last_day("last.month")).alias("cutoff"),
    )


def month_days(day: str) -> Column:
    """Aggregate: the days of a month that have rows, as bits of one number."""
    return F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.dayofmonth(day)))


def last_month() -> Column:
    """Aggregate over months (month, days, n): the last one that is known."""
    return F.max_by(F.struct("month", "days", "n"), F.col("month"))


def days_recorded(last: Column) -> Column:
    return F.bit_count(last["days"]).cast("long")


def days_in_month(last: Column) -> Column:
    return F.dayofmonth(F.last_day(last["month"])).cast("long")


def is_incomplete(last: Column, min_days: int) -> Column:
    return (days_recorded(last) < min_days) & (days_recorded(last) < days_in_month(last))


def infer_cutoff(df: DataFrame, date_col: str, *, min_days: int = MIN_DAYS_IN_LAST_MONTH) -> date | None:
    """The cutoff as a Python date. Runs a job which returns a single row.

    A literal cutoff can be pushed down to the scan of the fact.
    """
    row = incomplete_period(df, date_col, min_days=min_days).select("cutoff").first()
    return row.cutoff if row else None
