"""The same rules on unbounded input: quarantine, closed periods, joins to a dimension."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from auditflow.functions.parsing import as_amount, month_key, round_amount
from auditflow.operators.joins import safe_left_join
from auditflow.operators.ledger import REASON, STEP, Cutoff, _reason, flag_exclusions, with_amounts
from auditflow.records import MONEY

ROW_STATE = "row_state"


def split_quarantine(stream: DataFrame, *, cutoff: Cutoff = None, **rules) -> DataFrame:
    """Mark each arriving row as clean or quarantined, with the reason. Keeps no state.

    The cutoff must be a date: a subquery cannot be evaluated over a stream.
    """
    flagged = flag_exclusions(with_amounts(stream), cutoff=cutoff, **rules)
    state = F.when(F.col(STEP).isNull(), "clean").otherwise("quarantined")
    return flagged.withColumns({ROW_STATE: state, REASON: _reason(cutoff)})


def write_quarantine(split: DataFrame, path: str, checkpoint: str, *, available_now: bool = False) -> StreamingQuery:
    """One exactly-once sink with a folder for clean rows and one for quarantined rows."""
    writer = split.writeStream.format("parquet").partitionBy(ROW_STATE).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.outputMode("append").start(path)


def closed_days(
    stream: DataFrame, time_col: str, *, delay: str = "1 day", metric: str = "net_sales", by: Sequence[str] = ()
) -> DataFrame:
    """Totals per day, emitted once the watermark has passed the day.

    Rows later than ``delay`` are dropped by the watermark. State is one row per
    open day (and member of ``by``), whatever the volume. ``time_col`` is a timestamp.
    """
    return (
        stream.withWatermark(time_col, delay)
        .groupBy(F.window(time_col, "1 day"), *by)
        .agg(F.sum(as_amount(stream, metric)).alias("net_sales"), F.count(F.lit(1)).alias("order_count"))
        .select(F.col("window.start").cast("date").alias("day"), *by, F.col("net_sales").cast(MONEY), "order_count")
    )


def closed_month_trend(days: DataFrame, *, by: Sequence[str] = ()) -> DataFrame:
    """Batch roll-up of emitted days; a month shows once its last day, or a later one, was emitted."""
    last_emitted = days.agg(F.max("day")).scalar()
    return (
        days.groupBy(F.trunc("day", "MM").alias("month"), *by)
        .agg(F.sum("net_sales").alias("net_sales"), F.sum("order_count").alias("order_count"))
        .where(F.last_day("month") <= last_emitted)
        .select(month_key(F.col("month")).alias("period"), *by, round_amount(F.col("net_sales")).alias("net_sales"), "order_count")
    )


# ---------------------------------------------------------------------------
# Closed days whose late rows are kept
# ---------------------------------------------------------------------------
_ROWS = "net_sales decimal(38,4), batch long, late boolean, day date"
_DAYS = "day date, net_sales decimal(38,4), order_count long, batch long"
_MARKS = "closed date, seen date, batch long"


def write_closed_days(
    stream: DataFrame, folder: str, checkpoint: str, *, time_col: str, delay_days: int = 1, metric: str = "net_sales", available_now: bool = False
) -> StreamingQuery:
    """Totals per day as ``closed_days`` emits them, with the rows that came too late kept beside them.

    A day is closed once a row more than ``delay_days`` later has arrived; its total is written
    to ``days``, and never again. Every arriving row goes to ``rows``, marked late if its day was
    closed by an earlier batch. A batch that runs again overwrites its own folders only and judges by
    earlier batches only, so it writes the same. Only the days being closed are read again.
    Rows without a readable time are left out.
    """

    def close(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession

        def stored(name: str, schema: str) -> DataFrame:
            return spark.read.schema(schema).parquet(f"{folder}/{name}")

        def write(df: DataFrame, name: str, *by: str) -> None:
            df.write.mode("overwrite").partitionBy(*by).parquet(f"{folder}/{name}/batch={batch_id}")

        first = batch_id == 0
        before = (None, None) if first else stored("marks", _MARKS).where(F.col("batch") < batch_id).agg(F.max("closed"), F.max("seen")).first()
        closed = F.lit(before[0]).cast("date")
        rows = batch.select(F.to_date(F.col(time_col)).alias("day"), as_amount(batch, metric).cast("decimal(38,4)").alias("net_sales")).where("day is not null")
        write(rows.withColumn("late", F.coalesce(F.col("day") <= closed, F.lit(False))), "rows", "late", "day")
        arrived = stored("rows", _ROWS).where(F.col("batch") <= batch_id)
        seen = F.greatest(F.lit(before[1]).cast("date"), arrived.where(F.col("batch") == batch_id).agg(F.max("day")).scalar())
        mark = spark.range(1).select(F.greatest(closed, F.date_sub(seen, delay_days + 1)).alias("closed"), seen.alias("seen"))
        write(mark, "marks")
        now = mark.first()["closed"]
        due = arrived.where(~F.col("late") & (F.col("day") <= F.lit(now)) & (closed.isNull() | (F.col("day") > closed)))
        write(due.groupBy("day").agg(F.sum("net_sales").cast("decimal(38,4)").alias("net_sales"), F.count(F.lit(1)).alias("order_count")), "days")

    writer = stream.writeStream.foreachBatch(close).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def read_closed_days(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(_DAYS).parquet(f"{folder}/days").drop("batch")


def late_rows(spark: SparkSession, folder: str) -> DataFrame:
    """(day, net_sales, batch) of rows whose day was closed when they came."""
    return spark.read.schema(_ROWS).parquet(f"{folder}/rows").where("late").drop("late")


def month_corrections(late: DataFrame) -> DataFrame:
    """What late rows add to each month that they belong to."""
    return late.groupBy(month_key(F.trunc("day", "MM")).alias("period")).agg(
        round_amount(F.sum("net_sales")).alias("net_sales"), F.count(F.lit(1)).alias("order_count")
    )


def join_dimension(stream: DataFrame, dim: DataFrame, left_key: str, right_key: str | None = None, **options) -> DataFrame:
    """Safe left join of arriving rows to a static dimension with one row per key."""
    return safe_left_join(stream, dim, left_key, right_key, **options)
