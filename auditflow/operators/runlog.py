"""Analysis of run logs: transitions, statuses, repairs, and model-call audits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

# Stages of a run and the stages each may be followed by.
ALLOWED_TRANSITIONS: Mapping[str, tuple[str, ...]] = {
    "UPLOADED": ("PROFILED", "FAILED", "CANCELLED"),
    "PROFILED": ("NEEDS_CLARIFICATION", "PLAN_READY", "FAILED", "CANCELLED"),
    "NEEDS_CLARIFICATION": ("PLAN_READY", "CANCELLED", "FAILED"),
    "PLAN_READY": ("PREPARING", "CANCELLED", "FAILED"),
    "PREPARING": ("ANALYZING", "FAILED", "CANCELLED"),
    "ANALYZING": ("VALIDATING", "FAILED", "CANCELLED"),
    "VALIDATING": ("VALIDATED", "NEEDS_REPAIR", "FAILED", "CANCELLED"),
    "NEEDS_REPAIR": ("PREPARING", "ANALYZING", "FAILED", "CANCELLED"),
    "VALIDATED": ("BUILDING_DASHBOARD", "FAILED", "CANCELLED"),
    "BUILDING_DASHBOARD": ("READY", "FAILED", "CANCELLED"),
    "READY": ("PREPARING", "CANCELLED"),
    "FAILED": ("PLAN_READY", "PREPARING"),
    "CANCELLED": (),
}
TERMINAL_STAGES = ("READY", "FAILED", "CANCELLED")
FAILED_STAGE = "FAILED"
REPAIR_STAGE = "NEEDS_REPAIR"

EVENTS_PER_BUCKET = 100_000


def previous_stage(
    log: DataFrame, *, run: str = "run_id", order: str = "event_id", stage: str = "stage", bucket: int = EVENTS_PER_BUCKET
) -> DataFrame:
    """Add ``previous_stage``, the stage of the event before in the same run.

    A window over a whole run would put a very long run into one task. Runs are
    cut into ranges of ``bucket`` event ids instead. Inside a range the window
    finds the previous event; for the first event of a range it is the last one of
    the run's range before, found in a table with one row per range.
    """
    bucketed = log.withColumn("_bucket", F.floor(F.col(order) / F.lit(bucket)))
    inside = Window.partitionBy(run, "_bucket").orderBy(order)
    last = bucketed.groupBy(run, "_bucket").agg(F.max_by(stage, order).alias("_last"))
    before = last.select(
        run, "_bucket", F.lag("_last").over(Window.partitionBy(run).orderBy("_bucket")).alias("_stage_before")
    )
    within = bucketed.withColumns(
        {"_is_first": F.row_number().over(inside) == 1, "_within": F.lag(stage).over(inside)}
    )
    previous = F.when(F.col("_is_first"), F.col("_stage_before")).otherwise(F.col("_within"))
    before = before.withColumnsRenamed({run: "_run", "_bucket": "_run_bucket"})
    same = F.col(f"`{run}`").eqNullSafe(F.col("_run")) & (F.col("_bucket") == F.col("_run_bucket"))  # a missing run is a run, too
    return (
        within.join(before, same)
        .withColumn("previous_stage", previous)
        .drop("_run", "_run_bucket", "_bucket", "_is_first", "_within", "_stage_before")
    )


def is_allowed(source: Column, target: Column, allowed: Mapping[str, Sequence[str]] = ALLOWED_TRANSITIONS) -> Column:
    """Whether a transition is allowed; one from an unknown stage is not."""
    test = F.lit(False)
    for stage, targets in allowed.items():
        if targets:
            test = test | ((source == stage) & target.isin(*targets))
    return test


def transitions(log: DataFrame, *, run: str = "run_id", order: str = "event_id", stage: str = "stage", **options) -> DataFrame:
    """Every step of every run from one stage to the next."""
    stepped = previous_stage(log, run=run, order=order, stage=stage, **options)
    return stepped.where(F.col("previous_stage").isNotNull()).select(
        run, order, F.col("previous_stage").alias("from_stage"), F.col(stage).alias("to_stage")
    )


def transition_violations(
    log: DataFrame,
    *,
    allowed: Mapping[str, Sequence[str]] = ALLOWED_TRANSITIONS,
    **options,
) -> DataFrame:
    """Steps which the allowed transitions do not list."""
    return transitions(log, **options).where(~is_allowed(F.col("from_stage"), F.col("to_stage"), allowed))


def run_status(
    log: DataFrame,
    *,
    run: str = "run_id",
    order: str = "event_id",
    stage: str = "stage",
    time: str = "created_at",
    reason: str = "failure_reason",
    terminal: Sequence[str] = TERMINAL_STAGES,
    failed: str = FAILED_STAGE,
    repair: str = REPAIR_STAGE,
) -> DataFrame:
    """One row per run: last stage, status, start, completion, repairs, failure reason.

    Completion is the latest terminal time. The failure reason is that of the last
    event, since each event replaces the one before it.
    """
    is_terminal = F.col(stage).isin(*terminal)
    reason_column = F.col(reason) if reason in log.columns else F.lit(None).cast("string")
    # A struct is never null, so the last event counts even if its reason is null.
    last = F.max_by(F.struct(F.col(stage).alias("stage"), reason_column.alias("reason")), F.col(order))
    runs = log.groupBy(run).agg(
        last.alias("last"),
        F.min(time).alias("started_at"),
        F.max(F.when(is_terminal, F.col(time))).alias("completed_at"),
        F.count_if(F.col(stage) == repair).alias("repair_attempts"),
        F.count(F.lit(1)).alias("events"),
    )
    current = F.col("last.stage")

    def micros(name: str) -> Column:
        return F.unix_micros(F.col(name).cast("timestamp"))

    return runs.select(
        run,
        current.alias("current_stage"),
        F.when(current.isin(*terminal), current).otherwise("RUNNING").alias("status"),
        F.col("last.reason").alias("failure_reason"),
        "started_at",
        "completed_at",
        F.round((micros("completed_at") - micros("started_at")) / 1e6, 3).alias("duration_seconds"),
        "repair_attempts",
        "events",
    )


def misleading_failures(status: DataFrame, *, failed: str = FAILED_STAGE) -> DataFrame:
    """Failed runs that give no reason."""
    return status.where((F.col("status") == failed) & (F.coalesce(F.trim("failure_reason"), F.lit("")) == ""))


def call_log_rollup(
    calls: DataFrame,
    *,
    by: Sequence[str] = ("caller_agent", "status"),
    input_tokens: str = "input_tokens",
    output_tokens: str = "output_tokens",
    duration: str = "duration_ms",
    percentiles: Sequence[float] = (0.5, 0.95),
    range_width: int = 1000,
) -> DataFrame:
    """Model calls per agent and status: calls, tokens and durations.

    Percentiles are exact at any size: the smallest duration that at least this
    share of the calls with a duration does not exceed (see ``exact_percentiles``).
    """

    def tokens(name: str) -> Column:
        return F.coalesce(F.sum(name), F.lit(0))

    rolled = calls.groupBy(*by).agg(
        F.count(F.lit(1)).alias("calls"),
        tokens(input_tokens).alias("input_tokens"),
        tokens(output_tokens).alias("output_tokens"),
        F.min(duration).alias("min_duration"),
        F.max(duration).alias("max_duration"),
    )
    if not percentiles:
        return rolled
    found = exact_percentiles(calls, by, duration, percentiles, range_width=range_width)
    renamed = found.withColumnsRenamed({c: f"_{c}" for c in by})
    same = reduce(Column.__and__, [F.col(f"`{c}`").eqNullSafe(F.col(f"`_{c}`")) for c in by])
    return rolled.join(renamed, same, "left").drop(*[f"_{c}" for c in by])


def exact_percentiles(
    df: DataFrame, by: Sequence[str], value: str, percentiles: Sequence[float], *, range_width: int = 1000
) -> DataFrame:
    """Exact discrete percentiles of ``value`` per group, as columns ``p50_duration`` and the like.

    Rows are first counted per distinct value. Values are then cut into ranges of
    ``range_width``: the ranges of a group get running totals, and so do the values
    inside the one range in which a percentile lies.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_value")).agg(F.count(F.lit(1)).alias("_n"))
    ranged = counted.withColumn("_range", F.floor(F.col("_value") / F.lit(range_width)))
    ranges = ranged.groupBy(*by, "_range").agg(F.sum("_n").alias("_in_range"))
    group = Window.partitionBy(*by)
    through = F.sum("_in_range").over(group.orderBy("_range").rowsBetween(Window.unboundedPreceding, 0))
    ranges = ranges.withColumns({"_through": through, "_total": F.sum("_in_range").over(group)})

    def rank(p: float) -> Column:
        return F.greatest(F.ceil(F.lit(p) * F.col("_total")), F.lit(1))

    holds = [(F.col("_through") >= rank(p)) & (F.col("_through") - F.col("_in_range") < rank(p)) for p in percentiles]
    wanted = ranges.where(reduce(Column.__or__, holds)).withColumnsRenamed({c: f"_{c}" for c in [*by, "_range"]})
    same = reduce(Column.__and__, [F.col(f"`{c}`").eqNullSafe(F.col(f"`_{c}`")) for c in by])
    inside = Window.partitionBy(*by, "_range").orderBy("_value").rowsBetween(Window.unboundedPreceding, 0)
    placed = ranged.join(wanted, same & (F.col("_range") == F.col("__range"))).withColumn(
        "_rank", F.sum("_n").over(inside) + F.col("_through") - F.col("_in_range")
    )
    return placed.groupBy(*by).agg(
        *[F.min(F.when(F.col("_rank") >= rank(p), F.col("_value"))).alias(f"p{round(p * 100)}_duration") for p in percentiles]
    )
