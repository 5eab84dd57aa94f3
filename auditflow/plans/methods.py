"""Registered methods and plans made of them.

A method is a function from a prepared fact to a result DataFrame. A plan is a
list of steps; running it only builds DataFrames.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import BooleanType, NumericType

from auditflow.operators import metrics
from auditflow.operators.validate import MIN_VALID_STEPS
from auditflow.records import ANALYSIS_RESULT, RESULT_VALUE, conform

Method = Callable[..., DataFrame]

_METHODS: dict[str, Method] = {}


def register(category: str, method: Method) -> None:
    """Make ``method(df, **parameters)`` available to plans under ``category``."""
    _METHODS[category] = method


def method(category: str) -> Method:
    try:
        return _METHODS[category]
    except KeyError:
        raise ValueError(f"no method is registered for {category!r}") from None


register("metric_summary", metrics.metric_summary)
register("time_aggregation", metrics.monthly_trend)
register("period_comparison", metrics.period_comparison)
register("dimension_breakdown", metrics.period_breakdown)
register("customer_dynamics", metrics.customer_dynamics)
register("baseline_forecast", metrics.forecast_eligibility)
register("concentration_pareto", metrics.concentration)


@dataclass(frozen=True)
class Step:
    """One step of a plan. ``item`` names the column which tells its rows apart."""

    step_id: str
    category: str
    parameters: Mapping[str, Any] = field(default_factory=dict)
    depends_on: Sequence[str] = ()
    item: str | None = None

    @property
    def result_id(self) -> str:
        return f"RES_{self.step_id}"


# Ids of the registered steps.
SUMMARY, TREND, COMPARISON = "OP_01_METRIC_SUMMARY", "OP_02_TIME_AGGREGATION", "OP_03_PERIOD_COMPARISON"
BREAKDOWN_CHANNEL, BREAKDOWN_SEGMENT = "OP_04_DIMENSION_BREAKDOWN_CHANNEL", "OP_05_DIMENSION_BREAKDOWN_SEGMENT"
DYNAMICS, FORECAST = "OP_06_CUSTOMER_DYNAMICS", "OP_07_BASELINE_FORECAST_EVAL"

REGISTERED_STEPS = (SUMMARY, TREND, COMPARISON, BREAKDOWN_CHANNEL, BREAKDOWN_SEGMENT, DYNAMICS, FORECAST)


def default_plan(
    baseline: str,
    current: str,
    *,
    metric: str = "net_sales",
    dimensions: Sequence[str] = ("channel", "segment"),
    date_col: str = metrics.CLEAN_DATE,
) -> list[Step]:
    """Summary, trend, comparison, breakdowns, customer dynamics and forecast eligibility."""
    change = {"baseline": baseline, "current": current, "metric": metric, "date_col": date_col}
    step_ids = {"channel": BREAKDOWN_CHANNEL, "segment": BREAKDOWN_SEGMENT}
    breakdowns = [
        Step(
            step_ids.get(d, f"DIMENSION_BREAKDOWN_{d.upper()}"), "dimension_breakdown", {"dimensions": d, **change},
            (COMPARISON,), "dimension_value",
        )
        for d in dimensions
    ]
    return [
        Step(SUMMARY, "metric_summary"),
        Step(TREND, "time_aggregation", {"date_col": date_col}, (SUMMARY,), "period"),
        Step(COMPARISON, "period_comparison", change, (TREND,)),
        *breakdowns,
        Step(DYNAMICS, "customer_dynamics", {"date_col": date_col}, (TREND,), "period"),
        Step(FORECAST, "baseline_forecast", {"date_col": date_col}, (TREND,)),
    ]


#: Parameters of a step that name columns.
COLUMN_PARAMETERS = ("metric", "date_col", "dimensions", "customer_col", "dimension", "key")


def admitted(steps: Sequence[Step], columns: Sequence[str], default: Sequence[Step]) -> list[Step]:
    """The steps that may run: registered, over known columns, and after all they depend on.

    The others are dropped; where fewer than three are left, the default plan runs.
    A breakdown by a dimension that the table lacks may run, since it has one member.
    """
    known, kept = {c.lower() for c in columns}, []
    for step in steps:
        named = [v for k, v in step.parameters.items() if k in COLUMN_PARAMETERS and k != "dimensions" and isinstance(v, str)]
        there = all(c.lower() in known for c in named)
        if step.category in _METHODS and there and {f"RES_{d}" for d in step.depends_on} <= {s.result_id for s in kept}:
            kept.append(step)
    return kept if len(kept) >= MIN_VALID_STEPS else list(default)


def run_plan(df: DataFrame, steps: Sequence[Step]) -> dict[str, DataFrame]:
    """Result id to result. A step whose method is unknown, or that comes before one it needs, is an error."""
    done: dict[str, DataFrame] = {}
    for step in steps:
        missing = [d for d in step.depends_on if f"RES_{d}" not in done]
        if missing:
            raise ValueError(f"{step.step_id} needs {missing} before it")
        done[step.result_id] = method(step.category)(df, **step.parameters)
    return done


def results_table(spark: SparkSession, steps: Sequence[Step], results: Mapping[str, DataFrame]) -> DataFrame:
    """One pending result record per step, with the warnings its figures call for."""

    def record(step: Step) -> DataFrame:
        parameters = step.parameters
        periods = [parameters[k] for k in ("baseline", "current") if k in parameters]
        pairs = [F.lit(str(x)) for pair in parameters.items() for x in pair]
        return spark.range(1).select(
            F.lit(step.result_id).alias("result_id"),
            F.lit(step.step_id).alias("step_id"),
            F.lit(step.category).alias("category"),
            (F.create_map(*pairs) if pairs else F.lit(None)).alias("parameters"),
            F.lit(parameters.get("metric")).alias("metric"),
            F.lit(" vs ".join(periods) or "closed history").alias("period"),
            _warnings(step, results[step.result_id]).alias("warnings"),
            F.lit("pending").alias("validation_status"),
        )

    return reduce(DataFrame.unionByName, [conform(record(s), ANALYSIS_RESULT) for s in steps])


def _warnings(step: Step, result: DataFrame) -> Column:
    none = F.array().cast("array<string>")
    if step.category == "baseline_forecast":
        reasons = F.collect_list("reason")  # one row, and null reasons are not collected
        return result.agg(reasons.alias("warnings")).scalar()
    if step.category == "dimension_breakdown":
        off = F.count_if(~F.col("is_reconciled")) > 0
        text = F.array(F.lit("The parts do not add up to the total."))
        return result.agg(F.when(off, text).otherwise(none).alias("warnings")).scalar()
    return none


def result_values(steps: Sequence[Step], results: Mapping[str, DataFrame]) -> DataFrame:
    """All figures of all results in long form, for the checks that work on any result."""

    def long_form(step: Step) -> DataFrame:
        df = results[step.result_id]
        numeric = [f.name for f in df.schema if isinstance(f.dataType, (NumericType, BooleanType))]
        values = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("double").alias("value")) for c in numeric])
        item = F.col(step.item).cast("string") if step.item else F.lit(None).cast("string")
        return df.select(F.lit(step.result_id).alias("result_id"), item.alias("item"), F.inline(values))

    return reduce(DataFrame.unionByName, [conform(long_form(s), RESULT_VALUE) for s in steps])
