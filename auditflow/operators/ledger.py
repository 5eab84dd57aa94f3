"""Exclusion of unusable fact rows, with a ledger of what was excluded and why.

Each row is tested once and gets the number of the first step that excludes it.
Clean rows, quarantined rows and the ledger are all read from that one column.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation, Window, functions as F
from pyspark.sql.types import DateType, DoubleType, FloatType, IntegerType, StringType

from auditflow.functions.naming import DATE_NAME_PARTS, first_with, status_column
from auditflow.functions.parsing import DATE_FORMATS, as_amount, as_date, is_missing, parse_number
from auditflow.records import MONEY, TRANSFORMATION, conform

# Statuses which exclude a row, and the amount columns of a fact.
EXCLUDED_STATUSES = ("CANCELLED", "REFUNDED", "CANCELADO", "DEVUELTO")
AMOUNT_COLUMNS = ("units", "unit_price", "discount_amount", "gross_sales", "net_sales")

CLEAN_DATE = "order_date_clean"
STEP = "exclusion_step"
REASON = "exclusion_reason"

INVALID_DATE, EXCLUDED_STATUS, AFTER_CUTOFF = 1, 2, 3

Cutoff = date | str | Column | None


def _cutoff_column(cutoff: Cutoff) -> Column:
    return (cutoff if isinstance(cutoff, Column) else F.lit(cutoff)).cast(DateType())


def _reason(cutoff: Cutoff) -> Column:
    reasons = F.when(F.col(STEP) == INVALID_DATE, F.lit("Date is missing or not a date")).when(
        F.col(STEP) == EXCLUDED_STATUS, F.lit("Status is excluded")
    )
    if cutoff is not None:
        late = F.concat(
            F.lit("After the cutoff ("),
            F.coalesce(_cutoff_column(cutoff).cast(StringType()), F.lit("unknown")),
            F.lit(")"),
        )
        reasons = reasons.when(F.col(STEP) == AFTER_CUTOFF, late)
    return reasons


class ExclusionRules(NamedTuple):
    """The columns and values which decide whether a fact row is usable."""

    date_col: str | None
    status_col: str | None
    cutoff: Cutoff
    excluded_statuses: Sequence[str]
    date_formats: Sequence[str]

    def clean_date(self, fact: DataFrame) -> Column:
        return as_date(fact, self.date_col, self.date_formats)

    def tests(self, fact: DataFrame) -> list[tuple[int, Column]]:
        """Steps in order, each with the condition which excludes a row (never null)."""
        tests = []
        if self.date_col:
            tests.append((INVALID_DATE, self.clean_date(fact).isNull()))
        if self.status_col:
            excluded = F.col(f"`{self.status_col}`").isin(*self.excluded_statuses)
            tests.append((EXCLUDED_STATUS, F.coalesce(excluded, F.lit(False))))
        if self.date_col and self.cutoff is not None:
            late = self.clean_date(fact) > _cutoff_column(self.cutoff)
            tests.append((AFTER_CUTOFF, F.coalesce(late, F.lit(False))))
        return tests


def exclusion_rules(
    fact: DataFrame,
    *,
    date_col: str | None = None,
    status_col: str | None = None,
    cutoff: Cutoff = None,
    excluded_statuses: Sequence[str] = EXCLUDED_STATUSES,
    date_formats: Sequence[str] = DATE_FORMATS,
) -> ExclusionRules:
    """Rules for a fact; columns that are not given are found by name.

    Statuses are a denylist: unknown and missing ones are kept. The cutoff is
    inclusive by day. Pass ``cutoff`` as a date where it is known, or as a scalar
    subquery column to let it be found within the same query.
    """
    return ExclusionRules(
        date_col or first_with(fact.columns, DATE_NAME_PARTS),
        status_col or status_column(fact.columns),
        cutoff,
        excluded_statuses,
        date_formats,
    )


def flag_exclusions(fact: DataFrame, **rules) -> DataFrame:
    """Add the clean date and the first excluding step (null for kept rows).

    Takes the arguments of ``exclusion_rules``.
    """
    found = exclusion_rules(fact, **rules)
    step = F.lit(None).cast(IntegerType())
    for number, excluded in reversed(found.tests(fact)):
        step = F.when(excluded, number).otherwise(step)
    added = {CLEAN_DATE: found.clean_date(fact)} if found.date_col else {}
    return fact.withColumns({**added, STEP: step})


def keep_usable(fact: DataFrame, **rules) -> DataFrame:
    """The clean rows alone, for when no ledger is wanted.

    Gives the rows of ``clean_rows(flag_exclusions(...))``, but as one filter per
    rule, which the optimizer can move below joins one by one.
    """
    found = exclusion_rules(fact, **rules)
    for _, excluded in found.tests(fact):
        fact = fact.where(~excluded)
    return fact.withColumn(CLEAN_DATE, found.clean_date(fact)) if found.date_col else fact


def clean_rows(flagged: DataFrame) -> DataFrame:
    return flagged.where(F.col(STEP).isNull()).drop(STEP)


def quarantined_rows(flagged: DataFrame, *, cutoff: Cutoff = None) -> DataFrame:
    """Every excluded row in full, with its reason."""
    return flagged.where(F.col(STEP).isNotNull()).withColumn(REASON, _reason(cutoff))


def with_amounts(fact: DataFrame, amount_cols: Sequence[str] = AMOUNT_COLUMNS) -> DataFrame:
    """Amount columns as exact decimals; missing and unreadable cells become 0."""
    present = [c for c in amount_cols if c in fact.columns]
    return fact.withColumns({c: as_amount(fact, c) for c in present})


def _is_non_finite(df: DataFrame, name: str) -> Column:
    c = F.col(f"`{name}`")
    if isinstance(df.schema[name].dataType, (DoubleType, FloatType)):
        return F.coalesce(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(False))
    if isinstance(df.schema[name].dataType, StringType):
        return F.coalesce(F.lower(F.trim(c)).rlike(r"^[+-]?(nan|inf|infinity)$"), F.lit(False))
    return F.lit(False)


def _is_unreadable(df: DataFrame, name: str) -> Column:
    """Cells that are no number, or one beyond the exact type; both would become 0."""
    c = F.col(f"`{name}`")
    if isinstance(df.schema[name].dataType, StringType):
        return ~is_missing(c) & parse_number(c).isNull()
    too_large = c.isNotNull() & c.try_cast(MONEY.simpleString()).isNull()
    return too_large & ~_is_non_finite(df, name)


def _cell_tests(df: DataFrame, name: str) -> dict[str, Column]:
    return {
        "missing_cells": is_missing(F.col(f"`{name}`").cast(StringType())),
        "unreadable_cells": _is_unreadable(df, name),
        "non_finite_cells": _is_non_finite(df, name),
    }


def amount_cast_counts(df: DataFrame, amount_cols: Sequence[str] = AMOUNT_COLUMNS) -> DataFrame:
    """Per amount column: cells that are missing, unreadable or not finite.

    Counted on the stored cells, since the cast to decimal would turn NaN and
    infinity into plain missing values.
    """
    present = [c for c in amount_cols if c in df.columns]
    counts = [
        F.struct(F.lit(c).alias("column"), *[F.count_if(test).alias(name) for name, test in _cell_tests(df, c).items()]) for c in present
    ]
    if not counts:
        raise ValueError(f"none of {list(amount_cols)} is a column of the table")
    return df.agg(F.array(*counts).alias("counts")).select(F.inline("counts"))


def exclusion_samples(flagged: DataFrame, *, key_col: str, detail_cols: dict[int, str], samples: int) -> DataFrame:
    """Up to ``samples`` rows per step, the smallest by key.

    The rank filter is applied before the shuffle too, so a step which excludes
    most of the table still sends only ``samples`` rows per task.
    """
    detail = F.lit(None).cast(StringType())
    detail_name = F.lit(None).cast(StringType())
    for step, name in detail_cols.items():
        detail = F.when(F.col(STEP) == step, F.col(f"`{name}`").cast(StringType())).otherwise(detail)
        detail_name = F.when(F.col(STEP) == step, F.lit(name)).otherwise(detail_name)
    order = Window.partitionBy(STEP).orderBy(F.col("key"), F.col("detail"))
    ranked = (
        flagged.where(F.col(STEP).isNotNull())
        .select(STEP, F.col(f"`{key_col}`").alias("key"), detail_name.alias("detail_name"), detail.alias("detail"))
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= samples)
    )
    kept = F.sort_array(F.collect_list(F.struct("rank", F.col("key").cast(StringType()).alias("key"), "detail_name", "detail")))
    as_map = F.transform(
        kept, lambda s: F.map_from_arrays(F.array(F.lit(key_col), s["detail_name"]), F.array(s["key"], s["detail"]))
    )
    return ranked.groupBy(STEP).agg(as_map.alias("exclusion_samples"))


def join_steps(checks: DataFrame, raw: DataFrame, order: Sequence[str], *, first_index: int) -> DataFrame:
    """Ledger records of safe joins: rows before and after, and dimension rows removed as duplicates.

    ``checks`` are diagnostics of the joins as made, ``raw`` those to the dimensions as
    they are; ``order`` lists the right tables in the order of the joins.
    """
    given = raw.groupBy("right_table").agg(F.max("right_rows").alias("given_rows"))
    place = F.array_position(F.array(*[F.lit(t) for t in order]), F.col("right_table"))
    joined = checks.join(given, "right_table", "left")
    removed = F.coalesce("given_rows", "right_rows") - F.col("right_rows")
    return conform(
        joined.select(
            (place + F.lit(first_index - 1)).cast("int").alias("step_index"),
            F.concat(F.lit("TRF_JOIN_"), F.upper("right_table")).alias("transformation_id"),
            F.lit("safe_left_join").alias("operation"),
            F.array("left_key").alias("columns_affected"),
            F.create_map(
                F.lit("join_keys"), F.col("join_keys"), F.lit("right_table"), F.col("right_table"),
                F.lit("duplicates_removed"), removed.cast(StringType()),
            ).alias("parameters"),
            F.col("left_rows").alias("rows_before"),
            F.col("result_rows").alias("rows_after"),
            F.lit(0).cast("long").alias("rows_excluded"),
        ),
        TRANSFORMATION,
    )


def exclusion_ledger(
    flagged: DataFrame,
    *,
    date_col: str | None = None,
    status_col: str | None = None,
    cutoff: Cutoff = None,
    key_col: str | None = None,
    samples: int = 5,
) -> DataFrame:
    """One record per step with the rows before, after and excluded.

    All counts come from one aggregate over the flagged rows. The cutoff step is
    recorded only if it excluded something.
    """
    source_cols = [c for c in flagged.columns if c not in (CLEAN_DATE, STEP)]
    steps = _steps(source_cols, date_col, status_col, cutoff)
    if not steps:
        return conform(flagged.sparkSession.range(0), TRANSFORMATION)
    counts = flagged.agg(*[c.alias(name) for name, c in _step_counts(steps).items()])
    sampled = exclusion_samples(flagged, key_col=key_col or source_cols[0], detail_cols=_details(steps), samples=samples) if samples else None
    return _ledger(counts, steps, cutoff, sampled)


_Step = tuple[int, str, str, str]


def _steps(columns: Sequence[str], date_col: str | None, status_col: str | None, cutoff: Cutoff) -> list[_Step]:
    """Step, identifier, operation and column of every rule, in order."""
    date_col = date_col or first_with(columns, DATE_NAME_PARTS)
    status_col = status_col or status_column(columns)
    steps: list[_Step] = []
    if date_col:
        steps.append((INVALID_DATE, "TRF_01_CLEAN_DATES", "filter_invalid_dates", date_col))
    if status_col:
        steps.append((EXCLUDED_STATUS, "TRF_02_FILTER_STATUS", "filter_completed_orders", status_col))
    if date_col and cutoff is not None:
        steps.append((AFTER_CUTOFF, "TRF_03_CUTOFF_INCOMPLETE_PERIOD", "filter_date_range", CLEAN_DATE))
    return steps


def _details(steps: Sequence[_Step]) -> dict[int, str]:
    return {step: column for step, _, _, column in steps}


def _step_counts(steps: Sequence[_Step]) -> dict[str, Column]:
    """Aggregates over flagged rows: all of them, and those that each step excludes."""
    return {"total": F.count(F.lit(1)), **{f"excluded_{step}": F.count_if(F.col(STEP) == step) for step, *_ in steps}}


def _ledger(counts: DataFrame, steps: Sequence[_Step], cutoff: Cutoff, sampled: DataFrame | None) -> DataFrame:
    """Ledger records from one row with ``_step_counts``."""
    before = F.col("total")
    records = []
    for index, (step, transformation_id, operation, column) in enumerate(steps, start=1):
        excluded = F.col(f"excluded_{step}")
        records.append(
            F.struct(
                F.lit(step).alias(STEP),
                F.lit(index).alias("step_index"),
                F.lit(transformation_id).alias("transformation_id"),
                F.lit(operation).alias("operation"),
                F.array(F.lit(column)).alias("columns_affected"),
                F.create_map(F.lit("column"), F.lit(column)).alias("parameters"),
                before.alias("rows_before"),
                (before - excluded).alias("rows_after"),
                excluded.alias("rows_excluded"),
            )
        )
        before = before - excluded
    ledger = (
        counts.select(F.inline(F.array(*records)))
        .where((F.col(STEP) != AFTER_CUTOFF) | (F.col("rows_excluded") > 0))
        .withColumn(REASON, _reason(cutoff))
    )
    if sampled is not None:
        # At most one row per step on either side.
        ledger = ledger.join(F.broadcast(sampled), STEP, "left")
    return conform(ledger, TRANSFORMATION)


# ---------------------------------------------------------------------------
# Ledger of the pass that writes
# ---------------------------------------------------------------------------
OUTCOME = "outcome"
KEPT = 0


class Written(NamedTuple):
    """A fact as stored, and what was counted while it was written."""

    usable: DataFrame
    quarantine: DataFrame
    ledger: DataFrame
    amount_counts: DataFrame | None


def write_with_ledger(
    fact: DataFrame, path: str, *, amount_cols: Sequence[str] = AMOUNT_COLUMNS, key_col: str | None = None, samples: int = 5, **rules
) -> Written:
    """Store usable and excluded rows in one pass over the fact, and count in the same pass.

    Rows are written as they are, with the clean date, under ``outcome=0`` (usable) or the number
    of the step that excludes them, so either part is read without the other. Steps and the cells of
    amount columns are counted by an ``Observation`` on the rows being written: the fact is read
    once, and the figures are those of the very rows that were stored. Tasks that run again count
    once, as the write is the last stage of its job. Samples are read from the excluded part alone.

    ``amount_counts`` is over usable rows, None without amount columns. ``rules`` are those of
    ``exclusion_rules``. Runs the write when called.
    """
    spark = fact.sparkSession
    cutoff = rules.get("cutoff")
    steps = _steps(fact.columns, rules.get("date_col"), rules.get("status_col"), cutoff)
    flagged = flag_exclusions(fact, **rules)
    counts = _step_counts(steps)
    amounts = [c for c in amount_cols if c in fact.columns]
    cells = {
        (c, name): F.count_if(F.col(STEP).isNull() & test).alias(f"{name}_{i}") for i, c in enumerate(amounts) for name, test in _cell_tests(fact, c).items()
    }
    seen = Observation()
    # Counted before the partition column is made, which the writer takes out of the rows.
    observed = flagged.observe(seen, *[c.alias(name) for name, c in counts.items()], *cells.values())
    stored = observed.withColumn(OUTCOME, F.coalesce(STEP, F.lit(KEPT))).drop(STEP)
    stored.write.partitionBy(OUTCOME).parquet(path)
    found = seen.get

    read = spark.read.schema(stored.schema).parquet(path)
    excluded = read.where(F.col(OUTCOME) != KEPT).withColumnRenamed(OUTCOME, STEP)
    one = spark.range(1).select(*[F.lit(found[name]).cast("long").alias(name) for name in counts])
    sampled = None
    if samples and steps:
        sampled = exclusion_samples(excluded, key_col=key_col or fact.columns[0], detail_cols=_details(steps), samples=samples)
    counted = None
    if amounts:
        names = ("missing_cells", "unreadable_cells", "non_finite_cells")
        rows = [(c, *[found[f"{name}_{i}"] for name in names]) for i, c in enumerate(amounts)]
        counted = spark.createDataFrame(rows, "column string, " + ", ".join(f"{n} long" for n in names))
    return Written(
        usable=read.where(F.col(OUTCOME) == KEPT).drop(OUTCOME),
        quarantine=excluded.withColumn(REASON, _reason(cutoff)),
        ledger=_ledger(one, steps, cutoff, sampled) if steps else conform(spark.range(0), TRANSFORMATION),
        amount_counts=counted,
    )
