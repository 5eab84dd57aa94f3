"""Checks of computed results: finite, reconciled, safely joined, consistently presented.

All checks work on tables of results, so many runs can be validated in one job:
``keys`` names what identifies a result (a run column may come first).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from auditflow.functions.parsing import round_to
from auditflow.operators.joins import lookup

RESULT_KEY = ("result_id",)
RECONCILIATION_TOLERANCE = 0.05

# How grave a status or severity is, mildest first.
STATUS_RANKS = ("approved", "approved_with_warnings", "rejected")

MIN_VALID_STEPS = 3


def _checks(rows: DataFrame, keys: Sequence[str], name: Column, passed: Column, failed_severity: str, evidence: Column) -> DataFrame:
    return rows.select(
        *keys,
        name.alias("check_name"),
        passed.alias("passed"),
        F.when(passed, "info").otherwise(failed_severity).alias("severity"),
        evidence.alias("evidence"),
    )


def is_non_finite(c: Column) -> Column:
    d = c.cast("double")
    return F.coalesce(F.isnan(d) | (F.abs(d) == float("inf")), F.lit(False))


def finite_checks(values: DataFrame, *, keys: Sequence[str] = RESULT_KEY, value_col: str = "value") -> DataFrame:
    """One check per result: a NaN or infinite figure rejects it, a null does not."""
    counted = values.groupBy(*keys).agg(
        F.count_if(is_non_finite(F.col(value_col))).alias("bad"), F.count(F.lit(1)).alias("figures")
    )
    return _checks(
        counted,
        keys,
        F.concat(F.lit("Finite_Values_"), F.col(keys[-1]).cast("string")),
        F.col("bad") == 0,
        "blocking",
        F.format_string("%d of %d figures are not finite.", "bad", "figures"),
    )


def reconcile(
    parts: DataFrame,
    totals: DataFrame,
    *,
    keys: Sequence[str] = RESULT_KEY,
    on: Sequence[str] = ("metric", "baseline_period", "current_period"),
    tolerance: float = RECONCILIATION_TOLERANCE,
) -> DataFrame:
    """Sum of the parts' changes against an independently computed total.

    ``parts`` has ``absolute_change`` and, if it flags itself, ``is_reconciled``;
    ``totals`` has one ``absolute_change`` per ``on``. A result is compared with
    the total of its own metric and periods. Where there is none, its own
    ``total_change`` is used, if it has one.
    """
    own_total = F.max("total_change") if "total_change" in parts.columns else F.lit(None).cast("double")
    flag = F.coalesce(F.bool_and("is_reconciled"), F.lit(True)) if "is_reconciled" in parts.columns else F.lit(True)
    summed = parts.groupBy(*keys, *on).agg(
        F.sum(F.col("absolute_change").cast("decimal(28,4)")).alias("sum_of_changes"),
        own_total.alias("own_total"),
        flag.alias("self_reconciled"),
    )
    expected = totals.select(*on, F.col("absolute_change").alias("expected"))
    target = F.coalesce(F.col("expected"), F.col("own_total")).cast("decimal(28,4)")
    difference = F.abs(F.col("sum_of_changes") - target)
    passed = F.col("self_reconciled") & (difference.isNull() | (difference <= tolerance))
    return summed.join(expected, list(on), "left").select(
        *keys,
        *on,
        round_to(F.col("sum_of_changes"), 2).alias("sum_of_changes"),
        round_to(target, 2).alias("expected_change"),
        round_to(difference, 4).alias("difference"),
        passed.alias("is_reconciled"),
    )


def reconciliation_checks(reconciled: DataFrame, *, keys: Sequence[str] = RESULT_KEY) -> DataFrame:
    """One check per result; one that has no total to compare with passes with a warning."""
    passed = F.col("is_reconciled")
    return reconciled.select(
        *keys,
        F.concat(F.lit("Reconciliation_"), F.col(keys[-1]).cast("string")).alias("check_name"),
        passed.alias("passed"),
        F.when(~passed, "blocking").when(F.col("expected_change").isNull(), "warning").otherwise("info").alias("severity"),
        F.concat(
            F.lit("Sum of changes "), F.format_number("sum_of_changes", 2),
            F.lit(", expected "), F.coalesce(F.format_number("expected_change", 2), F.lit("unknown")),
        ).alias("evidence"),
    )


def source_amount_checks(results: DataFrame, cast_counts: DataFrame) -> DataFrame:
    """Whether the stored amounts behind the results are finite; one that is not rejects all of them.

    ``cast_counts`` comes from ``ledger.amount_cast_counts`` on the table as stored:
    the cast to exact amounts turns NaN and infinity into 0, so results can't show them.
    """
    bad = cast_counts.agg(F.coalesce(F.sum("non_finite_cells"), F.lit(0))).scalar()
    counted = results.select("result_id").withColumn("bad", bad)
    return _checks(
        counted, RESULT_KEY, F.concat(F.lit("Finite_Source_Amounts_"), F.col("result_id")), F.col("bad") == 0, "blocking",
        F.concat(F.col("bad").cast("string"), F.lit(" stored amounts are not finite.")),
    )


def source_file_checks(results: DataFrame, changes: DataFrame) -> DataFrame:
    """Whether the files behind the results are those of their manifest; a changed or missing one rejects all of them.

    ``changes`` comes from ``manifest.file_changes``. A new file is no error: no earlier result rests on it.
    """
    altered = F.col("state").isin("changed", "missing")
    counted = results.select("result_id").withColumns(
        {"altered": changes.agg(F.count_if(altered)).scalar(), "files": changes.agg(F.count(F.lit(1))).scalar()}
    )
    return _checks(
        counted, RESULT_KEY, F.concat(F.lit("Source_Files_"), F.col("result_id")), F.col("altered") == 0, "blocking",
        F.format_string("%d of %d files are changed or missing.", "altered", "files"),
    )


def join_safety_checks(diagnostics: DataFrame) -> DataFrame:
    """One check per join; these belong to the run, not to a single result."""
    return diagnostics.select(
        F.lit(None).cast("string").alias("result_id"),
        F.concat(F.lit("Join_Safety_"), F.col("right_table")).alias("check_name"),
        F.col("is_safe").alias("passed"),
        F.when(F.col("is_safe"), "info").otherwise("blocking").alias("severity"),
        F.concat(F.lit("Multiplication factor "), F.col("multiplication_factor").cast("string")).alias("evidence"),
    )


def sample_size_checks(eligibility: DataFrame, *, keys: Sequence[str] = RESULT_KEY) -> DataFrame:
    """A warning where the history is too short to forecast; it does not fail the result."""
    short = eligibility.where(~F.col("eligible"))
    return short.select(
        *keys,
        F.lit("Forecast_Sample_Size_Audit").alias("check_name"),
        F.lit(True).alias("passed"),
        F.lit("warning").alias("severity"),
        F.col("reason").alias("evidence"),
    )


def _status(rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in STATUS_RANKS]), rank.cast("int") + 1)


def result_statuses(results: DataFrame, checks: DataFrame, *, keys: Sequence[str] = RESULT_KEY) -> DataFrame:
    """Status per result: rejected by any failed blocking check, else by its own warnings."""
    failed = (~F.col("passed")) & (F.col("severity") == "blocking")
    failures = checks.groupBy(*keys).agg(F.count_if(failed).alias("failed_checks"))
    warned = F.coalesce(F.size("warnings") > 0, F.lit(False))
    rank = F.when(F.coalesce("failed_checks", F.lit(0)) > 0, 2).when(warned, 1).otherwise(0)
    return (
        results.drop("validation_status")
        .join(failures, list(keys), "left")
        .withColumn("failed_checks", F.coalesce("failed_checks", F.lit(0).cast("long")))
        .withColumn("validation_status", _status(rank))
    )


def report_status(checks: DataFrame, *, by: Sequence[str] = (), repair_attempt: int = 0, max_repairs: int = 2) -> DataFrame:
    """Overall status, per ``by`` (such as a run): rejected over warnings over approved."""
    failed = (~F.col("passed")) & (F.col("severity") == "blocking")
    rank = F.greatest(
        F.max(F.when(failed, 2).otherwise(0)), F.max(F.when(F.col("severity") == "warning", 1).otherwise(0))
    )
    return (
        checks.groupBy(*by)
        .agg(
            F.coalesce(rank, F.lit(0)).alias("rank"),
            F.count(F.lit(1)).alias("checks_executed"),
            F.count_if(failed).alias("failed_checks"),
        )
        .select(
            *by,
            _status(F.col("rank")).alias("overall_status"),
            "checks_executed",
            "failed_checks",
            ((F.col("rank") == 2) & F.lit(repair_attempt < max_repairs)).alias("can_retry"),
        )
    )


# ---------------------------------------------------------------------------
# Presentation
# ---------------------------------------------------------------------------
# A card is the summary of the change if its title has one of these.
SUMMARY_TITLE_PARTS = ("Total", "Contraction", "Decline")


def presentation_checks(components: DataFrame, results: DataFrame, *, run: Sequence[str] = ()) -> DataFrame:
    """Each card or chart with what is wrong with it, if anything.

    ``components``: component_id, kind (``card`` or ``chart``), result_id, points
    (data points, for charts). ``results``: result_id, validation_status. Both may
    have the columns of ``run``.
    """
    keys = [*run, "result_id"]
    statuses = results.groupBy(*keys).agg(F.bool_or(F.col("validation_status") == "rejected").alias("is_rejected"))
    problem = (
        F.when(F.col("is_rejected").isNull(), "cites an unknown result")
        .when(F.col("is_rejected"), "cites a rejected result")
        .when((F.col("kind") == "chart") & (F.coalesce("points", F.lit(0)) == 0), "is empty")
    )
    return lookup(components, statuses, keys).select(
        *run, "component_id", "kind", "result_id", problem.alias("problem"), problem.isNull().alias("is_valid")
    )


def period_alignment(components: DataFrame, *, run: Sequence[str] = ()) -> DataFrame:
    """Whether summary card and primary chart cover the same period; the first of each counts.

    ``components`` also needs title, period, is_primary. Runs that lack one of the
    two are aligned.
    """
    is_summary = (F.col("kind") == "card") & reduce(
        Column.__or__, [F.col("title").contains(p) for p in SUMMARY_TITLE_PARTS]
    )
    is_primary = (F.col("kind") == "chart") & F.col("is_primary")
    card = F.min_by("period", F.when(is_summary, F.col("component_id")))
    chart = F.min_by("period", F.when(is_primary, F.col("component_id")))
    found = components.groupBy(*run).agg(card.alias("card_period"), chart.alias("chart_period"))
    return found.withColumn("is_aligned", F.coalesce(F.col("card_period") == F.col("chart_period"), F.lit(True)))


def presentation_status(component_checks: DataFrame, alignment: DataFrame, *, run: Sequence[str]) -> DataFrame:
    """Per run: a dashboard is valid if all its components are and its periods agree."""
    counted = component_checks.groupBy(*run).agg(
        F.count(F.lit(1)).alias("components"), F.count_if(~F.col("is_valid")).alias("invalid_components")
    )
    return counted.join(alignment, list(run)).select(
        *run,
        "components",
        "invalid_components",
        "is_aligned",
        ((F.col("invalid_components") == 0) & F.col("is_aligned")).alias("is_dashboard_valid"),
    )


# ---------------------------------------------------------------------------
# Plans
# ---------------------------------------------------------------------------
def plan_gate(
    steps: DataFrame,
    registry: DataFrame,
    catalog: DataFrame,
    *,
    plan: Sequence[str] = ("plan_id",),
    step_key: str = "step_order",
) -> DataFrame:
    """Every proposed step with whether it may run, and why not.

    ``steps``: the plan columns, ``step_key``, step_id, columns (array of the
    columns it names). ``registry``: step_id. ``catalog``: column_name. Both are
    short lists; they enter as one array each, so no step is shuffled.
    """
    keys = [*plan, step_key]
    known = catalog.agg(F.collect_set(F.lower("column_name"))).scalar()
    registered = registry.agg(F.collect_set("step_id")).scalar()
    named = F.transform(F.coalesce("columns", F.array().cast("array<string>")), lambda c: F.lower(c))
    is_registered = F.coalesce(F.array_contains(registered, F.col("step_id")), F.lit(False))
    has_unknown = F.size(F.array_except(F.array_compact(named), known)) > 0
    verdict = F.when(~is_registered, "unregistered_step").when(has_unknown, "unknown_column")
    return steps.select(*keys, "step_id", verdict.alias("rejection")).withColumn("is_valid", F.col("rejection").isNull())


def gated_plans(gated: DataFrame, *, plan: Sequence[str] = ("plan_id",), min_valid: int = MIN_VALID_STEPS) -> DataFrame:
    """Per plan: valid steps, and whether the default plan replaces it for having too few."""
    return (
        gated.groupBy(*plan)
        .agg(F.count(F.lit(1)).alias("proposed_steps"), F.count_if("is_valid").alias("valid_steps"))
        .withColumn("use_default_plan", F.col("valid_steps") < min_valid)
    )


def steps_to_run(
    gated: DataFrame,
    default_steps: Sequence[str],
    *,
    plan: Sequence[str] = ("plan_id",),
    step_key: str = "step_order",
    min_valid: int = MIN_VALID_STEPS,
) -> DataFrame:
    """The steps of each plan that will run: its valid ones, or the default plan where they are too few.

    Default steps are numbered from 1 and marked ``is_default``.
    """
    plans = gated_plans(gated, plan=plan, min_valid=min_valid)
    kept = lookup(gated.where("is_valid"), plans.where(~F.col("use_default_plan")).select(*plan), list(plan), "inner")
    listed = F.array(*[F.struct(F.lit(i).cast("long").alias(step_key), F.lit(s).alias("step_id")) for i, s in enumerate(default_steps, 1)])
    replaced = plans.where("use_default_plan").select(*plan, F.inline(listed)).withColumn("is_default", F.lit(True))
    own = kept.select(*plan, F.col(step_key).cast("long").alias(step_key), "step_id", F.lit(False).alias("is_default"))
    return own.unionByName(replaced)


# ---------------------------------------------------------------------------
# Identity of tables and files
# ---------------------------------------------------------------------------
def table_digest(df: DataFrame, name: str = "table") -> DataFrame:
    """Row count and an order-free sum of row hashes; unchanged by repartitioning."""
    columns = sorted(df.columns)
    row_hash = F.xxhash64(*[F.col(f"`{c}`") for c in columns]).cast("decimal(38,0)")
    return df.agg(
        F.lit(name).alias("table_id"),
        F.count(F.lit(1)).alias("row_count"),
        F.lit(len(columns)).cast("long").alias("column_count"),
        F.coalesce(F.sum(row_hash), F.lit(0)).cast("string").alias("digest"),
    )


def text_digest(df: DataFrame, name: str = "table") -> DataFrame:
    """Row count and an order-free sum of MD5 parts of each row's cells as text.

    For columns of texts and whole numbers, whose text form other engines share, so
    that a copy of a table elsewhere can be compared.
    """
    columns = sorted(df.columns)
    cells = F.concat_ws("|", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("~")) for c in columns])
    part = F.conv(F.substring(F.md5(cells), 1, 8), 16, 10).cast("long")
    return df.agg(
        F.lit(name).alias("table_id"), F.count(F.lit(1)).alias("row_count"), F.coalesce(F.sum(part), F.lit(0)).alias("digest")
    )


def digest_tables(tables: Mapping[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [table_digest(df, name) for name, df in tables.items()])


def same_figures(first: DataFrame, second: DataFrame, *, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Compare two runs key by key; rows found in one run only count as different."""
    left = first.select(*keys, F.struct(*values).alias("first"))
    right = second.select(*keys, F.struct(*values).alias("second"))
    return left.join(right, list(keys), "full_outer").select(
        *keys, "first", "second", F.col("first").eqNullSafe(F.col("second")).alias("is_same")
    )
