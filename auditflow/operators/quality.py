"""Data-quality issues: each check returns issue records, and a report joins them up.

Checks that find nothing return no rows. None of them runs a job when called.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from auditflow.functions.naming import (
    DATE_NAME_PARTS,
    columns_with,
    first_with,
    is_fact_name,
    is_keyed_dimension_name,
    status_column,
)
from auditflow.functions.parsing import DATE_FORMATS, as_date, is_missing, month_key, percent, round_to
from auditflow.operators.joins import candidate_links, link_diagnostics, link_samples
from auditflow.operators.ledger import EXCLUDED_STATUSES
from auditflow.operators.periods import (
    MIN_DAYS_IN_LAST_MONTH, days_in_month, days_recorded, incomplete_period, is_incomplete, last_month, month_days,
)
from auditflow.operators.profile import profile_tables
from auditflow.records import QUALITY_ISSUE, QUALITY_REPORT, conform


def _text(*parts: Column | str) -> Column:
    return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])


def _fields(
    *,
    issue_type: str,
    severity: str,
    table_id: Column | str,
    column: Column | str | None,
    affected: Column,
    total: Column,
    description: Column | str,
    action: Column | str,
    samples: Column | None = None,
    percentage: Column | None = None,
    prefix: str | None = None,
    id_parts: Sequence[Column | str] | None = None,
) -> list[Column]:
    """The fields of an issue record."""

    def lit(value: Column | str | None) -> Column:
        return value if isinstance(value, Column) else F.lit(value).cast("string")

    parts = [lit(p) for p in (id_parts if id_parts is not None else (table_id, column))]
    return [
        F.concat_ws("_", F.lit(prefix or issue_type.upper()), *parts).alias("id"),
        F.lit(issue_type).alias("issue_type"),
        F.lit(severity).alias("severity"),
        lit(table_id).alias("table_id"),
        lit(column).alias("column"),
        affected.cast("long").alias("affected_rows"),
        total.cast("long").alias("total_rows"),
        (percentage if percentage is not None else percent(affected, total)).alias("affected_percentage"),
        (samples if samples is not None else F.array().cast("array<string>")).alias("evidence_samples"),
        lit(description).alias("description"),
        lit(action).alias("recommended_action"),
    ]


def _issues(rows: DataFrame, **fields) -> DataFrame:
    return conform(rows.select(*_fields(**fields)), QUALITY_ISSUE)


def _found(when: Column, **fields) -> Column:
    """An issue as a value, null if the condition doesn't hold."""
    return F.when(when, F.struct(*_fields(**fields)))


def _inlined(rows: DataFrame, found: Sequence[Column]) -> DataFrame:
    """The issues that are found in each row of figures, without reading the row's source again."""
    return conform(rows.select(F.inline(F.array_compact(F.array(*found)))), QUALITY_ISSUE)


def empty_table(df: DataFrame, table_id: str) -> DataFrame:
    """Blocking: the table has no rows."""
    counted = df.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == 0)
    return _issues(
        counted,
        issue_type="empty_file",
        severity="blocking",
        table_id=table_id,
        column=None,
        affected=F.lit(0),
        total=F.lit(0),
        percentage=F.lit(100.0),
        description=f"{table_id} has no rows.",
        action="Provide rows for this table.",
        prefix="EMPTY",
    )


def key_counts(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(F.col(f"`{key}`").alias("key")).agg(F.count(F.lit(1)).alias("n"))


def duplicate_keys(df: DataFrame, table_id: str, *, key: str | None = None, samples: int = 3) -> DataFrame | None:
    """Rows of a dimension whose key is not unique. The key is the first column named like an id."""
    key = key or first_with(df.columns, ("id",))
    if key is None:
        return None
    counts = key_counts(df, key)
    repeated = (F.col("n") > 1) & F.col("key").isNotNull()
    summed = counts.agg(
        F.sum("n").alias("total"), F.sum(F.when(repeated, F.col("n"))).alias("affected")
    ).where(F.col("affected") > 0)
    return _issues(
        summed,
        issue_type="duplicate_keys",
        severity="warning",
        table_id=table_id,
        column=key,
        affected=F.col("affected"),
        total=F.col("total"),
        samples=_samples_of(counts.where(repeated), samples),
        description=f"{key} should identify a row of {table_id}, but repeats.",
        action="Reduce the dimension to one row per key before joining it.",
        prefix="DUP_KEY",
    )


def _samples_of(counts: DataFrame, k: int) -> Column | None:
    """The most frequent keys, ties by key, as an array."""
    if not k:
        return None
    top = counts.select(F.col("key").cast("string").alias("key"), "n").orderBy(F.desc("n"), "key").limit(k)
    packed = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("rank"), F.col("key").alias("key"))))
    return top.agg(F.transform(packed, lambda s: s["key"]).alias("samples")).scalar()


def invalid_dates(
    df: DataFrame, table_id: str, *, columns: Sequence[str] | None = None, date_formats: Sequence[str] = DATE_FORMATS, samples: int = 3
) -> DataFrame | None:
    """Cells of date columns which are filled but are not a date. All columns in one pass."""
    columns = columns if columns is not None else columns_with(df.columns, DATE_NAME_PARTS)
    if not columns:
        return None

    def is_invalid(name: str) -> Column:
        filled = ~is_missing(F.col(f"`{name}`").cast("string"))
        return filled & as_date(df, name, date_formats).isNull()

    def sampled(name: str) -> Column:
        if not samples:
            return F.array().cast("array<string>")
        cell = F.col(f"`{name}`").cast("string")
        few = df.where(is_invalid(name)).select(cell.alias("cell")).orderBy("cell").limit(samples)
        return few.agg(F.sort_array(F.collect_list("cell")).alias("samples")).scalar()

    found = df.agg(
        F.count(F.lit(1)).alias("total"),
        F.array(
            *[F.struct(F.lit(c).alias("column"), F.count_if(is_invalid(c)).alias("affected")) for c in columns]
        ).alias("found"),
    ).select("total", F.inline("found"))
    evidence = reduce(lambda rest, c: F.when(F.col("column") == c, sampled(c)).otherwise(rest), columns, F.array().cast("array<string>"))
    return _issues(
        found.where(F.col("affected") > 0),
        issue_type="invalid_date",
        severity="warning",
        table_id=table_id,
        column=F.col("column"),
        affected=F.col("affected"),
        total=F.col("total"),
        samples=evidence,
        description=_text(F.col("column"), f" of {table_id} has ", F.col("affected"), " filled cells that are not a date."),
        action="Leave these rows out of monthly figures; the ledger records them.",
    )


def incomplete_last_period(
    df: DataFrame, table_id: str, *, column: str, min_days: int = MIN_DAYS_IN_LAST_MONTH
) -> DataFrame:
    """The last month of a fact has too few days with records to be compared."""
    last = incomplete_period(df, column, min_days=min_days).where("is_incomplete")
    days = _text(F.col("last_month"), ": ", F.col("days_recorded"), " of ", F.col("days_in_month"), " days")
    return _issues(
        last,
        issue_type="incomplete_period",
        severity="warning",
        table_id=table_id,
        column=column,
        affected=F.col("rows_in_month"),
        total=F.col("total_rows"),
        samples=F.array(days),
        description=_text(
            "The last month ", F.col("last_month"), " has rows on ", F.col("days_recorded"), " days only, so it is not comparable.",
        ),
        action="Compare closed full months only.",
    )


def returns_and_cancellations(
    df: DataFrame, table_id: str, *, column: str | None = None, statuses: Sequence[str] = EXCLUDED_STATUSES
) -> DataFrame | None:
    """Rows whose status is cancelled or refunded, with a count per status."""
    column = column or status_column(df.columns)
    if column is None:
        return None
    status = F.when(F.col(f"`{column}`").isin(*statuses), F.col(f"`{column}`"))
    counts = df.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"))  # at most one row per listed status, plus one
    listed = F.col("status").isNotNull()
    packed = F.sort_array(F.collect_list(F.when(listed, F.struct((-F.col("n")).alias("rank"), "status"))))
    summed = counts.agg(
        F.sum("n").alias("total"), F.sum(F.when(listed, F.col("n"))).alias("affected"), packed.alias("packed")
    ).where(F.col("affected") > 0)
    return _issues(
        summed,
        issue_type="returns_cancellations",
        severity="info",
        table_id=table_id,
        column=column,
        affected=F.col("affected"),
        total=F.col("total"),
        samples=F.transform("packed", lambda s: F.concat(s["status"], F.lit(": "), (-s["rank"]).cast("string"))),
        description=_text(F.col("affected"), " rows are cancelled or refunded."),
        action="Leave them out of sales figures.",
        id_parts=[F.lit(table_id)],
    )


# ---------------------------------------------------------------------------
# All checks of one table in one pass
# ---------------------------------------------------------------------------
def table_checks(
    df: DataFrame, table_id: str, *, date_formats: Sequence[str] = DATE_FORMATS, statuses: Sequence[str] = EXCLUDED_STATUSES,
    min_days: int = MIN_DAYS_IN_LAST_MONTH, samples: int = 3,
) -> DataFrame:
    """Issues of a table that rows alone show: no rows, invalid dates, an incomplete last month, excluded statuses.

    One pass: rows are summed up per month of the (first) date column, and the months to one row of
    figures, from which issue rows are made. Gives what ``empty_table``, ``invalid_dates``,
    ``incomplete_last_period`` and ``returns_and_cancellations`` give one by one. Evidence of
    invalid dates takes a pass of its own, further date columns of a fact one each.
    """
    dates, status = columns_with(df.columns, DATE_NAME_PARTS), status_column(df.columns)
    invalid = {c: ~is_missing(F.col(f"`{c}`").cast("string")) & as_date(df, c, date_formats).isNull() for c in dates}
    day = as_date(df, dates[0], date_formats) if dates and is_fact_name(table_id) else F.lit(None).cast("date")
    counted = {f"invalid_{i}": F.count_if(test) for i, test in enumerate(invalid.values())}
    if status:
        counted |= {f"status_{i}": F.count_if(F.col(f"`{status}`") == s) for i, s in enumerate(statuses)}
    months = df.withColumn("_day", day).groupBy(F.trunc("_day", "MM").alias("month")).agg(
        month_days("_day").alias("days"), F.count(F.lit(1)).alias("n"), *[c.alias(name) for name, c in counted.items()]
    )
    zero = F.lit(0).cast("long")
    figures = months.agg(
        last_month().alias("last"), F.coalesce(F.sum("n"), zero).alias("total"), *[F.coalesce(F.sum(name), zero).alias(name) for name in counted]
    )
    found, total = [], F.col("total")

    def add(when: Column, **fields) -> None:
        found.append(_found(when, table_id=table_id, total=fields.pop("total", total), **fields))

    add(
        total == 0, issue_type="empty_file", severity="blocking", column=None, affected=zero, total=zero, percentage=F.lit(100.0),
        description=f"{table_id} has no rows.", action="Provide rows for this table.", prefix="EMPTY",
    )
    for i, c in enumerate(dates):
        affected = F.col(f"invalid_{i}")
        evidence = _invalid_cells(df, c, invalid[c], samples)
        add(
            affected > 0, issue_type="invalid_date", severity="warning", column=c, affected=affected, samples=evidence,
            description=_text(c, f" of {table_id} has ", affected, " filled cells that are not a date."),
            action="Leave these rows out of monthly figures; the ledger records them.",
        )
    if dates and is_fact_name(table_id):
        last = F.col("last")
        month, recorded = month_key(last["month"]), days_recorded(last)
        add(
            last.isNotNull() & is_incomplete(last, min_days), issue_type="incomplete_period", severity="warning", column=dates[0], affected=last["n"],
            samples=F.array(_text(month, ": ", recorded, " of ", days_in_month(last), " days")),
            description=_text("The last month ", month, " has rows on ", recorded, " days only, so it is not comparable."),
            action="Compare closed full months only.",
        )
    if status:
        each = [F.when(F.col(f"status_{i}") > 0, F.struct((-F.col(f"status_{i}")).alias("rank"), F.lit(s).alias("status"))) for i, s in enumerate(statuses)]
        affected = reduce(Column.__add__, [F.col(f"status_{i}") for i in range(len(statuses))])
        listed = F.transform(F.sort_array(F.array_compact(F.array(*each))), lambda s: F.concat(s["status"], F.lit(": "), (-s["rank"]).cast("string")))
        add(
            affected > 0, issue_type="returns_cancellations", severity="info", column=status, affected=affected, samples=listed,
            description=_text(affected, " rows are cancelled or refunded."), action="Leave them out of sales figures.", id_parts=[table_id],
        )
    issues = _inlined(figures, found)
    for c in dates[1:] if is_fact_name(table_id) else ():
        issues = issues.unionByName(incomplete_last_period(df, table_id, column=c, min_days=min_days))
    return issues


def _invalid_cells(df: DataFrame, name: str, invalid: Column, k: int) -> Column | None:
    """The smallest invalid cells of a date column."""
    if not k:
        return None
    few = df.where(invalid).select(F.col(f"`{name}`").cast("string").alias("cell")).orderBy("cell").limit(k)
    return few.agg(F.sort_array(F.collect_list("cell")).alias("samples")).scalar()


# ---------------------------------------------------------------------------
# From column profiles
# ---------------------------------------------------------------------------
def _from_profile(rows: DataFrame, **fields) -> DataFrame:
    return _issues(
        rows, table_id=F.col("table_id"), column=F.col("name"), total=F.col("total_count"),
        samples=F.col("sample_values"), **fields,
    )


def leading_zeros(profile: DataFrame) -> DataFrame:
    return _from_profile(
        profile.where("has_leading_zeros"),
        issue_type="leading_zeros_preserved",
        severity="info",
        affected=F.col("total_count") - F.col("null_count"),
        percentage=round_to(F.lit(100.0) - F.col("null_percentage"), 2),
        description=_text("Values of ", F.col("name"), " start with zeros."),
        action="Read the column as text; a number would drop the zeros.",
        prefix="LEADING_ZEROS",
    )


def missing_values(profile: DataFrame, *, above_percent: float = 0.0) -> DataFrame:
    return _from_profile(
        profile.where((F.col("null_count") > 0) & (F.col("null_percentage") > above_percent)),
        issue_type="missing_values",
        severity="warning",
        affected=F.col("null_count"),
        percentage=F.col("null_percentage"),
        description=_text("Column ", F.col("name"), " has ", F.col("null_count"), " missing values."),
        action="Confirm whether missing cells mean zero, unknown or not applicable.",
    )


def numeric_as_text(profile: DataFrame, text_columns: Mapping[str, Sequence[str]]) -> DataFrame:
    """Columns stored as text that hold numbers only. ``text_columns`` lists the text columns per table."""
    stored_as_text = reduce(
        lambda test, item: test | ((F.col("table_id") == item[0]) & F.col("name").isin(*item[1])),
        [(t, c) for t, c in text_columns.items() if c],
        F.lit(False),
    )
    return _from_profile(
        profile.where(stored_as_text & (F.col("column_role") == "numeric")),
        issue_type="numeric_as_text",
        severity="info",
        affected=F.col("total_count") - F.col("null_count"),
        description=_text("Column ", F.col("name"), " is stored as text but holds numbers only."),
        action="Read the column as a number when it is measured.",
    )


def granularity_mismatch(df: DataFrame, table_id: str, *, key: str | None = None, samples: int = 3) -> DataFrame | None:
    """A fact whose key repeats has more than one row per key."""
    key = key or first_with(df.columns, ("id",))
    if key is None:
        return None
    counts = key_counts(df, key).where(F.col("key").isNotNull())
    summed = counts.agg(
        F.sum("n").alias("total"), F.sum(F.when(F.col("n") > 1, F.col("n"))).alias("affected"), F.count("key").alias("keys")
    ).where(F.col("affected") > 0)
    return _issues(
        summed,
        issue_type="granularity_mismatch",
        severity="warning",
        table_id=table_id,
        column=key,
        affected=F.col("affected"),
        total=F.col("total"),
        samples=_samples_of(counts.where(F.col("n") > 1), samples),
        description=_text(f"Key {key} of {table_id} repeats: ", F.col("total"), " rows for ", F.col("keys"), " keys."),
        action="Treat rows as lines and count orders by distinct key.",
    )


# ---------------------------------------------------------------------------
# From join diagnostics
# ---------------------------------------------------------------------------
def _orphan_fields(samples: Column | None) -> dict:
    return dict(
        issue_type="orphan_records",
        severity="warning",
        table_id=F.col("left_table"),
        column=F.col("left_key"),
        affected=F.col("orphans_left"),
        total=F.col("left_rows"),
        samples=samples,
        description=_text(
            F.col("orphans_left"), " rows of ", F.col("left_table"), " have a ", F.col("left_key"), " unknown to ", F.col("right_table"), ".",
        ),
        action="Join them as Unclassified rather than dropping them.",
        prefix="ORPHAN",
        id_parts=[F.col("left_table"), F.col("right_table"), F.col("left_key")],
    )


def _many_to_many_fields(samples: Column | None) -> dict:
    return dict(
        issue_type="many_to_many",
        severity="warning",
        table_id=F.col("right_table"),
        column=F.col("right_key"),
        affected=F.col("right_rows") - F.col("right_keys"),
        total=F.col("right_rows"),
        samples=samples,
        description=_text(
            F.col("right_table"), " has several rows for a ", F.col("right_key"), "; joining it as it is repeats fact rows."
        ),
        action="Reduce the dimension to one row per key before joining it.",
        prefix="M2M",
        id_parts=[F.col("left_table"), F.col("right_table"), F.col("right_key")],
    )


def _repeated_fields(samples: Column | None) -> dict:
    """As ``duplicate_keys``: the diagnostics of a link to a key count the same rows."""
    return dict(
        issue_type="duplicate_keys",
        severity="warning",
        table_id=F.col("right_table"),
        column=F.col("right_key"),
        affected=F.col("right_repeated_rows"),
        total=F.col("right_rows"),
        samples=samples,
        description=_text(F.col("right_key"), " should identify a row of ", F.col("right_table"), ", but repeats."),
        action="Reduce the dimension to one row per key before joining it.",
        prefix="DUP_KEY",
    )


def orphan_records(diagnostics: DataFrame, *, samples: Column | None = None) -> DataFrame:
    return _issues(diagnostics.where(F.col("orphans_left") > 0), **_orphan_fields(samples))


def many_to_many(diagnostics: DataFrame, *, samples: Column | None = None) -> DataFrame:
    return _issues(diagnostics.where(F.col("cardinality") == "many_to_many"), **_many_to_many_fields(samples))


def link_issues(diagnostics: DataFrame, *, identifying: Sequence[tuple[str, str, str]] = (), with_samples: bool = False) -> DataFrame:
    """Orphans, many-to-many links and repeated keys from one reading of the diagnostics.

    ``identifying`` lists links (left table, right table, right key) whose key should identify a row;
    ``with_samples`` takes the evidence from the columns of ``joins.link_samples``.
    """
    orphans, repeated = (F.col("orphan_samples"), F.col("repeated_samples")) if with_samples else (None, None)
    names = [F.col(c) for c in ("left_table", "right_table", "right_key")]
    identifies = reduce(Column.__or__, [reduce(Column.__and__, [c == v for c, v in zip(names, link)]) for link in identifying], F.lit(False))
    return _inlined(
        diagnostics,
        [
            _found(F.col("orphans_left") > 0, **_orphan_fields(orphans)),
            _found(F.col("cardinality") == "many_to_many", **_many_to_many_fields(repeated)),
            _found(identifies & (F.col("right_repeated_rows") > 0), **_repeated_fields(repeated)),
        ],
    )


# ---------------------------------------------------------------------------
# Whole audit
# ---------------------------------------------------------------------------
def audit_tables(
    tables: Mapping[str, DataFrame],
    *,
    profile: DataFrame | None = None,
    diagnostics: DataFrame | None = None,
    samples: int = 3,
    declared_checks: bool = False,
) -> DataFrame:
    """Issue records of all checks over a set of tables.

    A table is read once for the checks of its rows, once for its profile, and once
    per key that links it to another; the last pass serves repeated keys, orphans and
    many-to-many links alike. Evidence samples take passes of their own.

    ``declared_checks`` adds missing values, numbers stored as text and repeated
    fact keys, which an audit does not report by default.
    """
    profile = profile if profile is not None else profile_tables(tables, samples=5 if samples else 0)
    links = candidate_links(tables)
    if diagnostics is None:
        diagnostics = link_diagnostics(tables, links)
    found: list[DataFrame | None] = []
    linked = {(link.dimension, link.right_key): left for left, link in reversed(links)}
    identifying = []
    for table_id, df in tables.items():
        found.append(table_checks(df, table_id, samples=samples))
        key = first_with(df.columns, ("id",))
        if is_keyed_dimension_name(table_id) and key is not None:
            if diagnostics is not None and (table_id, key) in linked:
                identifying.append((linked[table_id, key], table_id, key))
            else:
                found.append(duplicate_keys(df, table_id, key=key, samples=samples))
        if declared_checks and is_fact_name(table_id):
            found.append(granularity_mismatch(df, table_id, samples=samples))
    found.append(leading_zeros(profile))
    if declared_checks:
        text = {t: [f.name for f in df.schema if f.dataType.simpleString() == "string"] for t, df in tables.items()}
        found += [missing_values(profile), numeric_as_text(profile, text)]
    if diagnostics is not None:
        sampled = link_samples(tables, links, samples) if samples else None
        if sampled is not None:  # one row per link
            diagnostics = diagnostics.join(F.broadcast(sampled), ["left_table", "right_table", "left_key", "right_key"], "left")
        found.append(link_issues(diagnostics, identifying=identifying, with_samples=sampled is not None))
    return reduce(DataFrame.unionByName, [f for f in found if f is not None])


def quality_report(issues: DataFrame, tables: Mapping[str, DataFrame]) -> DataFrame:
    """One row for the whole audit: blocking issues, time coverage, incomplete last period."""
    dated = [
        df.agg(F.min(as_date(df, c)).alias("first"), F.max(as_date(df, c)).alias("last"))
        for t, df in tables.items()
        if is_fact_name(t)
        for c in columns_with(df.columns, DATE_NAME_PARTS)
    ]
    if dated:
        covered = reduce(DataFrame.unionByName, dated)
        span = covered.agg(F.struct(F.min("first").alias("first"), F.max("last").alias("last")).alias("span")).scalar()
    else:
        span = F.struct(F.lit(None).alias("first"), F.lit(None).alias("last"))
    incomplete = F.col("issue_type") == "incomplete_period"
    rolled = issues.agg(
        F.count(F.lit(1)).alias("issue_count"),
        F.coalesce(F.bool_or(F.col("severity") == "blocking"), F.lit(False)).alias("has_blocking_issues"),
        F.coalesce(F.bool_or(incomplete), F.lit(False)).alias("is_last_period_incomplete"),
        F.max(F.when(incomplete, F.col("description"))).alias("incomplete_period_details"),
    )
    dates = {"coverage_start": F.col("span.first"), "coverage_end": F.col("span.last")}
    return conform(rolled.withColumn("span", span).withColumns(dates), QUALITY_REPORT)
