"""A whole audited run: from raw tables to validated results and report tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from auditflow.functions.naming import DATE_NAME_PARTS, KEY_NAME_PARTS, columns_with, first_with, pick_fact
from auditflow.functions.parsing import fill_unknown_members
from auditflow.operators import ledger, metrics, profile, quality, report, validate
from auditflow.operators.joins import Link, chain_checks, join_chain, join_check, link_diagnostics, relationship
from auditflow.operators.periods import infer_cutoff
from auditflow.plans import methods
from auditflow.records import RUN_EVENT, conform
from auditflow.session import durable
from auditflow.sources.manifest import file_changes, table_manifest


@dataclass
class AuditRun:
    """DataFrames of a run. Nothing is computed until one of them is used."""

    profile: DataFrame
    table_profile: DataFrame
    issues: DataFrame
    quality_report: DataFrame
    relationships: DataFrame | None
    ledger: DataFrame
    quarantine: DataFrame
    join_checks: DataFrame | None
    analytical: DataFrame
    results: dict[str, DataFrame]
    result_records: DataFrame
    result_values: DataFrame
    checks: DataFrame
    report_status: DataFrame
    cards: DataFrame
    charts: DataFrame
    chart_records: DataFrame
    findings: DataFrame | None
    dashboard_checks: DataFrame
    dashboard: DataFrame
    provenance: DataFrame
    file_changes: DataFrame | None = None

    def events(self, run_id: str, *, at: Column | None = None, first_event: int = 1) -> DataFrame:
        """The run as ``RUN_EVENT`` rows, one per stage it went through, numbered from ``first_event``.

        A run whose results are rejected fails after validation; one whose dashboard isn't valid
        fails while it is built. Each event holds counts of what its stage made. All have the time ``at``
        (default: when they are computed). Computes the report status and the dashboard's. ``runlog`` and ``streaming.runs`` read them like any log.
        """
        # One row each, used by several events: computed once.
        status = durable(self.report_status.select("overall_status", "failed_checks"))
        dashboard = durable(self.dashboard.select("is_dashboard_valid"))
        failed = status.where("failed_checks > 0")
        rejected, approved = F.col("overall_status") == "rejected", F.col("overall_status") != "rejected"
        went_on = status.select(approved).scalar()
        stages = [
            ("UPLOADED", "Tables read", self.table_profile.agg(F.count(F.lit(1)).alias("tables"), F.sum("row_count").alias("rows"))),
            ("PROFILED", "Tables profiled and checked", self.issues.agg(F.count(F.lit(1)).alias("issues"))),
            ("PLAN_READY", "Plan ready", self.result_records.agg(F.count(F.lit(1)).alias("steps"))),
            ("PREPARING", "Fact prepared", self.ledger.agg(F.count(F.lit(1)).alias("steps"), F.sum("rows_excluded").alias("rows_excluded"))),
            ("ANALYZING", "Results computed", self.result_values.agg(F.count(F.lit(1)).alias("figures"))),
            ("VALIDATING", "Results checked", self.checks.agg(F.count(F.lit(1)).alias("checks"))),
            ("FAILED", "Results rejected", failed.where(rejected)),
            ("VALIDATED", "Results approved", status.where(approved)),
            ("BUILDING_DASHBOARD", "Components built", self.cards.agg(F.count(F.lit(1)).alias("cards")).where(went_on)),
            ("FAILED", "Dashboard not valid", dashboard.where("NOT is_dashboard_valid").where(went_on)),
            ("READY", "Dashboard ready", dashboard.where("is_dashboard_valid").where(went_on)),
        ]
        made = [
            counts.select(
                F.lit(first_event + i).cast("long").alias("event_id"),
                F.lit(run_id).alias("run_id"),
                F.lit(stage).alias("stage"),
                F.lit("ERROR" if stage == "FAILED" else "INFO").alias("level"),
                F.lit(message).alias("message"),
                F.to_json(F.struct("*")).alias("metadata_json"),
                (F.current_timestamp() if at is None else at).alias("created_at"),
            )
            for i, (stage, message, counts) in enumerate(stages)
        ]
        return conform(reduce(DataFrame.unionByName, made), RUN_EVENT)


def run_audit(
    spark: SparkSession,
    tables: Mapping[str, DataFrame],
    *,
    baseline: str,
    current: str,
    fact: str | None = None,
    links: Sequence[Link] | None = None,
    dimensions: Sequence[str] = ("channel", "segment"),
    metric: str = "net_sales",
    cutoff: date | str | None = None,
    samples: int = 3,
    plan: Sequence[methods.Step] | None = None,
    keep_analytical: bool = False,
    store_in: str | None = None,
    files: DataFrame | None = None,
    files_before: DataFrame | None = None,
) -> AuditRun:
    """Audit, prepare, compute, validate and report.

    Without ``links`` the fact is joined to every dimension it shares a key with.
    Without ``cutoff`` one small job finds the last closed day of the fact, so that
    the cutoff is a literal in all plans that follow.

    Of a given ``plan`` the admissible steps run, or the default plan if they are too
    few (``methods.admitted``).

    ``analytical`` feeds every metric. With ``keep_analytical`` it and all results are
    computed once into the shared checkpoint folder, which pays off when several parts
    of the run are used; otherwise every part reads the source tables anew.

    ``store_in`` names a new folder for the fact: usable and excluded rows are written there in
    one pass, which also counts the ledger and the cells of amounts; all that follows reads the
    stored rows.

    ``files`` and ``files_before`` are fingerprints (path, sha256) of the source files now and as they
    were admitted; if one of them changed or is missing, all results are rejected.
    """
    fact = fact or pick_fact(list(tables))
    date_col = first_with(tables[fact].columns, DATE_NAME_PARTS)
    if links is None:
        keys = sorted(columns_with(tables[fact].columns, KEY_NAME_PARTS))
        links = [Link(k, t, k) for t, df in tables.items() if t != fact for k in keys if k in df.columns]
    if cutoff is None and date_col:
        cutoff = infer_cutoff(tables[fact], date_col)

    profiled = profile.profile_tables(tables, samples=samples)
    diagnostics = link_diagnostics(tables, [(_owner(fact, tables, links, link), link) for link in links])
    issues = quality.audit_tables(tables, profile=profiled, samples=samples)

    if store_in:
        written = ledger.write_with_ledger(tables[fact], store_in, date_col=date_col, cutoff=cutoff)
    else:
        flagged = ledger.flag_exclusions(tables[fact], date_col=date_col, cutoff=cutoff)
        kept = ledger.keep_usable(tables[fact], date_col=date_col, cutoff=cutoff)
        has_amounts = any(c in tables[fact].columns for c in ledger.AMOUNT_COLUMNS)
        written = ledger.Written(
            usable=kept,
            quarantine=ledger.quarantined_rows(flagged, cutoff=cutoff),
            ledger=ledger.exclusion_ledger(flagged, date_col=date_col, cutoff=cutoff),
            amount_counts=ledger.amount_cast_counts(kept) if has_amounts else None,
        )
    usable = ledger.with_amounts(written.usable)
    analytical = fill_unknown_members(join_chain(usable, tables, links))
    if keep_analytical:
        analytical = durable(analytical)

    joins = chain_checks(usable, tables, links, metric=metric, left_table=fact)

    default = methods.default_plan(baseline, current, metric=metric, dimensions=dimensions)
    plan = default if plan is None else methods.admitted(plan, analytical.columns, default)
    needed = {methods.TREND, methods.COMPARISON, methods.DYNAMICS, methods.FORECAST}
    if not needed <= {s.step_id for s in plan}:  # the report needs these
        plan = [*plan, *[s for s in default if s.step_id in needed | {methods.SUMMARY} and s.step_id not in {p.step_id for p in plan}]]
    results = methods.run_plan(analytical, plan)
    if keep_analytical:
        results = {result_id: durable(df) for result_id, df in results.items()}
    records = methods.results_table(spark, plan, results)
    values = methods.result_values(plan, results)

    comparison = results[f"RES_{methods.COMPARISON}"]
    breakdowns = None
    for step in plan:
        if step.category == "dimension_breakdown":
            part = results[step.result_id].withColumn("result_id", F.lit(step.result_id))
            breakdowns = part if breakdowns is None else breakdowns.unionByName(part)
    eligibility = results[f"RES_{methods.FORECAST}"].withColumn("result_id", F.lit(f"RES_{methods.FORECAST}"))

    checks = validate.finite_checks(values).unionByName(validate.sample_size_checks(eligibility))
    if written.amount_counts is not None:
        # On the stored cells: the exact amounts that results are made of are always finite.
        checks = checks.unionByName(validate.source_amount_checks(records, written.amount_counts))
    changes = None
    if files is not None and files_before is not None:
        changes = file_changes(files, files_before)
        checks = checks.unionByName(validate.source_file_checks(records, changes))
    if breakdowns is not None:
        # The expected change comes from the fact before any join.
        expected = metrics.period_comparison(usable, baseline=baseline, current=current, metric=metric)
        checks = checks.unionByName(validate.reconciliation_checks(validate.reconcile(breakdowns, expected)))
    if joins is not None:
        checks = checks.unionByName(validate.join_safety_checks(joins))
    statuses = validate.result_statuses(records, checks)

    drivers = report.top_driver(breakdowns) if breakdowns is not None else None
    driver_results = {s.parameters["dimensions"]: s.result_id for s in plan if s.category == "dimension_breakdown"}
    # Only what validation let through is shown.
    cards = validate_shown(report.metric_cards(comparison, drivers, driver_results=driver_results), statuses)
    cards = report.with_status(cards, statuses)
    found = report.findings(comparison, drivers, driver_results=driver_results) if drivers is not None else None
    points = report.chart_datasets(
        results[f"RES_{methods.TREND}"], breakdowns, results[f"RES_{methods.DYNAMICS}"]
    )
    described = report.chart_records(
        points, baseline=baseline, current=current, driver_results=driver_results,
        primary=dimensions[0] if dimensions else None, metric=metric,
    )
    shown = report.with_status(validate_shown(described, statuses), statuses)

    def of_run(df: DataFrame) -> DataFrame:
        return df.withColumn("run", F.lit(fact))

    components = of_run(report.dashboard_components(cards, shown))
    dashboard_checks = validate.presentation_checks(components, of_run(statuses), run=["run"])
    dashboard = validate.presentation_status(dashboard_checks, validate.period_alignment(components, run=["run"]), run=["run"])

    steps = written.ledger
    joined = [link.dimension for link in links if link.dimension in tables] if joins is not None else []
    manifested = table_manifest(tables).withColumnRenamed("table_name", "table_id")
    way = report.provenance(
        fact=fact, sources=manifested, ledger=steps, joins=joins, joined=list(dict.fromkeys(joined)), results=statuses, cards=cards
    )
    if joins is not None and diagnostics is not None:
        # Exclusion steps are numbered from 1, one per rule.
        rules = ledger.exclusion_rules(tables[fact], date_col=date_col, cutoff=cutoff)
        made = ledger.join_steps(joins, diagnostics, list(dict.fromkeys(joined)), first_index=len(rules.tests(tables[fact])) + 1)
        steps = steps.unionByName(made)
    return AuditRun(
        profile=profiled,
        table_profile=profile.table_profile(profiled, tables),
        issues=issues,
        quality_report=quality.quality_report(issues, tables),
        relationships=None if diagnostics is None else relationship(diagnostics),
        ledger=steps,
        quarantine=written.quarantine,
        join_checks=None if joins is None else join_check(joins),
        analytical=analytical,
        results=results,
        result_records=statuses,
        result_values=values,
        checks=checks,
        report_status=validate.report_status(checks),
        cards=cards,
        charts=points.join(shown.select("chart_id"), "chart_id", "left_semi"),
        chart_records=shown,
        findings=found if found is None else validate_shown(found, statuses),
        dashboard_checks=dashboard_checks,
        dashboard=dashboard,
        provenance=way,
        file_changes=changes,
    )


def _owner(fact: str, tables: Mapping[str, DataFrame], links: Sequence[Link], link: Link) -> str:
    """The table that a link starts from: the fact, or a dimension that brings the key in."""
    candidates = [fact, *[other.dimension for other in links if other.dimension != link.dimension]]
    return next(t for t in candidates if link.left_key in tables[t].columns)


def validate_shown(shown: DataFrame, statuses: DataFrame) -> DataFrame:
    """Cards or findings whose result is approved."""
    approved = statuses.where(F.col("validation_status").isin("approved", "approved_with_warnings"))
    return shown.join(approved.select("result_id"), "result_id", "left_semi")
