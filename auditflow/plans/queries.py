"""Named queries over the star-schema tables, one or more per operator.

Each takes a session and the folder of the tables, and reads whole tables.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from auditflow.functions import parsing, text
from auditflow.functions.naming import table_name_of
from auditflow.operators import joins, ledger, lineage, metrics, periods, profile, profile_state, quality, questions, report, runlog, validate
from auditflow.operators.joins import Link
from auditflow.plans import methods, views
from auditflow.session import durable, shared_folder
from auditflow.sources import manifest, store

Query = Callable[[SparkSession, str], DataFrame]

BASELINE, CURRENT = "2001-03", "2001-07"
DIRTY_CUTOFF = "2001-05-31"
CHANNELS = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
SECRETS = ("tion", "the", "que")
EVENT_TRANSITIONS = {
    "signup": ("view", "click"),
    "view": ("click", "purchase", "view"),
    "click": ("purchase", "view"),
    "purchase": ("view",),
    "error": (),
}
# What a step builds on.
PLAN_DEPENDENCIES = {
    methods.SUMMARY: [],
    methods.TREND: [methods.SUMMARY],
    methods.COMPARISON: [methods.TREND],
    methods.BREAKDOWN_CHANNEL: [methods.COMPARISON, methods.SUMMARY],
}
ISSUE_COLUMNS = ("id", "issue_type", "severity", "table_id", "column", "affected_rows", "total_rows", "affected_percentage")

QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _iso(c: Column | str) -> Column:
    return F.date_format(c, "yyyy-MM-dd")


def _moment(c: str) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def _change(df: DataFrame, dimensions) -> DataFrame:
    # The stored date, not the clean one, so that the months reach the scan.
    return metrics.period_breakdown(df, dimensions, baseline=BASELINE, current=CURRENT, date_col="order_date")


def _change_with_customers(spark: SparkSession, sf_dir: str, dimensions) -> DataFrame:
    return metrics.breakdown_through_key(
        views.prepared_sales(spark, sf_dir), views.customers(spark, sf_dir), "customer_id", dimensions,
        baseline=BASELINE, current=CURRENT, date_col="order_date",
    )


def _comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.period_comparison(
        views.prepared_sales(spark, sf_dir), baseline=BASELINE, current=CURRENT, date_col="order_date"
    )


def _with_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.safe_left_join(
        views.prepared_sales(spark, sf_dir), views.customers(spark, sf_dir), "customer_id", dim_name="customers"
    )


# ---------------------------------------------------------------------------
# Metrics
# ---------------------------------------------------------------------------
@query
def metric_summary(spark, sf_dir):
    return metrics.metric_summary(views.prepared_sales(spark, sf_dir))


@query
def monthly_trend(spark, sf_dir):
    return metrics.monthly_trend(views.prepared_sales(spark, sf_dir))


@query
def period_comparison(spark, sf_dir):
    return _comparison(spark, sf_dir)


@query
def breakdown_channel(spark, sf_dir):
    return _change(views.prepared_sales(spark, sf_dir), "channel")


@query
def breakdown_segment(spark, sf_dir):
    return _change_with_customers(spark, sf_dir, "segment")


@query
def breakdown_multi(spark, sf_dir):
    return _change_with_customers(spark, sf_dir, ["channel", "segment", "region", "campaign"])


@query
def customer_dynamics_day(spark, sf_dir):
    return metrics.customer_dynamics(views.prepared_sales(spark, sf_dir))


@query
def customer_dynamics_month(spark, sf_dir):
    return metrics.customer_dynamics(views.prepared_sales(spark, sf_dir), grain="month")


@query
def forecast_eligibility(spark, sf_dir):
    return metrics.forecast_eligibility(views.prepared_sales(spark, sf_dir))


@query
def forecast_ineligible(spark, sf_dir):
    return metrics.forecast_eligibility(views.table(spark, sf_dir, "events"), date_col="ts")


@query
def pareto_customers(spark, sf_dir):
    return metrics.concentration(views.table(spark, sf_dir, "orders"), "o_custkey", metric="o_totalprice")


@query
def pareto_channels(spark, sf_dir):
    return metrics.concentration(views.prepared_sales(spark, sf_dir), "channel")


@query
def month_channel_pivot(spark, sf_dir):
    pivot = metrics.month_pivot(
        views.table(spark, sf_dir, "orders"), "o_orderpriority", CHANNELS, metric="o_totalprice", date_col="o_orderdate"
    )
    names = {c: c[2:].lower().replace(" ", "_") for c in CHANNELS}
    return pivot.withColumnsRenamed(names)


@query
def filtered_totals(spark, sf_dir):
    condition = questions.slice_condition(region_keyword="norte", channel_keyword="wholesale")
    return metrics.filtered_totals(views.labelled_sales(spark, sf_dir), condition, weight="lines")


@query
def amount_statistics(spark, sf_dir):
    amount = F.col("o_totalprice")
    return views.table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("channel")).agg(
        F.count_distinct("o_custkey").alias("customers"),
        F.count(F.lit(1)).alias("orders"),
        F.min(amount).alias("min_amount"),
        F.max(amount).alias("max_amount"),
        F.round(F.avg(amount), 2).alias("mean_amount"),
        F.round(parsing.sample_std(amount), 2).alias("std_amount"),
    )


# ---------------------------------------------------------------------------
# Parsing, exclusions, periods
# ---------------------------------------------------------------------------
@query
def lenient_parsing(spark, sf_dir):
    cells = views.untidy_amounts(spark, sf_dir)
    return cells.select(
        "order_id",
        parsing.parse_number(F.col("amount")).cast("double").alias("amount"),
        parsing.as_amount(cells, "amount").cast("double").alias("amount_or_zero"),
        _iso(parsing.parse_date(F.col("order_date"))).alias("order_date"),
        parsing.is_missing(F.col("order_date")).alias("date_is_missing"),
    )


@query
def amount_cast_counts(spark, sf_dir):
    return ledger.amount_cast_counts(views.untidy_amounts(spark, sf_dir), ["amount"])


def _flagged(spark, sf_dir):
    return ledger.flag_exclusions(views.dirty_orders(spark, sf_dir), cutoff=DIRTY_CUTOFF)


@query
def exclusion_ledger(spark, sf_dir):
    return ledger.exclusion_ledger(_flagged(spark, sf_dir), cutoff=DIRTY_CUTOFF).select(
        "step_index", "transformation_id", "operation", "rows_before", "rows_after", "rows_excluded", "exclusion_reason"
    )


@query
def quarantine_rows(spark, sf_dir):
    return ledger.quarantined_rows(_flagged(spark, sf_dir), cutoff=DIRTY_CUTOFF).select(
        "order_id", "order_date", "status", "exclusion_reason"
    )


def _written(spark, sf_dir) -> ledger.Written:
    return ledger.write_with_ledger(
        views.dirty_orders(spark, sf_dir), shared_folder(spark, "orders"), cutoff=DIRTY_CUTOFF, amount_cols=["net_sales"]
    )


@query
def written_ledger(spark, sf_dir):
    """The ledger counted while the rows were stored, with the smallest excluded rows of each step."""
    named = F.transform("exclusion_samples", lambda s: F.concat(s["order_id"], F.lit("="), F.array_join(F.map_values(F.map_filter(s, lambda k, _: k != "order_id")), "")))
    return _written(spark, sf_dir).ledger.select(
        "step_index", "transformation_id", "operation", "rows_before", "rows_after", "rows_excluded", "exclusion_reason",
        F.array_join(named, "; ").alias("samples"),
    )


@query
def written_rows(spark, sf_dir):
    """Rows and sales of the stored usable part and of each excluded part."""
    written = _written(spark, sf_dir)
    kept = written.usable.select(F.lit("usable").alias("outcome"), "net_sales")
    both = kept.unionByName(written.quarantine.select(F.col("exclusion_reason").alias("outcome"), "net_sales"))
    return both.groupBy("outcome").agg(F.count(F.lit(1)).alias("orders"), F.sum("net_sales").cast("double").alias("net_sales"))


@query
def written_amount_counts(spark, sf_dir):
    """Cells of the stored amounts of usable rows, counted while they were stored."""
    untidy = views.untidy_amounts(spark, sf_dir)
    return ledger.write_with_ledger(untidy, shared_folder(spark, "amounts"), amount_cols=["amount"], samples=0).amount_counts


@query
def incomplete_period(spark, sf_dir):
    last = periods.incomplete_period(views.table(spark, sf_dir, "orders"), "o_orderdate")
    return last.withColumn("cutoff", _iso("cutoff"))


@query
def time_coverage(spark, sf_dir):
    covered = periods.time_coverage(views.dirty_orders(spark, sf_dir), "order_date")
    return covered.withColumns({"coverage_start": _iso("coverage_start"), "coverage_end": _iso("coverage_end")})


# ---------------------------------------------------------------------------
# Joins
# ---------------------------------------------------------------------------
def _diagnostics(spark, sf_dir, **options):
    found = joins.join_diagnostics(
        views.dirty_orders(spark, sf_dir), views.dirty_customers(spark, sf_dir), "customer_id",
        metric="net_sales", left_table="orders", right_table="customers", **options,
    )
    return joins.join_check(found).drop("warning")


@query
def unsafe_join_inflation(spark, sf_dir):
    return _diagnostics(spark, sf_dir)


@query
def safe_join_check(spark, sf_dir):
    return _diagnostics(spark, sf_dir, deduplicated=True)


def _by_branch(joined: DataFrame) -> DataFrame:
    return joined.groupBy(parsing.known_member(F.col("customer_name")).alias("customer_name")).agg(
        F.count(F.lit(1)).alias("orders"), F.sum("net_sales").cast("double").alias("net_sales")
    )


@query
def safe_join_rows(spark, sf_dir):
    return _by_branch(
        joins.safe_left_join(
            views.dirty_orders(spark, sf_dir), views.dirty_customers(spark, sf_dir), "customer_id",
            order_by=["customer_name"], keep="latest",
        )
    )


@query
def safe_join_salted(spark, sf_dir):
    return _by_branch(
        joins.safe_left_join(
            views.dirty_orders(spark, sf_dir), views.dirty_customers(spark, sf_dir), "customer_id",
            order_by=["customer_name"], salt_over=15,
        )
    )


@query
def join_chain(spark, sf_dir):
    orders = views.sales(spark, sf_dir).withColumn("customer_id", views.padded_id(F.col("customer_id")))
    nations = views.table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("nation_id"), F.col("n_name").alias("customer_name")
    )
    tables = {"customers": views.dirty_customers(spark, sf_dir), "products": views.products(spark, sf_dir), "nations": nations}
    links = [
        Link("customer_id", "customers", "customer_id"),
        Link("product_id", "products", "product_id"),
        Link("nation_id", "nations", "nation_id"),
        Link("campaign_id", "campaigns", "campaign_id"),
    ]
    joined = joins.join_chain(orders, tables, links, order_by={"customers": ["customer_name"]})
    joined = parsing.fill_unknown_members(joined)
    return joined.groupBy("segment", "category_id", F.col("nations_customer_name").alias("nation")).agg(
        F.count(F.lit(1)).alias("order_lines"), F.sum("net_sales").cast("double").alias("net_sales")
    )


@query
def orphans_left(spark, sf_dir):
    return joins.orphan_keys(views.dirty_orders(spark, sf_dir), views.dirty_customers(spark, sf_dir), "customer_id")


@query
def orphans_right(spark, sf_dir):
    return joins.unused_keys(views.dirty_orders(spark, sf_dir), views.dirty_customers(spark, sf_dir), "customer_id")


@query
def match_rates(spark, sf_dir):
    tables = {
        "orders": views.dirty_orders(spark, sf_dir),
        "customers": views.dirty_customers(spark, sf_dir),
        "documents": views.table(spark, sf_dir, "documents"),
        "labels": views.table(spark, sf_dir, "labels"),
        "order_headers": views.table(spark, sf_dir, "orders"),
        "order_lines": views.table(spark, sf_dir, "lineitem"),
    }
    links = [
        ("orders", Link("customer_id", "customers", "customer_id")),
        ("documents", Link("doc_id", "labels", "doc_id")),
        ("order_headers", Link("o_orderkey", "order_lines", "l_orderkey")),
    ]
    return joins.link_diagnostics(tables, links).select(
        "left_table", "right_table", "left_rows", "right_keys", "orphans_left", "orphans_right", "match_rate_left", "match_rate_right"
    )


def _star(spark, sf_dir):
    return {
        "orders": views.sales(spark, sf_dir).withColumn("customer_id", views.padded_id(F.col("customer_id"))),
        "customers": views.dirty_customers(spark, sf_dir),
        "products": views.products(spark, sf_dir),
    }


@query
def relationship_inference(spark, sf_dir):
    return joins.infer_relationships(_star(spark, sf_dir))


# ---------------------------------------------------------------------------
# Profiles and quality
# ---------------------------------------------------------------------------
def _text_tables(spark, sf_dir):
    return {
        "orders": views.text_orders(spark, sf_dir),
        "customers": views.dirty_customers(spark, sf_dir),
        "parts": views.text_parts(spark, sf_dir),
    }


def _profile(spark, sf_dir):
    return profile.profile_tables(_text_tables(spark, sf_dir), samples=0)


@query
def column_profile(spark, sf_dir):
    return _readable(_profile(spark, sf_dir)).drop("sample_values")


def _readable(profiled):
    rounded = {c: F.round(c, 2) for c in ("min_num", "max_num", "mean_value", "std_dev")}
    return profiled.withColumns({**rounded, **{c: _iso(c) for c in ("min_date", "max_date")}})


@query
def merged_profile(spark, sf_dir):
    """Profiles from stored states: orders by month, some months delivered twice, customers by segment, parts by size."""
    parts = {"orders": F.left("order_date", F.lit(7)), "customers": F.col("segment"), "parts": F.col("size")}
    merged = []
    for table_id, df in _text_tables(spark, sf_dir).items():
        folder = shared_folder(spark, f"profile-{table_id}")
        profile_state.add_load(df, folder, "load-1", part=parts[table_id])
        if table_id == "orders":
            profile_state.add_load(df.where(F.col("order_date") >= CURRENT), folder, "load-2", part=parts[table_id])
        merged.append(profile_state.merged_profile(spark, folder, table_id, df.columns, samples=4))
    whole = _readable(reduce(DataFrame.unionByName, merged))
    return whole.withColumn("samples", F.array_join("sample_values", "|")).drop("sample_values")


@query
def column_samples(spark, sf_dir):
    """The smallest values of each column, as its profile shows them."""
    found = profile.profile_tables(_text_tables(spark, sf_dir), samples=4)
    return found.select("table_id", "name", F.array_join("sample_values", "|").alias("samples"))


@query
def table_profiles(spark, sf_dir):
    rolled = profile.table_profile(_profile(spark, sf_dir), _text_tables(spark, sf_dir))
    listed = ("date_columns", "id_columns", "numeric_columns", "categorical_columns")
    return rolled.select(
        "table_id", "display_name", "row_count", "column_count", "row_semantic_meaning",
        *[F.concat_ws(",", c).alias(c) for c in listed],
    )


@query
def catalog_summary(spark, sf_dir):
    return report.catalog_summary(_profile(spark, sf_dir))


@query
def duplicate_keys(spark, sf_dir):
    return quality.duplicate_keys(views.dirty_customers(spark, sf_dir), "customers", samples=0).select(*ISSUE_COLUMNS)


@query
def status_issue(spark, sf_dir):
    issues = quality.returns_and_cancellations(views.dirty_orders(spark, sf_dir), "orders")
    return issues.select(*ISSUE_COLUMNS, F.concat_ws("; ", "evidence_samples").alias("evidence"))


def _audited(spark, sf_dir):
    return {
        "orders": views.dirty_orders(spark, sf_dir),
        "customers": views.dirty_customers(spark, sf_dir),
        "parts": views.text_parts(spark, sf_dir),
    }


@query
def quality_issues(spark, sf_dir):
    return quality.audit_tables(_audited(spark, sf_dir), samples=0).select(*ISSUE_COLUMNS)


@query
def quality_issues_with_evidence(spark, sf_dir):
    return quality.audit_tables(_audited(spark, sf_dir)).select(
        "id", F.concat_ws("; ", "evidence_samples").alias("evidence")
    )


@query
def declared_issues(spark, sf_dir):
    tables = {**_audited(spark, sf_dir), "orders": views.text_orders(spark, sf_dir)}
    profiled = profile.profile_tables(tables, samples=0).withColumn("sample_values", F.array().cast("array<string>"))
    stored_as_text = {"orders": ["order_date", "amount", "channel"], "parts": ["part_name", "size", "price"]}
    granularity = quality.granularity_mismatch(views.sales(spark, sf_dir), "sales", key="order_id", samples=0)
    return (
        quality.missing_values(profiled)
        .unionByName(quality.numeric_as_text(profiled, stored_as_text))
        .unionByName(granularity)
        .select(*ISSUE_COLUMNS)
    )


@query
def quality_report(spark, sf_dir):
    tables = _audited(spark, sf_dir)
    rolled = quality.quality_report(quality.audit_tables(tables, samples=0), tables)
    return rolled.withColumns({"coverage_start": _iso("coverage_start"), "coverage_end": _iso("coverage_end")}).drop(
        "incomplete_period_details"
    )


# ---------------------------------------------------------------------------
# Validation
# ---------------------------------------------------------------------------
@query
def finite_check(spark, sf_dir):
    return validate.finite_checks(views.order_figures(spark, sf_dir))


def _breakdown_results(spark, sf_dir):
    """Breakdowns as results, and one that lost a member on the way."""
    parts = _change_with_customers(spark, sf_dir, ["channel", "segment", "region"])
    own = F.concat(F.lit("RES_"), F.upper("dimension"))
    lossy = F.when((F.col("dimension") == "channel") & (F.col("dimension_value") != "5-LOW"), F.lit("RES_CHANNEL_PARTIAL"))
    return parts.withColumn("result_id", F.explode(F.array_compact(F.array(own, lossy))))


@query
def reconciliation_check(spark, sf_dir):
    return validate.reconcile(_breakdown_results(spark, sf_dir), _comparison(spark, sf_dir))


def _customer_statuses(spark, sf_dir):
    checks = validate.finite_checks(views.order_figures(spark, sf_dir))
    return validate.result_statuses(views.customer_results(spark, sf_dir), checks)


@query
def sample_size_check(spark, sf_dir):
    """Events and orders as results: which history is too short to forecast from."""
    events = views.table(spark, sf_dir, "events")
    eligibility = metrics.forecast_eligibility(events, date_col="ts").withColumn("result_id", F.lit("RES_EVENTS"))
    orders = metrics.forecast_eligibility(views.table(spark, sf_dir, "orders"), date_col="o_orderdate")
    both = eligibility.unionByName(orders.withColumn("result_id", F.lit("RES_ORDERS")))
    return validate.sample_size_checks(both)


@query
def join_safety(spark, sf_dir):
    """A raw and a deduplicated join as checks of a run."""
    raw = joins.join_diagnostics(
        views.dirty_orders(spark, sf_dir), views.dirty_customers(spark, sf_dir), "customer_id",
        metric="net_sales", right_table="raw_customers",
    )
    safe = joins.join_diagnostics(
        views.dirty_orders(spark, sf_dir), views.dirty_customers(spark, sf_dir), "customer_id",
        metric="net_sales", right_table="customers", deduplicated=True,
    )
    return validate.join_safety_checks(raw.unionByName(safe)).drop("result_id")


@query
def status_rollup(spark, sf_dir):
    return _customer_statuses(spark, sf_dir).select("result_id", "run_id", "failed_checks", "validation_status")


@query
def run_report_status(spark, sf_dir):
    runs = views.customer_results(spark, sf_dir).select("result_id", "run_id")
    checks = validate.finite_checks(views.order_figures(spark, sf_dir)).join(runs, "result_id")
    return validate.report_status(checks, by=["run_id"])


@query
def approved_only(spark, sf_dir):
    return joins.approved_only(_customer_statuses(spark, sf_dir)).select("result_id", "validation_status")


@query
def results_summary(spark, sf_dir):
    figures = views.order_figures(spark, sf_dir).withColumn("value", F.col("value").try_cast("decimal(18,2)"))
    return report.results_summary(_customer_statuses(spark, sf_dir), figures).select("result_id", "validation_status", "figure_json")


@query
def presentation_components(spark, sf_dir):
    return validate.presentation_checks(
        views.event_components(spark, sf_dir), views.event_results(spark, sf_dir), run=["run_id"]
    )


@query
def presentation_integrity(spark, sf_dir):
    components = views.event_components(spark, sf_dir)
    checks = validate.presentation_checks(components, views.event_results(spark, sf_dir), run=["run_id"])
    return validate.presentation_status(checks, validate.period_alignment(components, run=["run_id"]), run=["run_id"])


def _gated(spark, sf_dir):
    registry = spark.createDataFrame([(s,) for s in methods.REGISTERED_STEPS], "step_id string")
    catalog = spark.createDataFrame([(c,) for c in views.sales(spark, sf_dir).columns], "column_name string")
    return validate.plan_gate(views.event_plan_steps(spark, sf_dir), registry, catalog)


@query
def plan_gate(spark, sf_dir):
    return _gated(spark, sf_dir)


@query
def plan_steps_to_run(spark, sf_dir):
    """Steps of each plan with what they need: one goes when a step below it is absent or rejected."""
    edges = [(step, other) for step, others in PLAN_DEPENDENCIES.items() for other in (others or [None])]
    dependencies = spark.createDataFrame(edges, "step_id string, depends_on string")
    return lineage.with_dependencies(_gated(spark, sf_dir), dependencies)


@query
def plan_defaults(spark, sf_dir):
    """The steps that will run for each plan: its valid ones, or the default plan."""
    return validate.steps_to_run(_gated(spark, sf_dir), methods.REGISTERED_STEPS)


@query
def citation_gate(spark, sf_dir):
    cited = views.event_components(spark, sf_dir).select("run_id", "component_id", "result_id")
    return joins.with_citation(cited, views.event_results(spark, sf_dir), on=["run_id", "result_id"])


@query
def rerun_identity(spark, sf_dir):
    """The same breakdown from rows in another order and partitioning."""
    rows = _with_customers(spark, sf_dir)
    first, second = _change(rows, "segment"), _change(rows.repartition(13, "order_id"), "segment")
    figures = ["baseline_value", "current_value", "absolute_change"]
    compared = validate.same_figures(first, second, keys=["dimension", "dimension_value"], values=figures)

    def digest(run: str) -> Column:
        cents = [F.round(F.col(f"{run}.{c}") * 100).cast("long").cast("string") for c in figures]
        return F.md5(F.concat_ws("|", "dimension", "dimension_value", *cents))

    return compared.select(
        "dimension", "dimension_value", *[F.col(f"second.{c}").alias(c) for c in figures], digest("first").alias("first_digest"),
        digest("second").alias("second_digest"), "is_same",
    )


TEXT_TABLES = ("documents", "labels", "pages", "conversations", "benchmark")


@query
def text_table_digest(spark, sf_dir):
    digests = [validate.text_digest(views.table(spark, sf_dir, t), t) for t in TEXT_TABLES]
    return reduce(DataFrame.unionByName, digests)


@query
def table_digest(spark, sf_dir):
    return validate.digest_tables({t: views.table(spark, sf_dir, t) for t in TABLES})


# ---------------------------------------------------------------------------
# Reports
# ---------------------------------------------------------------------------
def _drivers(spark, sf_dir):
    return report.top_driver(_change_with_customers(spark, sf_dir, ["channel", "segment"]))


@query
def top_driver(spark, sf_dir):
    return _drivers(spark, sf_dir)


DRIVER_RESULTS = {"channel": f"RES_{methods.BREAKDOWN_CHANNEL}", "segment": f"RES_{methods.BREAKDOWN_SEGMENT}"}


@query
def metric_cards(spark, sf_dir):
    return report.metric_cards(_comparison(spark, sf_dir), _drivers(spark, sf_dir), driver_results=DRIVER_RESULTS)


@query
def findings(spark, sf_dir):
    return report.findings(_comparison(spark, sf_dir), _drivers(spark, sf_dir), driver_results=DRIVER_RESULTS)


@query
def chart_datasets(spark, sf_dir):
    sales = views.prepared_sales(spark, sf_dir)
    breakdowns = _change_with_customers(spark, sf_dir, ["channel", "segment"])
    return report.chart_datasets(metrics.monthly_trend(sales), breakdowns, metrics.customer_dynamics(sales))


@query
def chart_specs(spark, sf_dir):
    return report.chart_specs(chart_datasets(spark, sf_dir))


@query
def chart_records(spark, sf_dir):
    """Records of the charts with the status of their results; the segment breakdown lost a member on the way."""
    breakdowns = _change_with_customers(spark, sf_dir, ["channel", "segment"])
    results = breakdowns.withColumn("result_id", report._driver_result(DRIVER_RESULTS))
    lossy = results.where((F.col("dimension") != "segment") | (F.col("dimension_value") != "BUILDING"))
    checks = validate.reconciliation_checks(validate.reconcile(lossy, _comparison(spark, sf_dir)))
    records = results.select("result_id").distinct().withColumn("warnings", F.array().cast("array<string>"))
    charts = report.chart_records(
        chart_datasets(spark, sf_dir), baseline=BASELINE, current=CURRENT, driver_results=DRIVER_RESULTS, primary="channel"
    )
    return report.with_status(charts, validate.result_statuses(records, checks))


def _provenance(spark, sf_dir, breakdowns: DataFrame, comparison: DataFrame, cards: DataFrame) -> DataFrame:
    orders, customers = views.dirty_orders(spark, sf_dir), views.dirty_customers(spark, sf_dir)
    statuses = validate.result_statuses(
        breakdowns.groupBy("result_id").agg(F.array().cast("array<string>").alias("warnings")),
        validate.reconciliation_checks(validate.reconcile(breakdowns, comparison)),
    )
    diagnostics = joins.join_diagnostics(
        orders, customers, "customer_id", metric="net_sales", deduplicated=True, left_table="orders", right_table="customers"
    )
    return report.provenance(
        fact="orders",
        joined=["customers"],
        sources=manifest.table_manifest({"orders": orders, "customers": customers}).withColumnRenamed("table_name", "table_id"),
        ledger=ledger.exclusion_ledger(_flagged(spark, sf_dir), cutoff=DIRTY_CUTOFF, samples=0),
        joins=joins.join_check(diagnostics),
        results=statuses,
        cards=cards,
    )


@query
def provenance_ledger(spark, sf_dir):
    # A few rows each, used several times: the sales are joined once.
    breakdowns, comparison = durable(_breakdown_results(spark, sf_dir)), durable(_comparison(spark, sf_dir))
    return _provenance(spark, sf_dir, breakdowns, comparison, report.metric_cards(comparison))


def _lineage_nodes(spark, sf_dir) -> DataFrame:
    """Provenance in which the card of the top channel cites a result that lost a member."""
    breakdowns, comparison = durable(_breakdown_results(spark, sf_dir)), durable(_comparison(spark, sf_dir))
    drivers = report.top_driver(breakdowns.where("result_id != 'RES_CHANNEL_PARTIAL'"))
    cited = {"channel": "RES_CHANNEL_PARTIAL", "segment": "RES_SEGMENT", "region": "RES_REGION"}
    return durable(_provenance(spark, sf_dir, breakdowns, comparison, report.metric_cards(comparison, drivers, driver_results=cited)))


@query
def lineage_sources(spark, sf_dir):
    """The raw tables behind every step, join, result and card."""
    found = lineage.raw_sources(_lineage_nodes(spark, sf_dir))
    return found.withColumn("raw_tables", F.array_join("raw_tables", ","))


@query
def lineage_impact(spark, sf_dir):
    """What a rejected result, or a table whose rows are not those of the stored one, makes invalid."""
    def sized(tables):
        found = manifest.table_manifest(tables)
        return found.select(F.col("table_name").alias("path"), F.sha2(F.col("row_count").cast("string"), 256).alias("sha256"))

    stored = sized({"orders": views.table(spark, sf_dir, "orders"), "customers": views.table(spark, sf_dir, "customer")})
    now = sized({"orders": views.dirty_orders(spark, sf_dir), "customers": views.dirty_customers(spark, sf_dir)})
    changed = manifest.file_changes(now, stored).where("state != 'unchanged'").select(F.col("path").alias("table_id"))
    return lineage.impact(_lineage_nodes(spark, sf_dir), changed)


# ---------------------------------------------------------------------------
# Questions and texts
# ---------------------------------------------------------------------------
@query
def question_router(spark, sf_dir):
    routed = questions.route_questions(views.questions(spark, sf_dir), "question")
    return routed.select("question_id", "query_type", "matched_term", "requires_full_run")


@query
def filter_extract(spark, sf_dir):
    found = questions.extract_filters(views.questions(spark, sf_dir), "question")
    return found.drop("question")


@query
def filter_answers(spark, sf_dir):
    return _answers(spark, sf_dir).select("question_id", "filter_or_condition", "total_value", "row_count")


def _answers(spark, sf_dir):
    asked = questions.route_questions(views.questions(spark, sf_dir), "question").where(
        F.col("query_type") == questions.RECALCULATE
    )
    requests = questions.extract_filters(asked, "question")
    return questions.answer_text(questions.answer_filters(requests, views.labelled_sales(spark, sf_dir), weight="lines"))


@query
def answer_citations(spark, sf_dir):
    return questions.citations(_answers(spark, sf_dir))


@query
def question_notices(spark, sf_dir):
    """What is said to questions that no figure answers."""
    routed = questions.answer_notices(questions.route_questions(views.questions(spark, sf_dir), "question"))
    return routed.where(F.col("notice").isNotNull()).select(
        "question_id", "query_type", "matched_term", "notice", "data_limitation", "requires_full_run"
    )


def _findings_and_statuses(spark, sf_dir):
    """Findings of which the one by channel cites a result that lost a member, and the status of each result."""
    breakdowns, comparison = durable(_breakdown_results(spark, sf_dir)), durable(_comparison(spark, sf_dir))
    drivers = report.top_driver(breakdowns.where("result_id != 'RES_CHANNEL_PARTIAL'"))
    cited = {"channel": "RES_CHANNEL_PARTIAL", "segment": "RES_SEGMENT", "region": "RES_REGION"}
    none = F.array().cast("array<string>").alias("warnings")
    records = breakdowns.select("result_id").distinct().unionByName(comparison.select(F.lit(f"RES_{methods.COMPARISON}").alias("result_id")))
    statuses = validate.result_statuses(
        records.select("result_id", none), validate.reconciliation_checks(validate.reconcile(breakdowns, comparison))
    )
    return durable(report.findings(comparison, drivers, driver_results=cited)), durable(statuses)


@query
def explained_questions(spark, sf_dir):
    """Answers to questions about existing results, from validated ones only."""
    routed = questions.route_questions(views.questions(spark, sf_dir), "question")
    answers = questions.explain_results(routed, *_findings_and_statuses(spark, sf_dir))
    return answers.select("question_id", "answer_text", F.array_join("cited_results", ",").alias("cited_results"))


@query
def explanation_citations(spark, sf_dir):
    routed = questions.route_questions(views.questions(spark, sf_dir), "question")
    found = _findings_and_statuses(spark, sf_dir)
    return questions.explanation_citations(questions.explain_results(routed, *found), *found)


@query
def redact_text(spark, sf_dir):
    cleaned = text.redact_text(views.table(spark, sf_dir, "documents"), ["text"], SECRETS)
    return cleaned.select("doc_id", "redaction_hits", "text")


@query
def truncate_text(spark, sf_dir):
    return text.truncate_text(views.table(spark, sf_dir, "documents"), "text").select("doc_id", "was_truncated", "text")


# ---------------------------------------------------------------------------
# Logs and stores
# ---------------------------------------------------------------------------
@query
def transition_violations(spark, sf_dir):
    return runlog.transition_violations(views.run_log(spark, sf_dir), allowed=EVENT_TRANSITIONS, bucket=5000)


def _status(spark, sf_dir):
    reason = F.when((F.col("stage") == "error") & (F.col("value") > 5), F.col("props"))
    return runlog.run_status(
        views.run_log(spark, sf_dir).withColumn("failure_reason", reason),
        terminal=("purchase", "error"), failed="error", repair="click",
    )


@query
def run_status(spark, sf_dir):
    return _status(spark, sf_dir).withColumns(
        {"started_at": _moment("started_at"), "completed_at": _moment("completed_at")}
    )


@query
def misleading_failures(spark, sf_dir):
    return runlog.misleading_failures(_status(spark, sf_dir), failed="error").select("run_id", "status", "events")


@query
def latest_artifact(spark, sf_dir):
    latest = store.latest_artifacts(views.event_artifacts(spark, sf_dir))
    return latest.withColumn("created_at", _moment("created_at"))


@query
def newest_records(spark, sf_dir):
    """The fifty newest events, as a log viewer lists them."""
    return store.newest(views.run_log(spark, sf_dir), tie="event_id", limit=50).select("event_id", "run_id", "stage")


@query
def call_log_rollup(spark, sf_dir):
    return runlog.call_log_rollup(views.event_calls(spark, sf_dir), percentiles=())


@query
def call_log_percentiles(spark, sf_dir):
    return runlog.call_log_rollup(views.event_calls(spark, sf_dir)).select("caller_agent", "status", "p50_duration", "p95_duration")


@query
def artifact_json(spark, sf_dir):
    """Orders as JSON documents of an artifact store."""
    orders = views.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    saved = store.as_artifacts(
        orders, run_id="RUN", artifact_type="Order", artifact_id=F.col("o_orderkey").cast("string"), created_at=F.lit("2001-01-01").cast("timestamp")
    )
    return saved.select("artifact_id", "run_id", "artifact_type", "data_json")


@query
def page_fingerprints(spark, sf_dir):
    return manifest.fingerprints(views.page_files(spark, sf_dir)).drop("no_hash_reason")


@query
def page_admission(spark, sf_dir):
    """Pages as uploads: which names and sizes are turned away, and why."""
    admitted = manifest.admission(views.page_files(spark, sf_dir), extensions=(".html", ""), max_bytes=5000)
    return admitted.select("path", "file_name", "length", "reject_reason")


@query
def page_table_names(spark, sf_dir):
    return views.page_files(spark, sf_dir).select("path", table_name_of(F.col("file_name")).alias("table_name"))


@query
def page_changes(spark, sf_dir):
    then, now = views.page_versions(spark, sf_dir)
    return manifest.file_changes(now, then).select("path", "state")


@query
def empty_tables(spark, sf_dir):
    """Order lines of parts that do not exist, as a table: has it any rows?"""
    lines, parts = views.table(spark, sf_dir, "lineitem"), views.table(spark, sf_dir, "part")
    stray = lines.join(parts, F.col("l_partkey") == F.col("p_partkey"), "left_anti")
    found = quality.empty_table(stray, "stray_lines").unionByName(quality.empty_table(lines, "lineitem"))
    return found.select(*ISSUE_COLUMNS)


@query
def exclusion_samples(spark, sf_dir):
    kept = ledger.exclusion_samples(
        _flagged(spark, sf_dir), key_col="order_id", detail_cols={1: "order_date", 2: "status", 3: ledger.CLEAN_DATE}, samples=3
    )
    detail = F.coalesce(*[F.col("sample").getItem(c) for c in ("order_date", "status", ledger.CLEAN_DATE)])
    return kept.select(F.col(ledger.STEP).alias("step"), F.posexplode("exclusion_samples").alias("place", "sample")).select(
        "step", "place", F.col("sample").getItem("order_id").alias("order_id"), detail.alias("detail")
    )


@query
def table_manifest(spark, sf_dir):
    return manifest.table_manifest({t: views.table(spark, sf_dir, t) for t in TABLES})


TABLE_IN_PATH = r"/([^/]+)\.parquet(/|$)"


def _fingerprints(spark, sf_dir):
    return manifest.file_fingerprints(spark, sf_dir, recursive=True)


@query
def file_fingerprints(spark, sf_dir):
    return _fingerprints(spark, sf_dir).select("file_name", "length", "sha256", "no_hash_reason")


@query
def file_manifest(spark, sf_dir):
    """Every file with its own rows; files that belong to no table have a reason instead."""
    tables = {t: views.table(spark, sf_dir, t) for t in TABLES}
    counts = reduce(DataFrame.unionByName, [
        manifest.rows_per_file(df).withColumn("column_count", F.lit(len(df.columns)).cast("long")) for df in tables.values()
    ])
    name = F.regexp_extract("path", TABLE_IN_PATH, 1)
    described = _fingerprints(spark, sf_dir).join(counts, "path", "left").withColumn("table_name", F.when(name != "", name))
    admitted = manifest.admission(described, extensions=(".parquet",), max_bytes=None)
    return admitted.select(
        "table_name", "file_name", "length", "sha256", "row_count", "column_count", F.coalesce("reject_reason", "no_hash_reason").alias("reject_reason")
    )
