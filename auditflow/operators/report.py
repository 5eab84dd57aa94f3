"""Reporting tables: cards, chart data, findings, provenance and summaries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from auditflow.functions.text import money_text, percent_text
from auditflow.operators.joins import lookup
from auditflow.records import FINDING, METRIC_CARD, conform


def _direction(change: Column) -> Column:
    return F.when(change < 0, "down").when(change > 0, "up").otherwise("flat")


def _both_periods() -> Column:
    return F.concat(F.col("baseline_period"), F.lit(" vs "), F.col("current_period"))


def top_driver(breakdown: DataFrame) -> DataFrame:
    """The member with the largest change per dimension, whatever its sign; ties by name."""
    fields = ["dimension_value", "baseline_value", "current_value", "absolute_change", "percentage_change",
              "contribution_to_total_change", "baseline_period", "current_period", "total_change"]
    order = F.struct(-F.abs(F.col("absolute_change")), F.col("dimension_value"))
    return (
        breakdown.groupBy("dimension")
        .agg(F.min_by(F.struct(*fields), order).alias("top"))
        .select("dimension", "top.*")
    )


def _driver_result(driver_results: Mapping[str, str] | None) -> Column:
    """The result that a dimension's driver comes from."""
    return reduce(
        lambda rest, item: F.when(F.col("dimension") == item[0], F.lit(item[1])).otherwise(rest),
        (driver_results or {}).items(),
        F.concat(F.lit("RES_BREAKDOWN_"), F.upper("dimension")),
    )


def metric_cards(
    comparison: DataFrame,
    drivers: DataFrame | None = None,
    *,
    comparison_result: str = "RES_OP_03_PERIOD_COMPARISON",
    driver_results: Mapping[str, str] | None = None,
) -> DataFrame:
    """Cards for both periods, their change, and the top driver of each dimension."""
    change, pct = F.col("absolute_change"), F.col("percentage_change")

    def card(card_id: str, title: Column, value: Column, text: Column, direction: Column, period: Column) -> Column:
        return F.struct(
            F.lit(card_id).alias("id"), title.alias("title"), value.alias("value"), text.alias("comparison_text"),
            direction.alias("trend_direction"), F.lit(comparison_result).alias("result_id"), period.alias("period"),
        )

    word = F.when(change < 0, "decrease").otherwise("increase")
    cards = comparison.select(
        F.inline(
            F.array(
                card(
                    "CARD_BASELINE", F.concat(F.lit("Baseline ("), "baseline_period", F.lit(")")),
                    money_text(F.col("baseline_value")), F.lit("Reference level"), F.lit("flat"), F.col("baseline_period"),
                ),
                card(
                    "CARD_CURRENT", F.concat(F.lit("Current ("), "current_period", F.lit(")")),
                    money_text(F.col("current_value")),
                    F.concat(percent_text(pct), F.lit(" vs "), "baseline_period"), _direction(change), F.col("current_period"),
                ),
                card(
                    "CARD_TOTAL_CHANGE", F.lit("Total Net Change"), money_text(change),
                    F.concat(percent_text(F.abs(pct)), F.lit(" "), word), _direction(change), _both_periods(),
                ),
            )
        )
    )
    if drivers is not None:
        result_id = _driver_result(driver_results)
        cards = cards.unionByName(
            drivers.select(
                F.concat(F.lit("CARD_TOP_"), F.upper("dimension")).alias("id"),
                F.concat(F.lit("Top "), "dimension", F.lit(": "), "dimension_value").alias("title"),
                percent_text(F.col("contribution_to_total_change")).alias("value"),
                F.concat(F.lit("Accounts for "), money_text(change), F.lit(" of the change")).alias("comparison_text"),
                _direction(change).alias("trend_direction"),
                result_id.alias("result_id"),
                _both_periods().alias("period"),
            )
        )
    return conform(cards, METRIC_CARD)


def chart_records(
    points: DataFrame,
    *,
    baseline: str,
    current: str,
    trend_result: str = "RES_OP_02_TIME_AGGREGATION",
    dynamics_result: str = "RES_OP_06_CUSTOMER_DYNAMICS",
    driver_results: Mapping[str, str] | None = None,
    primary: str | None = None,
    metric: str = "net_sales",
) -> DataFrame:
    """A record per chart: type, result, metric, period, size, and whether it is the primary one.

    ``primary`` names the dimension whose bar chart answers the objective.
    """
    dimension = F.lower(F.regexp_replace("chart_id", "^CHART_", ""))
    counted = points.groupBy("chart_id").agg(F.count(F.lit(1)).alias("points")).withColumn("dimension", dimension)
    series, dynamic = F.col("chart_id") == "CHART_TIME_SERIES", F.col("chart_id") == "CHART_CUSTOMER_DYNAMICS"
    return counted.select(
        "chart_id",
        F.when(series, "line").when(dynamic, "stacked_bar").otherwise("waterfall").alias("chart_type"),
        F.when(series, trend_result).when(dynamic, dynamics_result).otherwise(_driver_result(driver_results)).alias("result_id"),
        F.lit(metric).alias("metric"),
        F.when(series | dynamic, "closed history").otherwise(f"{baseline} vs {current}").alias("period"),
        F.coalesce(~series & ~dynamic & (F.col("dimension") == F.lit(primary)), F.lit(False)).alias("is_primary_objective"),
        "points",
    )


def with_status(records: DataFrame, statuses: DataFrame) -> DataFrame:
    """Cards or charts with the validation status of their result; null if there is no such result."""
    known = statuses.select("result_id", "validation_status")
    return records.drop("validation_status").join(known, "result_id", "left")


def dashboard_components(cards: DataFrame, charts: DataFrame) -> DataFrame:
    """Cards and charts as the rows that ``validate.presentation_checks`` and ``period_alignment`` read."""
    as_cards = cards.select(
        F.col("id").alias("component_id"), F.lit("card").alias("kind"), "result_id", "title", "period",
        F.lit(False).alias("is_primary"), F.lit(None).cast("long").alias("points"),
    )
    as_charts = charts.select(
        F.col("chart_id").alias("component_id"), F.lit("chart").alias("kind"), "result_id", F.col("chart_id").alias("title"), "period",
        F.col("is_primary_objective").alias("is_primary"), "points",
    )
    return as_cards.unionByName(as_charts)


def chart_points(chart_id: str, df: DataFrame, label: str, measures: list[str]) -> DataFrame:
    """A result as chart data in long form: chart, label, measure, value."""
    values = F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("value")) for m in measures])
    return df.select(F.lit(chart_id).alias("chart_id"), F.col(label).alias("label"), F.inline(values))


def chart_datasets(trend: DataFrame, breakdowns: DataFrame | None, dynamics: DataFrame) -> DataFrame:
    """Data of all charts: monthly series, one bar chart per dimension, new versus recurring."""
    series = chart_points("CHART_TIME_SERIES", trend, "period", ["net_sales", "order_count"])
    dynamic = chart_points(
        "CHART_CUSTOMER_DYNAMICS", dynamics, "period", ["new_customers_sales", "recurring_customers_sales"]
    )
    charts = series.unionByName(dynamic)
    if breakdowns is None:
        return charts
    bars = breakdowns.select(
        F.concat(F.lit("CHART_"), F.upper("dimension")).alias("chart_id"),
        F.col("dimension_value").alias("label"),
        F.lit("absolute_change").alias("measure"),
        F.col("absolute_change").alias("value"),
    )
    return charts.unionByName(bars)


def chart_specs(points: DataFrame) -> DataFrame:
    """One row per chart: how many points it has and the range of each measure.

    The points themselves stay rows; a chart over a large dimension has many.
    """
    return points.groupBy("chart_id", "measure").agg(
        F.count(F.lit(1)).alias("points"), F.min("value").alias("min_value"), F.max("value").alias("max_value")
    )


def findings(
    comparison: DataFrame,
    drivers: DataFrame,
    *,
    comparison_result: str = "RES_OP_03_PERIOD_COMPARISON",
    driver_results: Mapping[str, str] | None = None,
) -> DataFrame:
    """Sentences on the total change and on what drives it, each bound to its result."""
    change = F.col("absolute_change")
    verb = F.when(change < 0, "decreased").otherwise("increased")
    total = comparison.select(
        F.lit("FINDING_TOTAL_CHANGE").alias("id"),
        F.concat(
            "metric", F.lit(" "), verb, F.lit(" by "), F.format_number(F.abs(change), 2), F.lit(" ("),
            percent_text(F.col("percentage_change")), F.lit(") between "), "baseline_period", F.lit(" ("),
            F.format_number("baseline_value", 2), F.lit(") and "), "current_period", F.lit(" ("),
            F.format_number("current_value", 2), F.lit(")."),
        ).alias("claim"),
        F.lit(comparison_result).alias("result_id"),
        F.concat("metric", F.lit("_delta")).alias("metric_name"),
        change.alias("observed_value"),
    )
    driver = drivers.select(
        F.concat(F.lit("FINDING_TOP_"), F.upper("dimension")).alias("id"),
        F.concat(
            F.lit("The largest change by "), "dimension", F.lit(" is '"), "dimension_value", F.lit("' with "),
            F.format_number(change, 2), F.lit(" ("), percent_text(F.col("contribution_to_total_change")),
            F.lit(" of the total change)."),
        ).alias("claim"),
        _driver_result(driver_results).alias("result_id"),
        F.concat("dimension", F.lit("_contribution")).alias("metric_name"),
        change.alias("observed_value"),
    )
    return conform(total.unionByName(driver), FINDING)


def provenance(
    *,
    fact: str,
    sources: DataFrame,
    ledger: DataFrame,
    joins: DataFrame | None,
    results: DataFrame,
    cards: DataFrame,
    joined: Sequence[str] = (),
) -> DataFrame:
    """The way from raw tables to cards as rows: node, kind, parent and a figure.

    The first step hangs under the ``fact`` table, each further step under the one
    before it, joins under the last step and under each other in the order of
    ``joined`` (right tables), results under the last join, cards under their
    result. ``sources``: table_id, row_count. ``ledger``: transformation records.
    ``joins``: join checks. ``results``: result_id, validation_status.
    """
    def node(df: DataFrame, node_id: Column, kind: str, parent: Column, detail: Column) -> DataFrame:
        return df.select(
            node_id.cast("string").alias("node_id"), F.lit(kind).alias("kind"),
            parent.cast("string").alias("parent_id"), detail.cast("string").alias("detail"),
        )

    def join_id(table: Column | str) -> Column:
        return F.concat(F.lit("TRF_JOIN_"), F.upper(F.lit(table) if isinstance(table, str) else table))

    # A ledger has a row for each rule, so its window is short.
    step_before = F.lag("transformation_id").over(Window.partitionBy(F.lit(0)).orderBy("step_index"))
    last_step = F.coalesce(ledger.agg(F.max_by("transformation_id", "step_index")).scalar(), F.lit(fact))
    join_before = last_step
    for left, right in zip(joined, joined[1:]):
        join_before = F.when(F.col("right_table") == right, join_id(left)).otherwise(join_before)
    nodes = [
        node(sources, F.col("table_id"), "raw_table", F.lit(None), F.col("row_count")),
        node(
            ledger.withColumn("_before", step_before), F.col("transformation_id"), "transformation",
            F.coalesce("_before", F.lit(fact)), F.col("rows_excluded"),
        ),
        node(results, F.col("result_id"), "result", join_id(joined[-1]) if joined else last_step, F.col("validation_status")),
        node(cards, F.col("id"), "card", F.col("result_id"), F.col("value")),
    ]
    if joins is not None:
        nodes.append(node(joins, join_id(F.col("right_table")), "join", join_before, F.col("multiplication_factor")))
    return reduce(DataFrame.unionByName, nodes)


def catalog_summary(profile: DataFrame) -> DataFrame:
    """Per table: size, and the type, gaps and distinct values of each column as JSON. No cell values."""
    column = F.struct(
        "name",
        F.col("inferred_type").alias("type"),
        F.col("null_percentage").alias("null_pct"),
        "unique_count",
        "has_leading_zeros",
    )
    return profile.groupBy("table_id").agg(
        F.max("total_count").alias("row_count"),
        F.count("name").alias("column_count"),
        F.to_json(F.sort_array(F.collect_list(column))).alias("columns_json"),
    )


def results_summary(results: DataFrame, values: DataFrame) -> DataFrame:
    """Figures of approved results; those of rejected and pending ones are left out.

    One row per figure, so that a result with very many is not gathered in one
    place. The join may split the figures of such a result over tasks.
    """
    approved = results.where(F.col("validation_status").isin("approved", "approved_with_warnings"))
    figure = F.to_json(F.struct("item", "field", "value"))
    return lookup(values, approved, ["result_id"], "inner").withColumn("figure_json", figure)
