"""Routing of questions over a text column, and answers to many filters at once."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from auditflow.functions.parsing import as_amount, round_amount
from auditflow.operators.metrics import counted_rows
from auditflow.records import CITATION, MONEY

# Trigger words and phrases, matched as substrings of the lower-cased
# question. The first in list order is the one reported.
UNANSWERABLE_TRIGGERS = (
    "competitor", "competition", "inflation", "competitor price", "weather",
    "rating", "television", "external stockout", "customer satisfaction", "nps",
    "competidor", "competencia", "inflación", "precio de la competencia", "clima",
)
NEW_ANALYSIS_TRIGGERS = (
    "new analysis", "predictive model", "cluster", "clustering", "decision tree",
    "predict the future", "price optimization", "price elasticity",
    "nuevo análisis", "modelo predictivo", "predecir",
)
RECALCULATE_TRIGGERS = (
    "how much did", "how much was sold", "calculate", "recalculate", "filter by",
    "filtered by", "only in", "region", "channel", "cuánto vendió", "cuanto vendio",
    "calcular", "recalcular", "si filtramos", "filtrar por", "sólo en", "solo en", "región",
)
QUANTITY_PHRASES = ("how much", "cuánto", "cuanto", "sales in", "ventas en")

# Query types.
UNANSWERABLE = "unanswerable_by_data"
NEW_ANALYSIS = "request_new_analysis"
RECALCULATE = "recalculate_with_filters"
EXPLAIN = "explain_existing_result"

# Filter keywords and the member each one stands for, in match order.
REGION_KEYWORDS = {
    "metropolitana": "Metropolitan",
    "metropolitan": "Metropolitan",
    "norte": "North",
    "north": "North",
    "centro": "Central",
    "central": "Central",
    "sur": "South",
    "south": "South",
}
CHANNEL_KEYWORDS = {
    "mayorista": "Wholesale / B2B",
    "wholesale": "Wholesale / B2B",
    "retail": "Retail / Stores",
    "tiendas": "Retail / Stores",
    "stores": "Retail / Stores",
    "online": "Online / Direct",
    "directo": "Online / Direct",
    "direct": "Online / Direct",
}

NO_FILTER = ""


def _not_shadowed(needles: Sequence[str], *, by_later: bool) -> list[str]:
    """Needles that can decide a search: those in which no other needle is contained.

    With ``by_later`` false, only needles before it may stand in for one, so the
    first match in list order is kept as it is.
    """
    kept = []
    for i, needle in enumerate(needles):
        others = needles if by_later else needles[:i]
        if not any(other in needle and other != needle for other in others):
            kept.append(needle)
    return kept


def _words(needles: Sequence[str]) -> Column:
    return F.array(*[F.lit(n) for n in needles])


def first_contained(text: Column, needles: Sequence[str]) -> Column:
    """The first needle, in list order, that ``text`` contains; null if none.

    A search over an array of words: one test per word written out would make
    generated code too large to compile.
    """
    words = _words(_not_shadowed(needles, by_later=False))
    return F.get(F.filter(words, lambda word: F.contains(text, word)), 0)


def contains_any(text: Column, needles: Sequence[str]) -> Column:
    words = _words(_not_shadowed(needles, by_later=True))
    return F.coalesce(F.exists(words, lambda word: F.contains(text, word)), F.lit(False))


def route_questions(
    questions: DataFrame,
    text_col: str,
    *,
    has_filters: Column | None = None,
    unanswerable: Sequence[str] = UNANSWERABLE_TRIGGERS,
    new_analysis: Sequence[str] = NEW_ANALYSIS_TRIGGERS,
    recalculate: Sequence[str] = RECALCULATE_TRIGGERS,
    quantities: Sequence[str] = QUANTITY_PHRASES,
) -> DataFrame:
    """Add the query type of each question and the trigger that decided it.

    In order: data cannot answer it; it needs a new analysis; it asks for a figure
    under filters (filters given, or both a trigger and a quantity phrase); else
    it is about existing results. Texts are searched whole, lower-cased once, and
    each list of triggers is searched once.
    """
    text = F.col("_text")
    given = F.coalesce(has_filters, F.lit(False)) if has_filters is not None else F.lit(False)
    searched = (
        questions.withColumn("_text", F.lower(F.col(text_col)))
        .withColumns(
            {
                "_missing": first_contained(text, unanswerable),
                "_new": first_contained(text, new_analysis),
                "_may_ask": given | contains_any(text, quantities),
            }
        )
        # The longest list is searched only where its result can matter.
        .withColumn("_recalculate", F.when(F.col("_may_ask"), first_contained(text, recalculate)))
    )
    wants_figure = given | F.col("_recalculate").isNotNull()
    query_type = (
        F.when(F.col("_missing").isNotNull(), UNANSWERABLE)
        .when(F.col("_new").isNotNull(), NEW_ANALYSIS)
        .when(wants_figure, RECALCULATE)
        .otherwise(EXPLAIN)
    )
    return (
        searched.withColumn("query_type", query_type)
        .withColumns(
            {
                "matched_term": F.coalesce("_missing", "_new", F.when(wants_figure, F.col("_recalculate"))),
                "requires_full_run": F.col("query_type") == NEW_ANALYSIS,
            }
        )
        .drop("_text", "_missing", "_new", "_may_ask", "_recalculate")
    )


def _keyword(text: Column, given: Column | None, keywords: Mapping[str, str]) -> Column:
    """The first keyword contained in the text or equal to the given filter."""
    if given is None:
        return F.get(F.filter(_words(list(keywords)), lambda word: F.contains(text, word)), 0)
    chosen = F.coalesce(F.lower(given), F.lit(""))
    return F.get(F.filter(_words(list(keywords)), lambda word: F.contains(text, word) | (chosen == word)), 0)


def _label(keyword: Column, keywords: Mapping[str, str]) -> Column:
    labels = F.create_map(*[F.lit(x) for pair in keywords.items() for x in pair])
    return labels[keyword]


def extract_filters(
    questions: DataFrame,
    text_col: str,
    *,
    region_filter: str | None = None,
    channel_filter: str | None = None,
    regions: Mapping[str, str] = REGION_KEYWORDS,
    channels: Mapping[str, str] = CHANNEL_KEYWORDS,
) -> DataFrame:
    """Add region and channel keywords found in the text or the filter columns, with their labels."""
    text = F.col("_text")
    region = _keyword(text, F.col(region_filter) if region_filter else None, regions)
    channel = _keyword(text, F.col(channel_filter) if channel_filter else None, channels)
    lowered = questions.withColumn("_text", F.lower(F.col(text_col)))
    with_keywords = lowered.withColumns({"region_keyword": region, "channel_keyword": channel}).drop("_text")
    return with_keywords.withColumns(
        {
            "region_label": _label(F.col("region_keyword"), regions),
            "channel_label": _label(F.col("channel_keyword"), channels),
        }
    )


def slice_condition(
    *,
    region_keyword: str | None = None,
    channel_keyword: str | None = None,
    regions: Mapping[str, str] = REGION_KEYWORDS,
) -> Column:
    """Row filter of one request: region equals the keyword or its label, channel contains the keyword."""
    condition = F.lit(True)
    if region_keyword:
        names = {region_keyword, regions.get(region_keyword, region_keyword).lower()}
        condition = condition & F.lower("region").isin(*sorted(names))
    if channel_keyword:
        condition = condition & F.lower("channel").contains(channel_keyword)
    return condition


def _slices(column: str, keywords: Sequence[str], matches) -> Column:
    """The keywords that select a member, and the empty one that selects everything."""
    hits = [F.when(matches(F.lower(F.col(column)), k), F.lit(k)) for k in keywords]
    return F.array_compact(F.array(F.lit(NO_FILTER), *hits))


def filter_cube(
    fact: DataFrame,
    *,
    metric: str = "net_sales",
    weight: str | None = None,
    regions: Mapping[str, str] = REGION_KEYWORDS,
    channels: Mapping[str, str] = CHANNEL_KEYWORDS,
) -> DataFrame:
    """Total and rows for every pair of a region and a channel keyword, or none (``''``).

    The fact is reduced to its region and channel members before they are spread
    over the keywords; the result has at most one row per pair of keywords. If the
    fact was summed before, ``weight`` names its column of row counts.
    """
    missing = [c for c in ("region", "channel") if c not in fact.columns]
    if missing:
        raise ValueError(f"cannot filter by {missing}: not in the prepared table")
    cells = fact.groupBy("region", "channel").agg(
        F.sum(as_amount(fact, metric)).alias("amount"), counted_rows(weight).alias("n")
    )

    def is_region(member: Column, keyword: str) -> Column:
        return member.isin(*sorted({keyword, regions[keyword].lower()}))

    spread = cells.withColumn("region_keyword", F.explode(_slices("region", list(regions), is_region))).withColumn(
        "channel_keyword", F.explode(_slices("channel", list(channels), lambda member, k: member.contains(k)))
    )
    return spread.groupBy("region_keyword", "channel_keyword").agg(
        F.sum("amount").alias("amount"), F.sum("n").alias("row_count")
    )


def answer_filters(
    requests: DataFrame,
    fact: DataFrame,
    *,
    metric: str = "net_sales",
    weight: str | None = None,
    regions: Mapping[str, str] = REGION_KEYWORDS,
    channels: Mapping[str, str] = CHANNEL_KEYWORDS,
) -> DataFrame:
    """Answer every request (``region_keyword``, ``channel_keyword``, null for none) from one pass of the fact."""
    # One row per pair of keywords at most, whatever the size of the fact.
    cube = filter_cube(fact, metric=metric, weight=weight, regions=regions, channels=channels)
    keyed = requests.withColumns(
        {
            "_region": F.coalesce("region_keyword", F.lit(NO_FILTER)),
            "_channel": F.coalesce("channel_keyword", F.lit(NO_FILTER)),
        }
    )
    answers = cube.withColumnsRenamed({"region_keyword": "_region", "channel_keyword": "_channel"})
    return (
        keyed.join(F.broadcast(answers), ["_region", "_channel"], "left")
        .withColumns(
            {
                "total_value": round_amount(F.coalesce("amount", F.lit(0).cast(MONEY.simpleString()))),
                "row_count": F.coalesce("row_count", F.lit(0).cast("long")),
            }
        )
        .drop("_region", "_channel", "amount")
    )


# Where a figure under filters comes from.
FIGURE_SOURCE, FIGURE_TABLE, FIGURE_RESULT = "transformed_table", "analytical_fact", "RECALC_ON_DEMAND"
STEP_SOURCE = "analytic_step"


def answer_notices(routed: DataFrame) -> DataFrame:
    """Add to routed questions what can be said without a figure: answer, limitation and the need of a full run.

    Questions that ask for a figure under filters, and those about existing
    results, have no notice here; see ``answer_filters`` and ``explain_results``.
    """
    kind, term = F.col("query_type"), F.col("matched_term")
    answer = F.when(kind == UNANSWERABLE, F.concat(F.lit("The data of this project says nothing about '"), term, F.lit("'."))).when(
        kind == NEW_ANALYSIS, F.lit("This needs a new analysis: a plan, prepared variables and validation. Start a run for it.")
    )
    limitation = F.when(kind == UNANSWERABLE, F.concat(F.lit("No table holds '"), term, F.lit("'.")))
    return routed.withColumns({"notice": answer, "data_limitation": limitation, "requires_full_run": kind == NEW_ANALYSIS})


NOTHING_VALIDATED = "No validated result answers this yet. Start a run first."


def shown_findings(findings: DataFrame, statuses: DataFrame) -> DataFrame:
    """Findings that may be cited: they hold a figure, and their result is approved, if with warnings."""
    approved = statuses.where(F.col("validation_status").isin("approved", "approved_with_warnings"))
    held = findings.where(F.col("observed_value").isNotNull())
    return held.join(approved.select("result_id", "validation_status"), "result_id")


def explain_results(routed: DataFrame, findings: DataFrame, statuses: DataFrame) -> DataFrame:
    """Answer the routed questions about existing results: ``answer_text`` and ``cited_results``.

    The answer states what validated results hold, by result, and cites each of them once. A finding
    without a figure, or of a rejected or unknown result, is neither stated nor cited; if none is left
    the answer says so and cites nothing. Other kinds of questions are left out.
    """
    said = F.sort_array(F.collect_list(F.struct("result_id", "id", "claim")))
    told = shown_findings(findings, statuses).agg(said.alias("said")).select(
        F.lit(EXPLAIN).alias("query_type"),
        F.concat(F.lit("From validated results: "), F.array_join("said.claim", " ")).alias("_told"),
        F.array_distinct("said.result_id").alias("cited_results"),
    )
    # One row, whatever the number of questions: findings are one per dimension and one for the total.
    answered = routed.where(F.col("query_type") == EXPLAIN).join(F.broadcast(told), "query_type", "left")
    some = F.size("cited_results") > 0
    return answered.withColumn("answer_text", F.when(some, F.col("_told")).otherwise(NOTHING_VALIDATED)).drop("_told")


def explanation_citations(explained: DataFrame, findings: DataFrame, statuses: DataFrame, *, key: str = "question_id") -> DataFrame:
    """A citation record for each result that an answer of ``explain_results`` cites."""
    claims = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("id", "claim"))), lambda c: c["claim"]), " ")
    results = shown_findings(findings, statuses).groupBy("result_id", "validation_status").agg(claims.alias("details"))
    cited = explained.select(key, F.explode("cited_results").alias("result_id")).join(F.broadcast(results), "result_id")
    cited = cited.select(
        key,
        F.lit(STEP_SOURCE).alias("source_type"),
        F.regexp_replace("result_id", "^RES_", "").alias("source_name"),
        F.concat(F.lit("Validation: "), F.col("validation_status")).alias("filter_or_condition"),
        "result_id",
        "details",
    )
    return cited.select(key, *[F.col(f.name).cast(f.dataType) for f in CITATION.fields])


def citations(answers: DataFrame, *, key: str = "question_id") -> DataFrame:
    """A citation record for each answered figure (output of ``answer_text``)."""
    cited = answers.select(
        key,
        F.lit(FIGURE_SOURCE).alias("source_type"),
        F.lit(FIGURE_TABLE).alias("source_name"),
        "filter_or_condition",
        F.lit(FIGURE_RESULT).alias("result_id"),
        F.concat(F.lit("Computed on "), F.col("row_count").cast("string"), F.lit(" prepared rows.")).alias("details"),
    )
    return cited.select(key, *[F.col(f.name).cast(f.dataType) for f in CITATION.fields])


def answer_text(answers: DataFrame) -> DataFrame:
    """Answers as sentences, with the filters they were computed under."""
    filters = F.concat_ws(
        ", ",
        F.when(F.col("region_label").isNotNull(), F.concat(F.lit("Region = '"), F.col("region_label"), F.lit("'"))),
        F.when(F.col("channel_label").isNotNull(), F.concat(F.lit("Channel = '"), F.col("channel_label"), F.lit("'"))),
    )
    described = F.when(filters == "", "No specific filters").otherwise(filters)
    return answers.withColumn("filter_or_condition", described).withColumn(
        "answer_text",
        F.concat(
            F.lit("Net sales are $"), F.format_number("total_value", 2), F.lit(" over "),
            F.col("row_count").cast("string"), F.lit(" rows ("), F.col("filter_or_condition"), F.lit(")."),
        ),
    )
