from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from auditflow.operators import questions as q


@pytest.mark.parametrize(
    "question,expected,term",
    [
        ("Which competitor lowered prices and caused the drop?", q.UNANSWERABLE, "competitor"),
        ("What do competitor prices say about a new analysis?", q.UNANSWERABLE, "competitor"),
        ("Did the WEATHER matter?", q.UNANSWERABLE, "weather"),
        ("Effect of inflation?", q.UNANSWERABLE, "inflation"),
        ("¿Subió la INFLACIÓN?", q.UNANSWERABLE, "inflación"),
        ("Run a clustering", q.NEW_ANALYSIS, "cluster"),
        ("Quiero un nuevo análisis", q.NEW_ANALYSIS, "nuevo análisis"),
        ("How much did the North region sell?", q.RECALCULATE, "how much did"),
        ("¿Cuánto vendió el canal mayorista?", q.RECALCULATE, "cuánto vendió"),
        ("Recalculate the channel figures", q.EXPLAIN, None),
        ("How much is that?", q.EXPLAIN, None),
        ("Why did sales fall?", q.EXPLAIN, None),
        (None, q.EXPLAIN, None),
    ],
)
def test_routes(spark, question, expected, term):
    df = spark.createDataFrame([(question,)], "text string")
    row = q.route_questions(df, "text").first()
    assert (row.query_type, row.matched_term) == (expected, term)
    assert row.requires_full_run == (expected == q.NEW_ANALYSIS)


def test_given_filters_make_it_a_recalculation(spark):
    df = spark.createDataFrame([("and now?", "north"), ("and now?", None)], "text string, region string")
    found = q.route_questions(df, "text", has_filters=F.col("region").isNotNull()).collect()
    assert [r.query_type for r in found] == [q.RECALCULATE, q.EXPLAIN]


def test_leaving_out_shadowed_triggers_changes_nothing():
    texts = [f"a {t} b" for t in (*q.UNANSWERABLE_TRIGGERS, *q.NEW_ANALYSIS_TRIGGERS, *q.RECALCULATE_TRIGGERS)]
    for triggers in (q.UNANSWERABLE_TRIGGERS, q.NEW_ANALYSIS_TRIGGERS, q.RECALCULATE_TRIGGERS):
        ordered = q._not_shadowed(triggers, by_later=False)
        anywhere = q._not_shadowed(triggers, by_later=True)
        for text in texts:
            first = next((t for t in triggers if t in text), None)
            assert first == next((t for t in ordered if t in text), None)
            assert (first is not None) == any(t in text for t in anywhere)


def test_filters(spark):
    df = spark.createDataFrame(
        [("sales in the norte region, online", None), ("anything", "South"), ("retail stores", None), (None, None)],
        "text string, region string",
    )
    found = q.extract_filters(df, "text", region_filter="region").collect()
    assert [(r.region_keyword, r.region_label, r.channel_keyword, r.channel_label) for r in found] == [
        ("norte", "North", "online", "Online / Direct"),
        ("south", "South", None, None),
        (None, None, "retail", "Retail / Stores"),
        (None, None, None, None),
    ]


FACT = [(5000, "North", "Retail / Stores"), (3000, "North", "Online / Direct"), (10000, "South", "Wholesale / B2B"), (7, None, None)]


@pytest.fixture(scope="module")
def fact(spark):
    return spark.createDataFrame([(Decimal(n), r, c) for n, r, c in FACT], "net_sales decimal(18,4), region string, channel string")


def test_answers(spark, fact):
    asked = spark.createDataFrame(
        [(1, "How much did the North region sell?"), (2, "How much in total?"), (3, "How much did mayorista sell?"), (4, "norte via stores")],
        "id int, text string",
    )
    answers = q.answer_text(q.answer_filters(q.extract_filters(asked, "text"), fact)).orderBy("id").collect()
    assert [(r.total_value, r.row_count) for r in answers] == [(8000.0, 2), (18007.0, 4), (0.0, 0), (5000.0, 1)]
    assert answers[0].filter_or_condition == "Region = 'North'" and "8,000.00" in answers[0].answer_text
    assert answers[1].filter_or_condition == "No specific filters"


def test_cube_equals_single_slices(fact):
    cube = {(r.region_keyword, r.channel_keyword): (r.amount, r.row_count) for r in q.filter_cube(fact).collect()}
    for region in (None, *q.REGION_KEYWORDS):
        for channel in (None, *q.CHANNEL_KEYWORDS):
            condition = q.slice_condition(region_keyword=region, channel_keyword=channel)
            # a plain Python reading of the same rule
            hits = [
                n for n, r, c in FACT
                if (not region or (r or "").lower() in {region, q.REGION_KEYWORDS[region].lower()})
                and (not channel or channel in (c or "").lower())
            ]
            assert cube.get((region or "", channel or ""), (0, 0)) == (sum(hits), len(hits))
            if region in ("norte", None) and channel in ("direct", None):
                assert fact.where(condition).count() == len(hits)


def test_unknown_filter_column_is_an_error(spark, fact):
    with pytest.raises(ValueError):
        q.filter_cube(fact.drop("region"))


FINDINGS = "id string, claim string, result_id string, observed_value double"
STATUSES = "result_id string, validation_status string"


def test_explanations_state_and_cite_validated_results_only(spark):
    asked = spark.createDataFrame([("a", "Why did sales fall?"), ("b", "Run a clustering"), ("c", None)], "question_id string, text string")
    routed = q.route_questions(asked, "text")
    found = spark.createDataFrame(
        [("F2", "Two.", "RES_B", 2.0), ("F1", "One.", "RES_A", 1.0), ("F3", "Also two.", "RES_B", 3.0), ("F4", "Wrong.", "RES_C", 4.0),
         ("F5", "Empty.", "RES_D", None), ("F6", "Unknown.", "RES_E", 6.0)],
        FINDINGS,
    )
    statuses = spark.createDataFrame(
        [("RES_A", "approved"), ("RES_B", "approved_with_warnings"), ("RES_C", "rejected"), ("RES_D", "approved")], STATUSES
    )
    answers = q.explain_results(routed, found, statuses)
    assert {(r.question_id, r.answer_text, tuple(r.cited_results)) for r in answers.collect()} == {
        (k, "From validated results: One. Two. Also two.", ("RES_A", "RES_B")) for k in "ac"
    }
    cited = q.explanation_citations(answers, found, statuses).orderBy("question_id", "result_id").collect()
    assert [(r.question_id, r.source_name, r.filter_or_condition, r.details) for r in cited] == [
        (k, *rest) for k in "ac" for rest in [("A", "Validation: approved", "One."), ("B", "Validation: approved_with_warnings", "Two. Also two.")]
    ]


def test_explanations_without_a_result_cite_nothing(spark):
    asked = spark.createDataFrame([("a", "Why did sales fall?")], "question_id string, text string")
    routed = q.route_questions(asked, "text")
    found = spark.createDataFrame([("F5", "Empty.", "RES_D", None)], FINDINGS)
    statuses = spark.createDataFrame([("RES_D", "approved")], STATUSES)
    for findings in (found, found.limit(0)):
        answers = q.explain_results(routed, findings, statuses)
        assert answers.first().answer_text == q.NOTHING_VALIDATED
        assert q.explanation_citations(answers, findings, statuses).count() == 0
