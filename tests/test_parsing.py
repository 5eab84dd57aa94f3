from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from auditflow.functions import naming, parsing as p, text


def one(spark, value, make, dtype="string"):
    return spark.createDataFrame([(value,)], f"c {dtype}").select(make(F.col("c")).alias("r")).first().r


@pytest.mark.parametrize(
    "cell,expected",
    [
        ("12", Decimal("12.0000")),
        (" 12.5 ", Decimal("12.5000")),
        ("12,5", Decimal("12.5000")),
        ("-.5", Decimal("-0.5000")),
        ("1e2", Decimal("100.0000")),
        ("1,234.5", None),
        ("10d", None),
        ("NaN", None),
        ("inf", None),
        ("", None),
        (None, None),
    ],
)
def test_parse_number(spark, cell, expected):
    assert one(spark, cell, p.parse_number) == expected


@pytest.mark.parametrize(
    "cell,expected",
    [
        ("2026-02-28", date(2026, 2, 28)),
        ("2026-02-30", None),
        ("CORRUPT_DATE", None),
        ("2026", None),
        ("2026-02", None),
        ("2026-3-1", None),
        ("2026-03-01 10:00:00", None),
        ("", None),
        (None, None),
    ],
)
def test_parse_date(spark, cell, expected):
    assert one(spark, cell, p.parse_date) == expected


def test_parse_date_formats(spark):
    formats = ("yyyy-MM-dd", "dd/MM/yyyy", "d MMM yyyy")
    for cell in ("2026-03-01", "01/03/2026", "1 Mar 2026"):
        assert one(spark, cell, lambda c: p.parse_date(c, formats)) == date(2026, 3, 1)


def test_missing_and_leading_zeros(spark):
    assert [one(spark, v, p.is_missing) for v in (None, "", " ", "x")] == [True, True, False, False]
    assert [one(spark, v, p.has_leading_zero) for v in ("007", "0", "07a", "70", None)] == [True, False, False, False, False]


@pytest.mark.parametrize("value,expected", [(2.675, 2.68), (0.125, 0.13), (-0.125, -0.13), (1.005, 1.01)])
def test_rounding_is_half_up(spark, value, expected):
    assert one(spark, value, lambda c: p.round_to(c, 2), "double") == expected


def test_guarded_ratios(spark):
    row = spark.range(1).select(
        p.percent(F.lit(1), F.lit(0)).alias("zero_base"),
        p.percent(F.lit(1), F.lit(3)).alias("third"),
        p.percent_of_rows(F.lit(0), F.lit(0)).alias("empty"),
        p.ratio(F.lit(10), F.lit(4)).alias("ratio"),
    ).first()
    assert tuple(row) == (0.0, 33.33, 0.0, 2.5)


def test_sample_std_of_one_value_is_zero(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("b", 3.0), ("c", None)], "k string, v double")
    found = {r.k: r.s for r in df.groupBy("k").agg(p.sample_std(F.col("v")).alias("s")).collect()}
    assert found["a"] == 0.0 and round(found["b"], 6) == 1.414214 and found["c"] is None


def test_months():
    assert p.month_start("2026-03") == date(2026, 3, 1)
    assert p.next_month_start("2026-12") == date(2027, 1, 1)


def test_unknown_members_fill_nulls_but_not_blanks(spark):
    df = spark.createDataFrame([(None, 1), ("", 2), ("x", None)], "s string, n int")
    assert [tuple(r) for r in p.fill_unknown_members(df).collect()] == [("Unclassified", 1), ("", 2), ("x", None)]


def test_names(spark):
    assert naming.pick_fact(["customers", "Ventas_2026"]) == "Ventas_2026"
    assert naming.pick_fact(["a", "b"]) == "a"
    assert naming.row_meaning("x", ["customer_id"]).startswith("Customer")
    assert naming.status_column(["id", "Estado"]) == "Estado"
    names = spark.createDataFrame([("/in/My Orders 2026.csv",), ("a.b.CSV",)], "f string")
    assert [r[0] for r in names.select(naming.table_name_of(F.col("f"))).collect()] == ["my_orders_2026", "a.b"]


def test_redaction(spark):
    df = spark.createDataFrame([("key=abc123 and abc123", "no"), (None, "abc123")], "m string, n string")
    out = text.redact_text(df, ["m", "n"], ["abc123", ""]).collect()
    assert out[0].m == "key=[REDACTED_API_KEY] and [REDACTED_API_KEY]" and out[0].redaction_hits == 2
    assert out[1].m is None and out[1].n == "[REDACTED_API_KEY]" and out[1].redaction_hits == 1
    with pytest.raises(ValueError):
        text.redact_text(df, ["m"], ["API"])


def test_truncation_and_formats(spark):
    df = spark.createDataFrame([("abcdef",), ("abc",), (None,)], "t string")
    out = text.truncate_text(df, "t", max_chars=3, marker="~").collect()
    assert [(r.t, r.was_truncated) for r in out] == [("abc~", True), ("abc", False), (None, False)]
    row = spark.range(1).select(
        text.money_text(F.lit(-1234.4)).alias("m"), text.money_text(F.lit(0.2)).alias("z"), text.percent_text(F.lit(12.34)).alias("p")
    ).first()
    assert tuple(row) == ("-$1,234", "$0", "12.3%")
