"""Lenient parsing of text cells and guarded arithmetic, as column expressions."""

from __future__ import annotations

import re
from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import (
    DateType,
    DecimalType,
    NumericType,
    TimestampNTZType,
    TimestampType,
)

from auditflow.records import MONEY, UNKNOWN_MEMBER

DATE_FORMATS = ("yyyy-MM-dd",)

# What counts as a number. Checked before any cast, since engines differ in the
# suffixes ("10d", "1f") and words ("NaN") their casts let through.
NUMBER_PATTERN = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
LEADING_ZERO_PATTERN = r"^0[0-9]+$"

_RATIO = "decimal(38,10)"


def is_missing(c: Column) -> Column:
    """Null or the empty string; an empty text cell is never stored as null."""
    return c.isNull() | (c == "")


def _dotted(c: Column) -> Column:
    return F.replace(c, F.lit(","), F.lit("."))


def is_number(c: Column) -> Column:
    return F.coalesce(_dotted(c).rlike(NUMBER_PATTERN), F.lit(False))


def parse_double(c: Column) -> Column:
    """Text to double; a comma is a decimal comma, anything unreadable is null."""
    return F.when(is_number(c), F.trim(_dotted(c)).try_cast("double"))


def parse_number(c: Column, dtype: DecimalType = MONEY) -> Column:
    """Text to an exact decimal; anything unreadable is null."""
    return F.when(is_number(c), F.trim(_dotted(c)).try_cast(dtype.simpleString()))


def as_amount(df: DataFrame, name: str, dtype: DecimalType = MONEY) -> Column:
    """Column ``name`` as an exact amount, with missing and unreadable cells as 0."""
    c = F.col(f"`{name}`")
    if isinstance(df.schema[name].dataType, NumericType):
        parsed = c.try_cast(dtype.simpleString())
    else:
        parsed = parse_number(c.cast("string"), dtype)
    return F.coalesce(parsed, F.lit(0).cast(dtype.simpleString()))


def _shape(date_format: str) -> str | None:
    """A pattern for texts that can fit an all-digits date format; None for other formats."""
    shape = ""
    for run in re.finditer(r"([A-Za-z])\1*|[^A-Za-z]", date_format):
        token = run.group()
        if not token[0].isalpha():
            shape += re.escape(token)
        elif token in ("yyyy", "MM", "dd", "HH", "mm", "ss"):
            shape += r"\d{%d}" % len(token)
        else:
            return None
    return f"^{shape}$"


def parse_date(c: Column, formats: Sequence[str] = DATE_FORMATS) -> Column:
    """Text to a date by the first format that fits; impossible days are null.

    A failed parse is costly, so cells that do not look like a date are not parsed.
    """
    attempts = []
    for date_format in formats:
        parsed = F.try_to_timestamp(c, F.lit(date_format)).cast("date")
        shape = _shape(date_format)
        attempts.append(parsed if shape is None else F.when(c.rlike(shape), parsed))
    return attempts[0] if len(attempts) == 1 else F.coalesce(*attempts)


def as_date(df: DataFrame, name: str, formats: Sequence[str] = DATE_FORMATS) -> Column:
    """Column ``name`` as a date, whether it is stored as text or already typed."""
    dtype = df.schema[name].dataType
    c = F.col(f"`{name}`")
    if isinstance(dtype, (DateType, TimestampType, TimestampNTZType)):
        return c.cast("date")
    return parse_date(c, formats)


def month_key(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM")


def has_leading_zero(c: Column) -> Column:
    return F.coalesce(c.rlike(LEADING_ZERO_PATTERN), F.lit(False))


def is_whole(c: Column) -> Column:
    return c % 1 == 0


def round_to(c: Column, places: int) -> Column:
    """Half-up rounding of a double, by way of a decimal so that ties are exact."""
    return F.round(c.try_cast(_RATIO), places).cast("double")


def round_amount(c: Column, places: int = 2) -> Column:
    """Half-up rounding of an exact amount, which leaves as a double."""
    return F.round(c, places).cast("double")


def ratio(num: Column, den: Column, places: int = 2) -> Column:
    """``num / den`` rounded, 0.0 where the denominator is zero."""
    quotient = num.cast("double") / den.cast("double")
    return F.when(den != 0, round_to(quotient, places)).otherwise(F.lit(0.0))


def percent(num: Column, den: Column, places: int = 2) -> Column:
    quotient = num.cast("double") / den.cast("double") * 100
    return F.when(den != 0, round_to(quotient, places)).otherwise(F.lit(0.0))


def percent_of_rows(num: Column, rows: Column, places: int = 2) -> Column:
    """Share of a row count in percent; an empty table counts as one row."""
    return percent(num, F.greatest(rows, F.lit(1)), places)


def known_member(c: Column) -> Column:
    """Dimension member with null as ``Unclassified``; blanks stay as they are."""
    return F.coalesce(c.cast("string"), F.lit(UNKNOWN_MEMBER))


def fill_unknown_members(df: DataFrame) -> DataFrame:
    return df.na.fill(UNKNOWN_MEMBER)


def sample_std(c: Column) -> Column:
    """Sample standard deviation, 0.0 for a single value and null for none."""
    return F.when(F.count(c) == 1, F.lit(0.0)).otherwise(F.stddev_samp(c))


def month_start(period: str) -> date:
    year, month = period.split("-")
    return date(int(year), int(month), 1)


def next_month_start(period: str) -> date:
    start = month_start(period)
    return date(start.year + start.month // 12, start.month % 12 + 1, 1)


def in_month(df: DataFrame, date_col: str, period: str) -> Column:
    """Half-open range test for a ``YYYY-MM`` month.

    A range over the stored column, in the column's own type, reaches the Parquet
    scan; comparing a formatted month would not.
    """
    dtype = df.schema[date_col].dataType
    c = F.col(f"`{date_col}`")
    low = F.lit(month_start(period)).cast(dtype)
    high = F.lit(next_month_start(period)).cast(dtype)
    return (c >= low) & (c < high)
