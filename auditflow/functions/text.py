"""Jobs over text columns: length budget, secret redaction, number formatting."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

# The length budget, and the markers left in a text.
DEFAULT_TEXT_BUDGET = 15000
TRUNCATION_MARKER = "\n...[Context truncated due to security limit]..."
REDACTION_MARKER = "[REDACTED_API_KEY]"


def truncated(c: Column, max_chars: int = DEFAULT_TEXT_BUDGET, marker: str = TRUNCATION_MARKER) -> Column:
    """The first ``max_chars`` characters plus a marker; shorter texts unchanged."""
    cut = F.concat(F.substring(c, 1, max_chars), F.lit(marker))
    return F.when(F.length(c) > max_chars, cut).otherwise(c)


def truncate_text(
    df: DataFrame, text_col: str, *, max_chars: int = DEFAULT_TEXT_BUDGET, marker: str = TRUNCATION_MARKER
) -> DataFrame:
    c = F.col(text_col)
    return df.withColumn("was_truncated", F.coalesce(F.length(c) > max_chars, F.lit(False))).withColumn(
        text_col, truncated(c, max_chars, marker)
    )


def occurrences(c: Column, needle: str) -> Column:
    """How often ``needle`` occurs in ``c``, without overlaps."""
    removed = F.length(c) - F.length(F.replace(c, F.lit(needle), F.lit("")))
    return F.coalesce((removed / len(needle)).cast("long"), F.lit(0))


def redact_text(
    df: DataFrame, text_cols: Sequence[str], secrets: Sequence[str], *, marker: str = REDACTION_MARKER
) -> DataFrame:
    """Replace each secret, in the given order, in every text column.

    ``redaction_hits`` counts replacements over all columns: a secret is counted
    in the text that the secrets before it have left.
    """
    secrets = [s for s in secrets if s]
    if any(s in marker for s in secrets):
        raise ValueError("a secret must not be part of the marker")
    df = df.withColumn("redaction_hits", F.lit(0).cast("long"))
    for secret in secrets:
        hits = reduce(Column.__add__, [occurrences(F.col(c), secret) for c in text_cols], F.col("redaction_hits"))
        cleaned = {c: F.replace(F.col(c), F.lit(secret), F.lit(marker)) for c in text_cols}
        df = df.withColumns({"redaction_hits": hits, **cleaned})
    return df


def money_text(c: Column, places: int = 0) -> Column:
    """``$1,234`` with the sign in front of the currency symbol."""
    amount = F.concat(F.lit("$"), F.format_number(F.abs(c), places))
    return F.when(F.round(c, places) < 0, F.concat(F.lit("-"), amount)).otherwise(amount)


def percent_text(c: Column, places: int = 1) -> Column:
    return F.concat(F.format_number(c, places), F.lit("%"))
