"""Personal data: patterns propose spans, checksums confirm them, nearby words move the score.

Everything is a column expression, so a text never leaves the JVM. A pattern's matches and the
stretches between them (``split`` by the same pattern) give the places of all matches: the sum of
what lies before each. The four base kinds are counted by their pattern and validator alone; more
kinds need a checksum (IBAN by mod-97, card groups by Luhn and the issuer's first digits), free
ends on both sides, or a word nearby that says what a number is.

Base patterns are written so that the regular-expression engine never backtracks into a run: a run
is entered at its beginning only, or where the last match ended (``\\G``), and taken whole
(``++``). That finds the same matches as the plain patterns do, in time linear in the text, and
needs no recursion for long ones.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

#: Characters before and after a span in which context words count, up to the next match of its pattern.
NEARBY = 40
#: A span of an added kind needs this score, in hundredths.
LEAST_SCORE = 50
#: Matches that are summed up together; places take time with the square of it, not of all matches.
CHUNK = 128

_LOCAL = "[A-Za-z0-9._%+-]"


@dataclass(frozen=True)
class Kind:
    """A pattern, what confirms a match, how sure one is (in hundredths), and what its context adds.

    ``bounds`` is a class of characters that must not stand right before or behind a match.
    """

    name: str
    pattern: str
    valid: Callable[[Column], Column]
    score: int
    context: str
    boost: int
    bounds: str | None = None


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _solid(match: Column) -> Column:
    return F.replace(match, F.lit(" "), F.lit(""))


def luhn(digits: Column) -> Column:
    """Whether the Luhn sum of a text of digits is a multiple of ten."""

    def worth(d: Column, i: Column) -> Column:
        return F.when(i % 2 == 0, d).otherwise((d * 2) % 10 + F.when(d > 4, 1).otherwise(0))

    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: worth(F.ascii(d) - 48, i))
    return (F.length(digits) > 0) & (F.aggregate(each, F.lit(0), lambda a, d: a + d) % 10 == 0)


def mod97(account: Column) -> Column:
    """Whether an account number (country, check digits, the rest; no blanks) leaves 1 when divided by 97."""
    moved = F.concat(F.substring(account, 5, 64), F.substring(account, 1, 4))

    def step(rest: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code < 58, rest * 10 + code - 48).otherwise(rest * 100 + code - 55) % 97

    return F.aggregate(F.split(moved, ""), F.lit(0), step) == 1


def _between(n: Column, low: int, high: int) -> Column:
    return (n >= low) & (n <= high)


_BYTE = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"

CARD_WORDS, PHONE_WORDS = "card|visa|master|credit|payment", "phone|tel|call|mobile|fax"

#: The base kinds, in the order in which spans of one start are listed.
BASE = (
    Kind("email", rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", lambda m: F.lit(True), 90, "mail|contact", 10),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", lambda m: m.rlike(rf"^{_BYTE}\.{_BYTE}\.{_BYTE}\.{_BYTE}$"), 60, "address|host|server", 30),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", lambda m: _between(F.length(_digits(m)), 14, 19) & luhn(_digits(m)), 80, CARD_WORDS, 20),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: _between(F.length(_digits(m)), 10, 15), 70, PHONE_WORDS, 30),
)

#: Kinds that the method adds.
ADDED = (
    Kind(
        "iban", r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?",
        lambda m: _between(F.length(_solid(m)), 15, 34) & mod97(_solid(m)), 90, "iban|account|bank", 10, "[A-Za-z0-9]",
    ),
    # Cards among other digits, where the base pattern takes one match too long to be a card.
    Kind(
        "card_group", r"[0-9]{4}[\x20-]?[0-9]{4}[\x20-]?[0-9]{4}[\x20-]?[0-9]{4}",
        lambda m: m.rlike("^(?:4|5[1-5]|2[2-7]|6)") & luhn(_digits(m)), 70, CARD_WORDS, 20, "[0-9]",
    ),
    Kind("card_short", "[0-9]{13}", lambda m: m.startswith("4") & luhn(m), 30, CARD_WORDS, 30, "[0-9]"),
    Kind("ssn", "[0-9]{3}-[0-9]{2}-[0-9]{4}", lambda m: ~m.rlike("^(?:000|666|9)|-00-|-0000$"), 40, "ssn|social|security|tax", 50, "[0-9-]"),
)

KINDS = BASE + ADDED


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often it is used."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def _total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0).cast("long"), lambda a, n: a + n)


def _places(gaps: Column, matches: Column) -> Column:
    """Where each match begins: what lies before it, summed in chunks so that long lists stay cheap."""
    n = F.size(matches)
    ends = F.zip_with(F.slice(gaps, F.lit(1), n), matches, lambda g, m: (F.length(g) + F.length(m)).cast("long"))

    def cut(steps: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((n - 1) / CHUNK).cast("int")), lambda c: F.slice(steps, c * CHUNK + 1, F.lit(CHUNK)))

    def upto(chunks: Column, sums: Column) -> Column:
        def inside(chunk: Column, c: Column) -> Column:
            return _let(_total(F.slice(sums, F.lit(1), c)), lambda before: F.transform(chunk, lambda _, i: before + _total(F.slice(chunk, F.lit(1), i + 1))))

        return F.flatten(F.transform(chunks, inside))

    stops = _let(ends, lambda steps: _let(cut(steps), lambda chunks: _let(F.transform(chunks, _total), lambda sums: upto(chunks, sums))))
    return F.zip_with(stops, matches, lambda stop, m: stop - F.length(m))


_SPAN = "struct<start: bigint, rank: int, end: bigint, kind: string, score: int, base: boolean>"


def _spans(matches: Column, gaps: Column, kind: Kind, rank: int, base: bool) -> Column:
    """The confirmed spans of one kind, from its matches and the stretches around them."""

    def bounded(z: Column) -> Column:
        if kind.bounds is None:
            return F.lit(True)
        # An empty stretch between two matches means that one touches the other.
        left = ((z["i"] == 0) | (z["before"] != "")) & ~z["before"].rlike(f"{kind.bounds}$")
        return left & ((z["i"] == F.size(matches) - 1) | (z["behind"] != "")) & ~z["behind"].rlike(f"^{kind.bounds}")

    def span(z: Column) -> Column:
        near = F.concat(F.right(z["before"], F.lit(NEARBY)), F.lit(" "), F.left(z["behind"], F.lit(NEARBY)))
        score = F.when(near.rlike(f"(?i){kind.context}"), F.lit(kind.score + kind.boost)).otherwise(F.lit(kind.score))
        end = z["s"] + F.length(z["m"])
        fields = {"start": z["s"], "rank": F.lit(rank), "end": end, "kind": F.lit(kind.name), "score": score, "base": F.lit(base)}
        return F.struct(*(c.alias(name) for name, c in fields.items()))

    number = F.sequence(F.lit(0), F.size(matches) - 1)
    places = F.arrays_zip(
        matches.alias("m"), _places(gaps, matches).alias("s"), F.slice(gaps, F.lit(1), F.size(matches)).alias("before"),
        F.slice(gaps, F.lit(2), F.size(matches)).alias("behind"), number.alias("i"),
    )
    confirmed = F.filter(places, lambda z: F.coalesce(kind.valid(z["m"]) & bounded(z), F.lit(False)))
    return F.when(F.size(matches) > 0, F.transform(confirmed, span)).otherwise(F.array().cast(f"array<{_SPAN}>"))


def find_private(docs: DataFrame, *, text_col: str = "text", into: str = "spans", least_score: int = LEAST_SCORE) -> DataFrame:
    """``docs`` with ``into``: (start, rank, end, kind, score, base) of all spans of personal data.

    They are in order of start and kind (``rank``: its place in ``KINDS``). Starts count code points
    from 0; an end is behind the span. Base kinds (``base`` true) are the leftmost matches of their pattern that don't overlap, if confirmed; each kind is found on its
    own, so spans of two kinds may overlap. Other kinds are kept from ``least_score`` on. Added
    card groups inside a base card aren't listed again.

    Null and empty texts have no spans. Rows are independent, so repeated rows and identifiers
    keep theirs. All columns stay; one named as ``into`` is replaced. An empty table stays empty.
    """
    text = F.col(text_col).cast("string")
    # Matches and stretches are columns of their own first, so that no pattern runs twice for the same thing.
    matches, gaps, each = ({k.name: f"__{what}_{k.name}" for k in KINDS} for what in ("matches", "gaps", "spans"))
    found = docs.select("*", *(F.regexp_extract_all(text, F.lit(k.pattern), F.lit(0)).alias(matches[k.name]) for k in KINDS))
    found = found.select("*", *(F.when(F.size(matches[k.name]) > 0, F.split(text, k.pattern, -1)).alias(gaps[k.name]) for k in KINDS))
    spans = (_spans(F.col(matches[k.name]), F.col(gaps[k.name]), k, i, i < len(BASE)).alias(each[k.name]) for i, k in enumerate(KINDS))
    found = found.select("*", *spans).drop(*matches.values(), *gaps.values())

    def wanted(s: Column) -> Column:
        covered = F.exists(F.col(each["card"]), lambda c: (c["start"] <= s["start"]) & (s["end"] <= c["end"]))
        return (s["score"] >= least_score) & ~(s["kind"].startswith("card_") & covered)

    base = F.flatten(F.array(*(F.col(each[k.name]) for k in BASE)))
    added = F.filter(F.flatten(F.array(*(F.col(each[k.name]) for k in ADDED))), wanted)
    return found.withColumn(into, F.array_sort(F.concat(base, added))).drop(*each.values())


def listed(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def summary(found: DataFrame, *, id_col: str = "doc_id", spans_col: str = "spans") -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256, spans as text, and scores in the same order."""
    spans = F.col(spans_col)
    base = F.filter(spans, lambda s: s["base"])

    def count(kind: Kind) -> Column:
        return F.size(F.filter(base, lambda s: s["kind"] == kind.name)).cast("long").alias(f"n_{kind.name}")

    scores = F.array_join(F.transform(spans, lambda s: s["score"].cast("string")), ",")
    return found.select(F.col(id_col), *map(count, BASE), F.sha2(listed(base), 256).alias("base_sha256"), listed(spans).alias("spans"), scores.alias("scores"))
