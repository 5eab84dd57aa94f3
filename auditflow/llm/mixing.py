"""Mix sources to target weights by Poisson replication.

Every document is repeated ``n`` times, ``n`` drawn from a Poisson distribution whose mean is the
repetition rate its source needs to reach its weight. The draw inverts the distribution at a
uniform number made from a hash of the document's identifier and a seed, so it is the same in every
run, and a lost task repeats it exactly. Only DataFrame functions.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

OTHER = "__other__"
#: Largest mean of one draw; a larger one is the sum of several, since exp(-mean) must not vanish.
DRAW_MEAN = 500
#: Copies that are numbered at a time.
COPY_BLOCK = 100_000


def uniform(seed: int, *columns: Column) -> Column:
    """A number in (0, 1) from the MD5 of the seed and the columns: 52 bits, plus half a step."""
    text = F.concat_ws("|", F.lit(str(seed)), *(F.coalesce(c.cast("string"), F.lit("")) for c in columns))
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long").cast("double") + 0.5) / F.lit(float(2**52))


def poisson_count(u: Column, mean: Column, largest: float | None) -> Column:
    """The smallest k whose cumulative Poisson probability reaches ``u``; no mean is above ``largest``.

    With None the row's own mean, ``DRAW_MEAN`` at most, bounds the steps.
    """
    if largest is not None and largest > DRAW_MEAN:
        raise ValueError(f"one draw has a mean of {DRAW_MEAN} at most; use repetitions")
    bound = mean if largest is None else F.lit(largest)
    steps = F.floor(bound + 12 * F.sqrt(bound) + 20).cast("int")  # what lies beyond, a double can't tell from 0
    none = F.exp(-mean)
    start = F.struct(none.alias("term"), none.alias("total"), F.when(u > none, 1).otherwise(0).alias("k"))

    def step(acc: Column, i: Column) -> Column:
        term = acc["term"] * mean / i.cast("double")
        total = acc["total"] + term
        return F.struct(term.alias("term"), total.alias("total"), (acc["k"] + F.when(u > total, 1).otherwise(0)).alias("k"))

    counted = F.aggregate(F.sequence(F.lit(1), steps), start, step, lambda acc: acc["k"])
    return F.when(mean > 0, counted).otherwise(0)


def repetitions(mean: Column, seed: int, *columns: Column) -> Column:
    """A Poisson number of any mean, drawn at uniform numbers of the seed and the columns.

    A mean above ``DRAW_MEAN`` is parted evenly; the parts are drawn each at a number of its own
    and summed, which has the same distribution.
    """
    parts = F.greatest(F.ceil(mean / DRAW_MEAN), F.lit(1))
    others = F.transform(F.sequence(F.lit(0).cast("long"), parts - 1), lambda part: uniform(seed, F.lit("part"), part, *columns))
    each = F.concat(F.array(uniform(seed, *columns)), F.slice(others, F.lit(2), F.greatest(parts - 1, F.lit(0)).cast("int")))
    return F.aggregate(each, F.lit(0).cast("long"), lambda total, u: total + poisson_count(u, mean / parts, None))


def source_rates(docs: DataFrame, weights: Mapping[str, float], source_col: str, size: Column, total: float | None) -> dict[str, float]:
    """Repetitions that each named source needs; sources without a weight share that of ``OTHER``.

    A source that has rows but no size gets its weight's share of all rows instead. One aggregate;
    the driver receives one row per name of ``weights`` at most.
    """
    named = [s for s in weights if s != OTHER]
    group = F.when(F.col(source_col).isin(named), F.col(source_col)).otherwise(F.lit(OTHER)) if named else F.lit(OTHER)
    rows = docs.groupBy(group.alias("g")).agg(F.sum(size).cast("double").alias("n"), F.count(F.lit(1)).alias("rows")).collect()
    sizes, counts = {r["g"]: r["n"] or 0.0 for r in rows}, {r["g"]: r["rows"] for r in rows}
    whole, size_of_all, all_rows = sum(weights.values()), sum(sizes.values()), sum(counts.values())
    target = size_of_all if total is None else total
    # With a total the rows grow as the sizes do.
    row_target = all_rows * (target / size_of_all if size_of_all else 1.0)

    def rate(s: str, share: float) -> float:
        if sizes.get(s):
            return target * share / sizes[s]
        return row_target * share / counts[s] if counts.get(s) else 0.0

    return {s: rate(s, w / whole) for s, w in weights.items()}


def mix(
    docs: DataFrame,
    weights: Mapping[str, float],
    *,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    seed: int = 42,
    unit: str = "chars",
    total: float | None = None,
) -> DataFrame:
    """``docs`` repeated so that sources have shares near ``weights``, in one global random order.

    ``unit`` says what a share is measured in: ``chars`` of the text or ``rows``; ``total`` is the
    size aimed at (None: that of ``docs``). All columns stay; ``copy`` (0, 1, ...) and
    ``shuffle_key`` are added, replacing columns of those names. Rows without a source, and of
    sources that ``weights`` doesn't name, count as ``OTHER`` and go if that has no weight. With
    ``chars``, a source (or ``OTHER``) whose texts are all null or empty has no size to be weighed
    by: it is mixed by rows, to its weight's share of all rows (times total over the size of
    ``docs``, if a total is given). A rate may have any size.
    Rows without an identifier draw by their text; equal rows draw the same number. An empty table
    gives an empty one. The order is that of a hash of seed, identifier and copy.
    """
    size = F.length(F.coalesce(F.col(text_col), F.lit(""))) if unit == "chars" else F.lit(1)
    docs = docs.drop("copy", "shuffle_key")
    rates = source_rates(docs, weights, source_col, size, total)
    key = F.coalesce(F.col(id_col).cast("string"), F.md5(F.coalesce(F.col(text_col), F.lit(""))))
    rate = F.lit(float(rates.get(OTHER, 0.0)))
    for source, r in rates.items():
        if source != OTHER:
            rate = F.when(F.col(source_col) == source, F.lit(float(r))).otherwise(rate)
    largest = max([0.0, *rates.values()])
    drawn = docs.withColumn("__rate", rate).withColumn("__u", uniform(seed, key))
    if largest > DRAW_MEAN:  # no array of all copies of a row
        drawn = drawn.withColumn("__n", repetitions(F.col("__rate"), seed, key)).where("__n > 0").drop("__u", "__rate")
        first = F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1, F.lit(COPY_BLOCK).cast("long")))
        drawn = drawn.withColumn("__first", first)
        numbers = F.sequence(F.col("__first"), F.least(F.col("__n"), F.col("__first") + COPY_BLOCK) - 1)
        copies = drawn.withColumn("copy", F.explode(numbers)).withColumn("copy", F.col("copy").cast("int")).drop("__n", "__first")
    else:
        copies = drawn.withColumn("__n", poisson_count(F.col("__u"), F.col("__rate"), largest)).where("__n > 0")
        copies = copies.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("__n") - 1))).drop("__n", "__u", "__rate")
    order = F.md5(F.concat_ws("|", F.lit(f"order{seed}"), key, F.col("copy").cast("string")))
    return copies.withColumn("shuffle_key", order).repartition("shuffle_key").sortWithinPartitions("shuffle_key")
