"""Fact-to-dimension joins which cannot inflate a metric, and their diagnostics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import DecimalType, StringType

from auditflow.functions.naming import KEY_NAME_PARTS, columns_with, is_fact_name
from auditflow.functions.parsing import as_amount, is_missing, percent_of_rows, ratio
from auditflow.records import JOIN_CHECK, MONEY, RELATIONSHIP, conform

METRIC_TOLERANCE = 0.01


class Link(NamedTuple):
    """How a fact (or an already joined dimension) refers to a dimension."""

    left_key: str
    dimension: str
    right_key: str


def _key(df: DataFrame, name: str, as_text: bool) -> Column:
    c = F.col(f"`{name}`")
    return c.cast(StringType()) if as_text else c


def _types_differ(left: DataFrame, left_key: str, right: DataFrame, right_key: str) -> bool:
    return left.schema[left_key].dataType != right.schema[right_key].dataType


# ---------------------------------------------------------------------------
# Diagnostics
# ---------------------------------------------------------------------------
def key_profile(
    fact: DataFrame, dim: DataFrame, left_key: str, right_key: str | None = None, *, metric: str | None = None
) -> DataFrame:
    """Both sides grouped to their keys, then aligned: one row per key value.

    Whatever a row join would do to row counts and metric can be computed from
    these counts, without joining rows. Both sides are pre-aggregated, so a key
    that holds most of the fact is one row here.
    """
    right_key = right_key or left_key
    as_text = _types_differ(fact, left_key, dim, right_key)
    amount = as_amount(fact, metric) if metric else F.lit(0).cast(MONEY)
    left = fact.groupBy(_key(fact, left_key, as_text).alias("left_value")).agg(
        F.count(F.lit(1)).alias("left_n"), F.sum(amount).alias("metric")
    )
    right = dim.groupBy(_key(dim, right_key, as_text).alias("right_value")).agg(F.count(F.lit(1)).alias("right_n"))
    return left.join(right, F.col("left_value") == F.col("right_value"), "full_outer")


def join_diagnostics(
    fact: DataFrame,
    dim: DataFrame,
    left_key: str,
    right_key: str | None = None,
    *,
    metric: str | None = None,
    deduplicated: bool = False,
    order_by: Sequence[str] | None = None,
    blank_is_orphan: bool = True,
    left_table: str = "fact",
    right_table: str = "dimension",
) -> DataFrame:
    """One row on what a left join of ``fact`` to ``dim`` does, before it is run.

    Null keys match nothing and count neither as matched nor as orphans. Blank
    keys count as orphans unless ``blank_is_orphan`` is false; they are also
    reported on their own. With ``deduplicated`` the diagnosed join is that to
    ``deduplicate(dim)``, whose output is counted like any other dimension.
    """
    right_key = right_key or left_key
    if deduplicated:
        dim = deduplicate(dim, right_key, order_by=order_by)
    profile = key_profile(fact, dim, left_key, right_key, metric=metric)
    zero = F.lit(0).cast("long")
    left_n, right_n = F.coalesce("left_n", zero), F.coalesce("right_n", zero)
    matches = F.greatest(right_n, F.lit(1).cast("long"))
    has_left, has_right = F.col("left_value").isNotNull(), F.col("right_value").isNotNull()
    blank = has_left & is_missing(F.col("left_value").cast(StringType()))
    orphan = has_left & ~has_right
    if not blank_is_orphan:
        orphan = orphan & ~blank

    def total(c: Column) -> Column:
        return F.coalesce(F.sum(c), zero)

    def amount(c: Column) -> Column:
        return F.coalesce(F.sum(c), F.lit(0)).cast(DecimalType(38, 4))

    one = F.lit(1).cast("long")
    counts = profile.agg(
        total(left_n).alias("left_rows"),
        total(right_n).alias("right_rows"),
        total(left_n * matches).alias("result_rows"),
        total(F.when(has_left, left_n)).alias("left_keyed_rows"),
        total(F.when(F.col("left_n").isNotNull() & ~has_left, left_n)).alias("null_keys_left"),
        total(F.when(blank, left_n)).alias("blank_keys_left"),
        total(F.when(orphan, left_n)).alias("orphans_left"),
        total(F.when(has_right, one)).alias("right_keys"),
        total(F.when(has_right & ~has_left, one)).alias("orphans_right"),
        total(F.when(has_right & (right_n > 1), right_n)).alias("right_repeated_rows"),
        F.coalesce(F.max(F.when(has_right, right_n)), zero).alias("max_rows_per_key"),
        amount(F.col("metric")).alias("metric_before"),
        amount(F.col("metric") * matches).alias("metric_after"),
    )
    unique = F.col("max_rows_per_key") <= 1
    factor = ratio(F.col("result_rows"), F.greatest(F.col("left_rows"), F.lit(1)), 4)
    reconciled = F.abs(F.col("metric_after") - F.col("metric_before")) < METRIC_TOLERANCE
    return (
        counts.withColumns(
            {
                "left_table": F.lit(left_table),
                "right_table": F.lit(right_table),
                "left_key": F.lit(left_key),
                "right_key": F.lit(right_key),
                "join_keys": F.lit(f"{left_key} = {right_key}"),
                "multiplication_factor": factor,
                "match_rate_left": percent_of_rows(
                    F.col("left_keyed_rows") - F.col("orphans_left"), F.col("left_keyed_rows")
                ),
                "match_rate_right": percent_of_rows(F.col("right_keys") - F.col("orphans_right"), F.col("right_keys")),
                "cardinality": F.when(unique, "many_to_one").otherwise("many_to_many"),
                "risk_level": F.when(~unique, "high").when(F.col("orphans_left") > 0, "medium").otherwise("low"),
                "metric_reconciled": reconciled,
            }
        )
        .withColumn("is_safe", (F.col("multiplication_factor") == 1.0) & F.col("metric_reconciled"))
        .withColumn(
            "warning",
            F.when(
                ~F.col("is_safe"),
                F.format_string(
                    "Rows multiply by %s and the metric changes by %s.",
                    F.col("multiplication_factor").cast(StringType()),
                    F.round(F.col("metric_after") - F.col("metric_before"), 2).cast(StringType()),
                ),
            ),
        )
    )


def join_check(diagnostics: DataFrame) -> DataFrame:
    """Diagnostics as join-check records."""
    return conform(diagnostics, JOIN_CHECK)


def relationship(diagnostics: DataFrame) -> DataFrame:
    """Diagnostics as relationship records."""
    rel_id = F.concat_ws("_", F.lit("REL"), "left_table", "right_table", "left_key")
    return conform(
        diagnostics.withColumns(
            {"id": rel_id, "orphan_count_left": F.col("orphans_left"), "orphan_count_right": F.col("orphans_right")}
        ),
        RELATIONSHIP,
    )


def orphan_keys(fact: DataFrame, dim: DataFrame, left_key: str, right_key: str | None = None) -> DataFrame:
    """Fact keys that the dimension lacks, each with its number of fact rows."""
    right_key = right_key or left_key
    as_text = _types_differ(fact, left_key, dim, right_key)
    used = (
        fact.where(F.col(f"`{left_key}`").isNotNull())
        .groupBy(_key(fact, left_key, as_text).alias("orphan_key"))
        .agg(F.count(F.lit(1)).alias("fact_rows"))
    )
    known = dim.select(_key(dim, right_key, as_text).alias("known_key"))
    return used.join(known, F.col("orphan_key") == F.col("known_key"), "left_anti")


def unused_keys(fact: DataFrame, dim: DataFrame, left_key: str, right_key: str | None = None) -> DataFrame:
    """Distinct dimension keys which no fact row refers to."""
    right_key = right_key or left_key
    as_text = _types_differ(fact, left_key, dim, right_key)
    known = dim.where(F.col(f"`{right_key}`").isNotNull()).select(_key(dim, right_key, as_text).alias("unused_key"))
    used = fact.select(_key(fact, left_key, as_text).alias("used_key")).distinct()
    return known.distinct().join(used, F.col("unused_key") == F.col("used_key"), "left_anti")


# ---------------------------------------------------------------------------
# Safe joins
# ---------------------------------------------------------------------------
def deduplicate(dim: DataFrame, key: str, *, order_by: Sequence[str] | None = None, keep: str = "first") -> DataFrame:
    """One row per key: the first (or, with ``keep='latest'``, the last) by ``order_by``.

    Spark rows have no order of their own, so the default order is all other
    columns, ascending. Written as an aggregate: it combines before the shuffle,
    and the optimizer drops the whole join if no dimension column is used.
    """
    others = [c for c in dim.columns if c != key]
    if not others:
        return dim.select(key).distinct()
    order = F.struct(*[F.col(f"`{c}`") for c in (order_by or others)])
    if order_by:  # ties are settled by the other columns
        order = F.struct(order.alias("given"), F.struct(*[F.col(f"`{c}`") for c in others]).alias("rest"))
    pick = {"first": F.min_by, "latest": F.max_by}[keep]
    row = pick(F.struct(*[F.col(f"`{c}`") for c in others]), order)
    grouped = dim.groupBy(F.col(f"`{key}`")).agg(row.alias("_row"))
    return grouped.select(F.col(f"`{key}`"), *[F.col(f"_row.`{c}`").alias(c) for c in others])


def prefix_clashes(dim: DataFrame, taken: Sequence[str], dim_name: str, key: str) -> DataFrame:
    """Dimension columns that exist already get the dimension's name as prefix."""
    return dim.withColumnsRenamed({c: f"{dim_name}_{c}" for c in dim.columns if c != key and c in taken})


def splittable(left: Sequence[Column], right: Sequence[Column]) -> Column:
    """Equality of keys, and of their hash, for a join whose left side may be skewed.

    Adaptive execution splits a skewed partition only if both sides are shuffled
    for the join itself. A side that was grouped by the key is not, since it lies
    right already. The hash as a further key makes Spark shuffle it once more, and
    a key with much of the left side no longer ends up in one task.
    """
    equal = reduce(Column.__and__, [a == b for a, b in zip(left, right, strict=True)])
    return equal & (F.xxhash64(*left) == F.xxhash64(*right))


def lookup(df: DataFrame, unique: DataFrame, on: Sequence[str], how: str = "left") -> DataFrame:
    """Join to a table with one row per key, where many rows of ``df`` may share a key."""
    renamed = unique.withColumnsRenamed({k: f"_right_{k}" for k in on})
    condition = splittable([df[k] for k in on], [renamed[f"_right_{k}"] for k in on])
    return df.join(renamed, condition, how).drop(*[f"_right_{k}" for k in on])


def _marked(df: DataFrame, heavy: DataFrame, on: Sequence[str]) -> DataFrame:
    """``df`` with ``_heavy``. Spark broadcasts the list if its size allows, else it may split the side of ``df``."""
    renamed = heavy.withColumnsRenamed({c: f"_heavy_{c}" for c in on})
    same = splittable([F.col(f"`{c}`") for c in on], [F.col(f"`_heavy_{c}`") for c in on])
    return df.join(renamed, same, "left").drop(*[f"_heavy_{c}" for c in on])


def salted_lookup(
    fact: DataFrame,
    lookup: DataFrame,
    on: Sequence[str],
    *,
    salt_over: int,
    salts: int = 32,
    fact_counts: DataFrame | None = None,
) -> DataFrame:
    """Left join to a lookup with unique keys, with heavy keys spread over tasks.

    All keys of more than ``salt_over`` fact rows are salted: there are at most as
    many as that number goes into the rows of the fact. Their fact rows are spread by a hash of the row's content, which is the same when a lost task
    is run again, and their lookup rows are repeated once per salt. Exact copies of
    a row share a salt; adaptive execution splits those by the task they came from.
    All other keys are joined as they are. ``fact_counts`` may bring the rows per key (``on`` plus
    ``n``) if known.
    """
    if fact_counts is None:
        fact_counts = fact.groupBy(*on).agg(F.count(F.lit(1)).alias("n"))
    heavy = fact_counts.where(F.col("n") > salt_over).select(*on, F.lit(True).alias("_heavy"))
    content = F.xxhash64(*[F.col(f"`{c}`") for c in fact.columns])
    unmatched = reduce(Column.__or__, [F.col(f"`{c}`").isNull() for c in on])  # a null key needs no partner
    spread = F.col("_heavy") | unmatched
    salted_fact = (
        _marked(fact, heavy, on)
        .withColumn("_salt", F.when(spread, F.pmod(content, F.lit(salts))).otherwise(F.lit(0)).cast("int"))
        .drop("_heavy")
    )
    last_salt = F.when(F.col("_heavy"), F.lit(salts - 1)).otherwise(F.lit(0))
    salted_lookup_rows = (
        _marked(lookup, heavy, on)
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), last_salt)))
        .drop("_heavy")
    )
    return salted_fact.join(salted_lookup_rows, [*on, "_salt"], "left").drop("_salt")


def safe_left_join(
    fact: DataFrame,
    dim: DataFrame,
    left_key: str,
    right_key: str | None = None,
    *,
    dim_name: str = "dim",
    order_by: Sequence[str] | None = None,
    keep: str = "first",
    null_safe: bool = False,
    salt_over: int | None = None,
    keep_partitioning: bool = False,
) -> DataFrame:
    """Left join to a dimension reduced to one row per key: no fact row is lost or repeated.

    Spark broadcasts the dimension if its size allows, else it sorts and merges,
    and splits skewed partitions of the fact at run time (see ``splittable``).
    ``salt_over`` spreads keys with more rows than that explicitly, see
    ``salted_lookup``. ``keep_partitioning`` is for a fact that already lies by the key,
    as a table bucketed by it into at least ``spark.sql.shuffle.partitions`` buckets: the
    fact isn't shuffled, and skewed keys aren't split.
    """
    right_key = right_key or left_key
    unique = prefix_clashes(deduplicate(dim, right_key, order_by=order_by, keep=keep), fact.columns, dim_name, right_key)
    if _types_differ(fact, left_key, dim, right_key):
        raise TypeError(f"{left_key} and {right_key} have different types; cast one of them first")
    if salt_over is not None:
        if null_safe:
            raise ValueError("salting leaves null keys unmatched; use one of null_safe and salt_over")
        keyed = unique.withColumn("_key", F.col(f"`{right_key}`"))
        keyed = keyed.drop(right_key) if right_key == left_key else keyed
        return salted_lookup(fact.withColumn("_key", F.col(f"`{left_key}`")), keyed, ["_key"], salt_over=salt_over).drop(
            "_key"
        )
    keyed = unique.withColumnRenamed(right_key, "_key")
    left, right = F.col(f"`{left_key}`"), F.col("_key")
    if null_safe:
        same = left.eqNullSafe(right)
    else:
        same = left == right if keep_partitioning else splittable([left], [right])
    joined = fact.join(keyed, same, "left")
    if right_key != left_key and right_key not in fact.columns:
        return joined.withColumnRenamed("_key", right_key)
    return joined.drop("_key")


def join_chain(
    fact: DataFrame,
    tables: Mapping[str, DataFrame],
    links: Sequence[Link],
    *,
    order_by: Mapping[str, Sequence[str]] | None = None,
    lies_by: str | None = None,
) -> DataFrame:
    """Safe joins in the given order; a link whose table or key is absent is skipped.

    A later link may start from a column that an earlier dimension brought in. Joins by
    ``lies_by``, the key that the fact is bucketed by, leave it where it lies if they come
    first (``keep_partitioning`` of ``safe_left_join``).
    """
    for _, joined in _joined_so_far(fact, tables, links, order_by, lies_by):
        fact = joined
    return fact


def _joined_so_far(fact, tables, links, order_by=None, lies_by=None):
    """Each link that applies, with the fact before it and after it."""
    for link in links:
        dim = tables.get(link.dimension)
        if dim is None or link.left_key not in fact.columns or link.right_key not in dim.columns:
            continue
        before = fact
        fact = safe_left_join(
            fact,
            dim,
            link.left_key,
            link.right_key,
            dim_name=link.dimension,
            order_by=(order_by or {}).get(link.dimension),
            keep_partitioning=link.left_key == lies_by,
        )
        yield (link, before), fact


def chain_checks(
    fact: DataFrame,
    tables: Mapping[str, DataFrame],
    links: Sequence[Link],
    *,
    metric: str | None = None,
    left_table: str = "fact",
    order_by: Mapping[str, Sequence[str]] | None = None,
) -> DataFrame | None:
    """Diagnostics of every join of a chain, each on the fact as joined until then.

    Only key and metric of the joined fact are read, so joins that do not bring the
    key drop out of the plan.
    """
    rows = [
        join_diagnostics(
            before, tables[link.dimension], link.left_key, link.right_key,
            metric=metric, deduplicated=True, order_by=(order_by or {}).get(link.dimension), left_table=left_table, right_table=link.dimension,
        )
        for (link, before), _ in _joined_so_far(fact, tables, links, order_by)
    ]
    return reduce(DataFrame.unionByName, rows) if rows else None


# ---------------------------------------------------------------------------
# Relationship inference
# ---------------------------------------------------------------------------
def candidate_links(tables: Mapping[str, DataFrame], *, between_dimensions: bool = False) -> list[tuple[str, Link]]:
    """Pairs of tables that share a column named like a key. Reads names only.

    Facts are paired with dimensions; ``between_dimensions`` also pairs dimensions
    with one another, which finds snowflaked ones.
    """
    facts = [t for t in tables if is_fact_name(t)]
    dims = [t for t in tables if t not in facts]
    pairs = [(left, right) for left in facts for right in dims]
    if between_dimensions:
        pairs += [(left, right) for left in dims for right in dims if left != right]
    return [
        (left, Link(key, right, key))
        for left, right in pairs
        for key in sorted(columns_with(tables[left].columns, KEY_NAME_PARTS))
        if key in tables[right].columns
    ]


def link_diagnostics(
    tables: Mapping[str, DataFrame], links: Sequence[tuple[str, Link]], **options
) -> DataFrame | None:
    """Diagnostics of every link, one row each; None if there are no links."""
    rows = [
        join_diagnostics(
            tables[left],
            tables[link.dimension],
            link.left_key,
            link.right_key,
            left_table=left,
            right_table=link.dimension,
            **options,
        )
        for left, link in links
    ]
    return reduce(DataFrame.unionByName, rows) if rows else None


def link_samples(tables: Mapping[str, DataFrame], links: Sequence[tuple[str, Link]], k: int) -> DataFrame | None:
    """Per link, the ``k`` smallest orphan keys and the ``k`` most frequent repeated keys of the dimension.

    Ranked before the shuffle as well, so a task sends ``k`` keys of each kind.
    """
    rows = []
    for left, link in links:
        profile = key_profile(tables[left], tables[link.dimension], link.left_key, link.right_key)
        key = F.coalesce(F.col("left_value").cast(StringType()), F.col("right_value").cast(StringType())).alias("key")
        orphan = F.struct(F.lit("orphan").alias("kind"), F.lit(0).cast("long").alias("weight"), key)
        repeated = F.struct(F.lit("repeated").alias("kind"), (-F.col("right_n")).alias("weight"), key)
        kinds = F.array(
            F.when(F.col("left_value").isNotNull() & F.col("right_value").isNull(), orphan),
            F.when(F.col("right_value").isNotNull() & (F.col("right_n") > 1), repeated),
        )
        found = profile.select(F.explode(F.array_compact(kinds)).alias("s")).select("s.*")
        place = F.row_number().over(Window.partitionBy("kind").orderBy("weight", "key"))
        found = found.withColumn("place", place).where(F.col("place") <= k)

        def keys_of(kind: str) -> Column:
            packed = F.sort_array(F.collect_list(F.when(F.col("kind") == kind, F.struct("place", "key"))))  # noqa: B023
            return F.transform(packed, lambda s: s["key"]).alias(f"{kind}_samples")

        names = {"left_table": left, "right_table": link.dimension, "left_key": link.left_key, "right_key": link.right_key}
        rows.append(found.agg(keys_of("orphan"), keys_of("repeated")).withColumns({c: F.lit(v) for c, v in names.items()}))
    return reduce(DataFrame.unionByName, rows) if rows else None


def infer_relationships(tables: Mapping[str, DataFrame], *, between_dimensions: bool = False) -> DataFrame | None:
    """Relationship records for all candidate links between the tables."""
    found = link_diagnostics(tables, candidate_links(tables, between_dimensions=between_dimensions))
    return None if found is None else relationship(found)


# ---------------------------------------------------------------------------
# Citations
# ---------------------------------------------------------------------------
APPROVED_STATUSES = ("approved", "approved_with_warnings")


def approved_only(results: DataFrame, status_col: str = "validation_status") -> DataFrame:
    return results.where(F.col(status_col).isin(*APPROVED_STATUSES))


def cited_findings(findings: DataFrame, results: DataFrame, *, on: Sequence[str] = ("result_id",)) -> DataFrame:
    """Findings that cite an approved result."""
    return findings.join(approved_only(results).select(*on), list(on), "left_semi")


def with_citation(findings: DataFrame, results: DataFrame, *, on: Sequence[str] = ("result_id",)) -> DataFrame:
    """Findings with ``is_cited``: whether they cite an approved result. One join gives both answers."""
    approved = approved_only(results).select(*on).distinct().withColumn("_approved", F.lit(True))
    return lookup(findings, approved, list(on)).withColumn("is_cited", F.coalesce("_approved", F.lit(False))).drop("_approved")


def uncited_findings(findings: DataFrame, results: DataFrame, *, on: Sequence[str] = ("result_id",)) -> DataFrame:
    """Findings that cite a missing, pending or rejected result."""
    return findings.join(approved_only(results).select(*on), list(on), "left_anti")


def first_per_key(df: DataFrame, keys: Sequence[str], order_by: Sequence[str], k: int) -> DataFrame:
    """The first ``k`` rows per key; ranked before the shuffle as well as after it."""
    order = Window.partitionBy(*keys).orderBy(*[F.col(c) for c in order_by])
    return df.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= k).drop("_rank")
