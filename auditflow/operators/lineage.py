"""What lies above and below a node: closures over edges, and what follows from them.

Edges of one run, or of a registry, are few; they are stored once and closed by a recursive query.
Whatever grows with the data is joined to the closure afterwards.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from auditflow.session import durable


def closure(edges: DataFrame, *, node: str = "node_id", parent: str = "parent_id") -> DataFrame:
    """(node, ancestor, distance) of every node and all that is above it; the distance is the longest way.

    Edges without a parent say nothing. A cycle is an error, since its recursion doesn't end.
    """
    pairs = durable(edges.select(F.col(node).alias("node"), F.col(parent).alias("parent")).where("parent is not null").distinct())
    return edges.sparkSession.sql(
        """
        WITH RECURSIVE above(node, ancestor, distance) AS (
          SELECT node, parent, 1 FROM {pairs}
          UNION ALL
          SELECT above.node, p.parent, above.distance + 1 FROM above JOIN {pairs} p ON p.node = above.ancestor
        )
        SELECT node, ancestor, max(distance) AS distance FROM above GROUP BY node, ancestor
        """,
        pairs=pairs,
    )


# ---------------------------------------------------------------------------
# Provenance
# ---------------------------------------------------------------------------
def provenance_edges(nodes: DataFrame) -> DataFrame:
    """(node_id, parent_id) of provenance nodes, and of each join the dimension it brings in."""
    tables = nodes.where("kind = 'raw_table'").select(F.col("node_id").alias("parent_id"))
    joins = nodes.where("kind = 'join'").select("node_id")
    brought = joins.join(tables, F.col("node_id") == F.concat(F.lit("TRF_JOIN_"), F.upper("parent_id")))
    return nodes.where("parent_id is not null").select("node_id", "parent_id").unionByName(brought)


def raw_sources(nodes: DataFrame) -> DataFrame:
    """node_id, kind, steps and raw_tables (sorted names) of every node that is made from raw tables.

    ``steps`` is the longest way up to one of them.
    """
    above = closure(provenance_edges(nodes))
    raw = nodes.where("kind = 'raw_table'").select(F.col("node_id").alias("ancestor"))
    found = above.join(raw, "ancestor").groupBy(F.col("node").alias("node_id")).agg(
        F.max("distance").cast("long").alias("steps"), F.array_sort(F.collect_set("ancestor")).alias("raw_tables")
    )
    return found.join(nodes.select("node_id", "kind"), "node_id")


def impact(nodes: DataFrame, changed: DataFrame) -> DataFrame:
    """cause, cause_kind, node_id and kind: the results and cards that a cause below makes invalid.

    A cause is a rejected result, or a raw table named in ``changed`` (table_id). A rejected result
    is not its own effect.
    """
    rejected = nodes.where("kind = 'result' and detail = 'rejected'").select(F.col("node_id").alias("cause"), F.lit("rejected_result").alias("cause_kind"))
    altered = changed.select(F.col("table_id").alias("cause"), F.lit("changed_table").alias("cause_kind"))
    causes = rejected.unionByName(altered)
    shown = nodes.where(F.col("kind").isin("result", "card")).select("node_id", "kind")
    below = closure(provenance_edges(nodes)).select(F.col("node").alias("node_id"), F.col("ancestor").alias("cause"))
    return below.join(causes, "cause").join(shown, "node_id").select("cause", "cause_kind", "node_id", "kind")


# ---------------------------------------------------------------------------
# Plans
# ---------------------------------------------------------------------------
def required_steps(dependencies: DataFrame) -> DataFrame:
    """step_id, level and required (all steps it needs, directly or not) from edges (step_id, depends_on).

    Level 0 needs nothing; every other step is one above the highest that it needs.
    """
    above = closure(dependencies, node="step_id", parent="depends_on")
    needed = above.groupBy(F.col("node").alias("step_id")).agg(F.max("distance").cast("long").alias("level"), F.array_sort(F.collect_set("ancestor")).alias("required"))
    steps = dependencies.select("step_id").unionByName(dependencies.where("depends_on is not null").select(F.col("depends_on").alias("step_id"))).distinct()
    return steps.join(needed, "step_id", "left").select(
        "step_id", F.coalesce("level", F.lit(0).cast("long")).alias("level"), F.coalesce("required", F.array().cast("array<string>")).alias("required")
    )


def with_dependencies(gated: DataFrame, dependencies: DataFrame, *, plan: Sequence[str] = ("plan_id",), step_key: str = "step_order") -> DataFrame:
    """Gated steps with their level, and with ``missing_dependency`` where a step they need is absent or rejected.

    ``gated`` is the output of ``validate.plan_gate``. A step may run if it is valid and every step it
    needs, directly or not, stands in its plan as a valid one; so the loss of a step takes all
    that builds on it. Running steps by ``level`` is a topological order. Per plan only the set of
    its valid step ids is kept, which the registry bounds.
    """
    required = F.broadcast(required_steps(dependencies))  # one row per registered step
    valid = gated.where("is_valid").groupBy(*plan).agg(F.collect_set("step_id").alias("present"))
    known = gated.join(required, "step_id", "left").join(valid, list(plan), "left")
    empty = F.array().cast("array<string>")
    lacking: Column = F.array_except(F.coalesce("required", empty), F.coalesce("present", empty))
    rejection = F.coalesce("rejection", F.when(F.size(lacking) > 0, F.lit("missing_dependency")))
    return known.select(
        *plan, step_key, "step_id", F.coalesce("level", F.lit(0).cast("long")).alias("level"), rejection.alias("rejection"),
        F.array_join(F.array_sort(lacking), ",").alias("lacking"),
    ).withColumn("runs", F.col("rejection").isNull())
