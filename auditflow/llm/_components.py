"""Connected components of a large graph of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from auditflow.llm._store import keep


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (u, v longs); component is the least node reachable.

    Rounds of two steps: every node ties its larger neighbours, then its smaller ones, to the least
    node it knows. The number of rounds grows with the logarithm of the largest component. All that
    is kept of a round is a table of links in the shared folder, one per node at the end, and no
    step gathers the neighbours of a node.
    """
    links = keep(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    seen = None
    while True:
        both = keep(links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))), "links-both")
        least = keep(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), "links-least")
        up = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        up = keep(up.distinct(), "links-up")
        least = keep(up.groupBy("u").agg(F.min("v").alias("m")), "links-least")
        down = up.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = keep(down.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "links")
        state = links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == seen:
            break
        seen = state
    roots = links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return roots.unionByName(roots.select(F.col("component").alias("node"), "component").distinct())
