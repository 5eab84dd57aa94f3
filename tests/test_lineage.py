"""Closures over edges against a plain walk, and what follows from them."""

import random

import pytest

from auditflow.operators import lineage


def plain(edges):
    parents = {}
    for node, parent in edges:
        parents.setdefault(node, set()).add(parent)

    def above(node):
        out = {}
        for parent in parents.get(node, ()):
            for ancestor, steps in [(parent, 0), *above(parent).items()]:
                out[ancestor] = max(out.get(ancestor, 0), steps + 1)
        return out

    return sorted((node, ancestor, steps) for node in parents for ancestor, steps in above(node).items())


@pytest.mark.parametrize("seed", range(3))
def test_closure_of_random_edges(spark, seed):
    pick = random.Random(seed)
    edges = [(f"n{i}", f"n{pick.randrange(i)}") for i in range(1, 25) for _ in range(pick.randrange(3))]
    df = spark.createDataFrame([*edges, *edges[:3], ("n0", None)], "node_id string, parent_id string")
    assert sorted(map(tuple, lineage.closure(df).collect())) == plain(edges)


def test_no_edges_and_cycles(spark):
    assert lineage.closure(spark.createDataFrame([("a", None)], "node_id string, parent_id string")).count() == 0
    with pytest.raises(Exception, match="(?i)recursion"):
        lineage.closure(spark.createDataFrame([("a", "b"), ("b", "a")], "node_id string, parent_id string")).collect()


NODES = [
    ("orders", "raw_table", None, "9"), ("customers", "raw_table", None, "5"), ("TRF_01", "transformation", "orders", "1"),
    ("TRF_JOIN_CUSTOMERS", "join", "TRF_01", "1.0"), ("RES_A", "result", "TRF_JOIN_CUSTOMERS", "approved"), ("RES_B", "result", "TRF_01", "rejected"),
    ("CARD_A", "card", "RES_A", "1"), ("CARD_B", "card", "RES_B", "2"), ("CARD_LOOSE", "card", "RES_GONE", "3"),
]


def test_sources_and_impact(spark):
    nodes = spark.createDataFrame(NODES, "node_id string, kind string, parent_id string, detail string")
    found = {r["node_id"]: (r["steps"], r["raw_tables"]) for r in lineage.raw_sources(nodes).collect()}
    assert found == {
        "TRF_01": (1, ["orders"]), "TRF_JOIN_CUSTOMERS": (2, ["customers", "orders"]), "RES_A": (3, ["customers", "orders"]), "RES_B": (2, ["orders"]),
        "CARD_A": (4, ["customers", "orders"]), "CARD_B": (3, ["orders"]),
    }
    changed = spark.createDataFrame([("customers",)], "table_id string")
    got = sorted((r["cause"], r["cause_kind"], r["node_id"]) for r in lineage.impact(nodes, changed).collect())
    assert got == [("RES_B", "rejected_result", "CARD_B"), ("customers", "changed_table", "CARD_A"), ("customers", "changed_table", "RES_A")]


def test_a_step_goes_with_what_it_needs(spark):
    edges = [("a", None), ("b", "a"), ("c", "b"), ("d", "a"), ("d", "c")]
    dependencies = spark.createDataFrame(edges, "step_id string, depends_on string")
    required = {r["step_id"]: (r["level"], r["required"]) for r in lineage.required_steps(dependencies).collect()}
    assert required == {"a": (0, []), "b": (1, ["a"]), "c": (2, ["a", "b"]), "d": (3, ["a", "b", "c"])}
    steps = [
        ("p", 1, "d", None), ("p", 2, "c", None), ("p", 3, "b", None), ("p", 4, "a", None), ("q", 1, "a", None), ("q", 2, "c", None),
        ("r", 1, "a", None), ("r", 2, "b", "unknown_column"), ("r", 3, "c", None), ("r", 4, "zz", "unregistered_step"),
    ]
    gated = spark.createDataFrame([(*s, s[3] is None) for s in steps], "plan_id string, step_order long, step_id string, rejection string, is_valid boolean")
    got = {(r["plan_id"], r["step_id"]): (r["rejection"], r["lacking"]) for r in lineage.with_dependencies(gated, dependencies).collect() if not r["runs"]}
    assert got == {
        ("q", "c"): ("missing_dependency", "b"), ("r", "b"): ("unknown_column", ""), ("r", "c"): ("missing_dependency", "b"), ("r", "zz"): ("unregistered_step", ""),
    }
