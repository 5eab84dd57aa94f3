import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from auditflow.operators import joins
from auditflow.operators.joins import Link

FACT = [("O1", "C1", Decimal(100)), ("O2", "C2", Decimal(200))]
DIM = [("C1", "first"), ("C1", "second"), ("C2", "only")]


@pytest.fixture(scope="module")
def fact(spark):
    return spark.createDataFrame(FACT, "order_id string, customer_id string, net_sales decimal(18,4)")


@pytest.fixture(scope="module")
def dim(spark):
    return spark.createDataFrame(DIM, "customer_id string, name string")


def test_inflation_is_seen_without_joining(fact, dim):
    naive = joins.join_diagnostics(fact, dim, "customer_id", metric="net_sales").first()
    assert (naive.result_rows, naive.metric_after, naive.multiplication_factor) == (3, 400, 1.5)
    assert naive.cardinality == "many_to_many" and naive.risk_level == "high" and not naive.is_safe
    assert naive.warning
    safe = joins.join_diagnostics(fact, dim, "customer_id", metric="net_sales", deduplicated=True).first()
    assert (safe.result_rows, safe.metric_after, safe.multiplication_factor) == (2, 300, 1.0)
    assert safe.is_safe and safe.warning is None


def test_safe_join_keeps_rows(fact, dim, rows):
    first = joins.safe_left_join(fact, dim, "customer_id")
    assert rows(first, "order_id", "name") == [("O1", "first"), ("O2", "only")]
    latest = joins.safe_left_join(fact, dim, "customer_id", order_by=["name"], keep="latest")
    assert rows(latest, "order_id", "name") == [("O1", "second"), ("O2", "only")]


def test_unused_dimension_join_disappears(fact, dim):
    plan = joins.safe_left_join(fact, dim, "customer_id").select("order_id")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_null_and_blank_keys(spark, rows):
    fact = spark.createDataFrame([(1, None), (2, ""), (3, "a"), (4, "x")], "id int, k string")
    dim = spark.createDataFrame([(None, "null row"), ("a", "A"), ("b", "B")], "k string, v string")
    found = joins.join_diagnostics(fact, dim, "k").first()
    assert (found.left_keyed_rows, found.null_keys_left, found.blank_keys_left) == (3, 1, 1)
    assert (found.orphans_left, found.orphans_right, found.right_keys, found.right_rows) == (2, 1, 2, 3)
    assert (found.match_rate_left, found.match_rate_right) == (33.33, 50.0)
    assert joins.join_diagnostics(fact, dim, "k", blank_is_orphan=False).first().orphans_left == 1
    assert rows(joins.orphan_keys(fact, dim, "k")) == [("", 1), ("x", 1)]
    assert rows(joins.unused_keys(fact, dim, "k")) == [("b",)]
    assert rows(joins.safe_left_join(fact, dim, "k"), "id", "v") == [(1, None), (2, None), (3, "A"), (4, None)]
    assert rows(joins.safe_left_join(fact, dim, "k", null_safe=True), "id", "v")[0] == (1, "null row")


def test_empty_tables(spark, fact, dim):
    empty_fact, empty_dim = fact.limit(0), dim.limit(0)
    no_fact = joins.join_diagnostics(empty_fact, dim, "customer_id", metric="net_sales").first()
    assert (no_fact.left_rows, no_fact.result_rows, no_fact.orphans_right) == (0, 0, 2)
    no_dim = joins.join_diagnostics(fact, empty_dim, "customer_id").first()
    assert (no_dim.result_rows, no_dim.orphans_left, no_dim.multiplication_factor) == (2, 2, 1.0)


def test_overlaps_and_chain(spark, rows):
    fact = spark.createDataFrame([(1, "p1", "n1"), (2, "p9", None)], "order_id int, product_id string, name string")
    products = spark.createDataFrame([("p1", "c1", "Chair")], "product_id string, category_id string, name string")
    categories = spark.createDataFrame([("c1", "Furniture")], "category_id string, category_name string")
    tables = {"products": products, "categories": categories}
    links = [Link("product_id", "products", "product_id"), Link("category_id", "categories", "category_id"), Link("x_id", "none", "x_id")]
    joined = joins.join_chain(fact, tables, links)
    assert set(joined.columns) == {"order_id", "product_id", "name", "category_id", "products_name", "category_name"}
    assert rows(joined, "order_id", "products_name", "category_name") == [(1, "Chair", "Furniture"), (2, None, None)]
    snowflake = joins.candidate_links({"orders": fact, **tables}, between_dimensions=True)
    assert ("products", Link("category_id", "categories", "category_id")) in snowflake


def test_different_key_names_keep_both_columns(spark):
    fact = spark.createDataFrame([("a",)], "ref string")
    dim = spark.createDataFrame([("a", 1)], "id string, v int")
    for salt_over in (None, 0):
        row = joins.safe_left_join(fact, dim, "ref", "id", salt_over=salt_over).first().asDict()
        assert row == {"ref": "a", "id": "a", "v": 1}


def test_salted_join_equals_plain_join_under_skew(spark, rows):
    """One key holds a third of the fact, null keys another part."""
    rng = random.Random(7)
    keys = ["hot"] * 700 + [None] * 200 + [f"k{rng.randrange(300)}" for _ in range(1200)]
    fact = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "id int, k string").repartition(5)
    dim = spark.createDataFrame(
        [("hot", 0), ("hot", 1)] + [(f"k{i}", v) for i in range(250) for v in range(1 + i % 3)], "k string, v int"
    )
    plain = joins.safe_left_join(fact, dim, "k")
    salted = joins.safe_left_join(fact, dim, "k", salt_over=100)
    assert rows(salted, "id", "k", "v") == rows(plain, "id", "k", "v")
    assert salted.count() == len(keys)


def test_diagnostics_agree_with_brute_force(spark):
    rng = random.Random(3)
    left = [(i, rng.choice([None, "", "a", "b", "c", "d"]), Decimal(rng.randrange(1000)) / 4) for i in range(400)]
    right = [(rng.choice([None, "a", "b", "b", "e"]), i) for i in range(60)]
    fact = spark.createDataFrame(left, "id int, k string, net_sales decimal(18,4)")
    dim = spark.createDataFrame(right, "k string, v int")
    found = joins.join_diagnostics(fact, dim, "k", metric="net_sales").first()
    joined = [(l, r) for l in left for r in right if l[1] is not None and l[1] == r[0]]
    matched = {l[0] for l, _ in joined}
    assert found.result_rows == len(joined) + len(left) - len(matched)
    assert found.metric_after == sum(l[2] for l, _ in joined) + sum(l[2] for l in left if l[0] not in matched)
    assert found.orphans_left == sum(1 for l in left if l[1] is not None and l[0] not in matched)


def test_relationships(spark, rows):
    tables = {
        "orders": spark.createDataFrame([(1, "c1"), (2, "c9")], "order_id int, customer_id string"),
        "customers": spark.createDataFrame([("c1", 1), ("c2", 2)], "customer_id string, segment int"),
    }
    found = joins.infer_relationships(tables).first()
    assert (found.id, found.cardinality, found.risk_level) == ("REL_orders_customers_customer_id", "many_to_one", "medium")
    assert joins.infer_relationships({"orders": tables["orders"]}) is None


def test_citations(spark, rows):
    results = spark.createDataFrame([("R1", "approved"), ("R2", "rejected"), ("R3", "pending")], "result_id string, validation_status string")
    found = spark.createDataFrame([("a", "R1"), ("b", "R2"), ("c", "R3"), ("d", "R4")], "id string, result_id string")
    assert rows(joins.cited_findings(found, results), "id") == [("a",)]
    assert rows(joins.uncited_findings(found, results), "id") == [("b",), ("c",), ("d",)]


def test_first_per_key(spark, rows):
    df = spark.createDataFrame([("a", i) for i in range(10)] + [("b", 1)], "k string, v int")
    assert rows(joins.first_per_key(df, ["k"], ["v"], 2)) == [("a", 0), ("a", 1), ("b", 1)]
    plan = joins.first_per_key(df, ["k"], ["v"], 2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


@pytest.fixture
def large_table_settings(spark):
    """Settings under which small tables are joined the way large ones are."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_adaptive_execution_can_split_a_hot_key(spark, large_table_settings):
    """A key with a third of the fact does not stay in one task of a safe join."""
    key = F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), (F.col("id") % 997).cast("string")))
    fact = spark.range(0, 60000, 1, 8).select("id", key.alias("k"), F.xxhash64("id").alias("payload"))
    dim = spark.range(1500).select(
        F.when(F.col("id") < 2, F.lit("hot")).otherwise(F.concat(F.lit("k"), (F.col("id") % 900).cast("string"))).alias("k"),
        F.col("id").alias("v"),
    )
    joined = joins.safe_left_join(fact, dim, "k")
    found = joined.select("id", "payload", "v").collect()
    assert len(found) == 60000 and sum(r.v is None for r in found) == fact.join(dim, "k", "left_anti").count()
    plan = joined.select("id", "payload", "v")
    plan.collect()
    assert "SortMergeJoin(skew=true)" in plan._jdf.queryExecution().executedPlan().toString()


def test_a_fact_bucketed_by_the_key_is_not_shuffled(spark, sf_dir):
    """Neither by the first join nor by the second; the result is that of any other join."""
    from auditflow.plans import views

    facts = views.dirty_orders(spark, sf_dir)
    tables = {"customers": views.dirty_customers(spark, sf_dir), "others": views.dirty_customers(spark, sf_dir)}
    links = [joins.Link("customer_id", "customers", "customer_id"), joins.Link("customer_id", "others", "customer_id")]
    name, limit = "facts_by_customer", spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    facts.write.bucketBy(8, "customer_id").mode("overwrite").saveAsTable(name)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        stored = spark.table(name)
        plans = {}
        for lies_by in (None, "customer_id"):
            joined = joins.join_chain(stored, tables, links, lies_by=lies_by)
            plans[lies_by] = joined._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
            assert joined.count() == facts.count()
        # One exchange of each dimension, for its own grouping.
        assert plans["customer_id"].count("Exchange") == 2 < plans[None].count("Exchange")
        ours, plain = (sorted(map(tuple, df.collect()), key=repr) for df in (joined, joins.join_chain(facts, tables, links)))
        assert ours == plain
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        spark.sql(f"DROP TABLE IF EXISTS {name}")
