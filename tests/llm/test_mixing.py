import math

import pytest
from pyspark.sql import functions as F

from auditflow.llm.mixing import OTHER, mix, poisson_count, repetitions, uniform


@pytest.mark.parametrize("mean", [0.0, 0.3, 1.0, 7.5, 400.0])
def test_counts_follow_the_distribution(spark, mean):
    n = 20_000
    df = spark.range(n).select(poisson_count(uniform(1, F.col("id")), F.lit(mean), mean).alias("k"))
    average, spread = df.agg(F.avg("k"), F.var_samp("k")).first()
    assert abs(average - mean) <= 5 * math.sqrt(mean / n) + 1e-9 and abs(spread - mean) <= 0.1 * mean + 1e-9
    if mean == 1.0:
        share = df.where("k = 0").count() / n
        assert abs(share - math.exp(-1)) < 0.02


def test_shares_reach_the_weights(spark):
    docs = spark.range(30_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, "big").otherwise(F.concat(F.lit("s"), F.col("id") % 5)).alias("source"), F.lit("0123456789").alias("text"))
    got = mix(docs, {"big": 0.2, "s1": 0.3, OTHER: 0.5}, seed=5)
    shares = {r["s"]: r["count"] for r in got.select(F.when(F.col("source").isin("big", "s1"), F.col("source")).otherwise("rest").alias("s")).groupBy("s").count().collect()}
    total = sum(shares.values())
    assert abs(total / 30_000 - 1) < 0.03
    for source, weight in (("big", 0.2), ("s1", 0.3), ("rest", 0.5)):
        assert abs(shares[source] / total - weight) < 0.02
    again = mix(docs, {"big": 0.2, "s1": 0.3, OTHER: 0.5}, seed=5)
    assert again.exceptAll(got).isEmpty() and got.select("doc_id", "copy").distinct().count() == got.count()


def test_awkward_rows(awkward, no_rows):
    weights = {"src0": 1.0, OTHER: 1.0}
    got = mix(awkward, weights, unit="rows", total=200)
    assert {r["doc_id"] for r in got.select("doc_id").collect()} >= {1, 4, 5, 7}  # null and empty texts are drawn by rows
    assert set(awkward.columns) <= set(got.columns) and got.select("copy").distinct().count() > 5
    assert mix(no_rows, weights).count() == 0
    assert mix(awkward, {"src0": 1.0}, unit="rows").where("source <> 'src0' or source is null").count() == 0


def test_only_spark_functions(awkward):
    plan = mix(awkward, {"src0": 1.0, OTHER: 1.0})._jdf.queryExecution().executedPlan().toString()
    assert not any(w in plan for w in ("Python", "Arrow", "Pandas", "BroadcastNestedLoop"))


def test_large_means_are_sums_of_draws(spark):
    n, mean = 500, 1234.5
    df = spark.range(n).select(repetitions(F.lit(mean), 1, F.col("id")).alias("k"))
    average, spread = df.agg(F.avg("k"), F.var_samp("k")).first()
    assert abs(average - mean) <= 5 * math.sqrt(mean / n) and abs(spread - mean) <= 0.25 * mean
    # Where one draw is enough, another source's large rate changes nothing.
    some = spark.range(100).select(repetitions(F.lit(3.0), 1, F.col("id")).alias("a"), poisson_count(uniform(1, F.col("id")), F.lit(3.0), 3.0).alias("b"))
    assert some.where("a != b").isEmpty()


def test_a_rare_source_reaches_its_weight(spark):
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.when(F.col("id") == 7, "rare").otherwise("big").alias("source"), F.lit("0123456789").alias("text"))
    got = mix(docs, {"rare": 0.5, OTHER: 0.5}, total=240_000.0).cache()
    counts = {r["source"]: r["count"] for r in got.groupBy("source").count().collect()}
    assert abs(counts["rare"] - 12_000) < 600 and abs(counts["big"] - 12_000) < 600
    rare = got.where("source = 'rare'")
    assert rare.agg(F.min("copy"), F.max("copy"), F.count_distinct("copy")).first() == (0, counts["rare"] - 1, counts["rare"])
    assert dict(got.dtypes)["copy"] == "int"


def test_a_source_without_characters_is_mixed_by_rows(spark):
    docs = spark.range(4_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.col("id") % 4).alias("source"), F.when(F.col("id") % 4 == 1, "").when(F.col("id") % 4 > 1, "0123456789").alias("text"))
    got = {r["source"]: r["count"] for r in mix(docs, {"s0": 0.25, "s1": 0.25, OTHER: 0.5}).groupBy("source").count().collect()}
    assert abs(got["s0"] - 1_000) < 150 and abs(got["s1"] - 1_000) < 150
