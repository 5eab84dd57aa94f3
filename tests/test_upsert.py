"""Artifacts as base and delta equal those over the whole history."""

import uuid

import pytest
from pyspark.sql import functions as F

from auditflow.plans import views
from auditflow.records import ARTIFACT
from auditflow.sources import store


@pytest.fixture
def named(spark):
    made = []

    def name():
        made.append(f"artifacts_{uuid.uuid4().hex}")
        return made[-1]

    yield name
    for table in made:
        spark.sql(f"DROP TABLE IF EXISTS {table}")


def everything(df):
    return sorted(map(tuple, df.select(ARTIFACT.names).collect()), key=repr)


def test_base_and_deltas_equal_the_history(spark, sf_dir, tmp_path, named):
    saved = views.event_artifacts(spark, sf_dir).withColumn("part", F.crc32(F.concat("artifact_id", "data_json")) % 3)
    parts = [saved.where(F.col("part") == i).drop("part") for i in range(3)]
    base, later, delta, rest = named(), named(), str(tmp_path / "delta"), str(tmp_path / "rest")
    store.write_base(parts[0], base, buckets=4)
    assert everything(store.merged_artifacts(spark, base, None)) == everything(store.current_artifacts(parts[0]))
    store.append_delta(parts[1], delta)
    merged = store.merged_artifacts(spark, base, delta)
    assert everything(merged) == everything(store.current_artifacts(parts[0].unionByName(parts[1])))
    store.compact(spark, base, delta, later, buckets=4)
    assert everything(spark.table(later)) == everything(merged)
    store.append_delta(parts[2], rest)
    store.append_delta(parts[2].limit(3), rest)  # saved twice
    again = store.merged_artifacts(spark, later, rest)
    assert everything(again) == everything(store.current_artifacts(saved.drop("part")))
    assert everything(store.latest_artifacts(again).select(ARTIFACT.names)) == everything(store.latest_artifacts(saved.drop("part")).select(ARTIFACT.names))


def test_the_base_is_not_shuffled(spark, sf_dir, tmp_path, named):
    base, delta = named(), str(tmp_path / "delta")
    saved = views.event_artifacts(spark, sf_dir)
    store.write_base(saved, base, buckets=4)
    store.append_delta(saved.limit(50), delta)
    merged = store.merged_artifacts(spark, base, delta)
    merged.collect()
    plan = merged._jdf.queryExecution().executedPlan().toString()
    initial = plan.split("== Initial Plan ==")[-1]
    lines = initial.splitlines()
    at = next(i for i, line in enumerate(lines) if base in line and "FileScan" in line)
    depth = len(lines[at]) - len(lines[at].lstrip(" :+-"))
    above = []
    for line in reversed(lines[:at]):  # the path from the scan of the base up to the join
        here = len(line) - len(line.lstrip(" :+-"))
        if here < depth:
            above.append(line)
            depth = here
        if "SortMergeJoin" in line:
            break
    assert "Bucketed: true" in lines[at] and above and not any("Exchange" in line for line in above)


def test_ties_and_missing_sides(spark, tmp_path, named):
    rows = [("a", "r", "t", "1", None), ("a", "r", "t", "2", None), ("b", "r", "t", "1", None)]
    schema = "artifact_id string, run_id string, artifact_type string, data_json string, created_at timestamp"
    base, delta = named(), str(tmp_path / "d")
    store.write_base(spark.createDataFrame(rows[:1] + rows[2:], schema), base, buckets=2)
    store.append_delta(spark.createDataFrame([rows[1], ("c", None, None, None, None)], schema), delta)
    got = {r["artifact_id"]: r["data_json"] for r in store.merged_artifacts(spark, base, delta).collect()}
    assert got == {"a": "2", "b": "1", "c": None}
