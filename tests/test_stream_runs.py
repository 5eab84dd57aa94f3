"""Streams of run events give what the batch operators give."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from auditflow.operators import runlog
from auditflow.plans import views
from auditflow.plans.queries import EVENT_TRANSITIONS
from auditflow.streaming import runs

SCHEMA = "event_id long, run_id string, stage string, created_at timestamp"


@pytest.fixture
def rocksdb(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, runs.STATE_PROVIDER)
    yield
    spark.conf.set(name, before) if before else spark.conf.unset(name)


def landed(spark, folder, batches):
    """Batches as files in order of their names."""
    for i, rows in enumerate(batches):
        df = rows if hasattr(rows, "schema") else spark.createDataFrame(rows, SCHEMA)
        df.select("event_id", "run_id", "stage", "created_at").coalesce(1).write.parquet(f"{folder}/b{i:03}")
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")


def watched(spark, tmp_path, stream, **options):
    query = (
        runs.watch_transitions(stream, **options).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ck"))
        .outputMode("append").trigger(availableNow=True).start(str(tmp_path / "out"))
    )
    query.awaitTermination(240)
    assert query.exception() is None
    return spark.read.schema(runs.FOUND).parquet(str(tmp_path / "out"))


def test_small_batches_give_the_violations_of_all_events(spark, sf_dir, tmp_path, rocksdb):
    log = views.run_log(spark, sf_dir)
    top = log.agg(F.max("event_id")).first()[0] + 1
    step = -(-top // 3)
    stream = landed(spark, str(tmp_path / "in"), [log.where((F.col("event_id") >= a) & (F.col("event_id") < a + step)) for a in range(0, top, step)])
    found = watched(spark, tmp_path, stream, allowed=EVENT_TRANSITIONS, terminal=(), stall_after_seconds=0)
    expected = runlog.transition_violations(log, allowed=EVENT_TRANSITIONS).select("run_id", "event_id", "from_stage", "to_stage")
    got = found.where("kind = 'violation'").select("run_id", "event_id", "from_stage", "to_stage")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, expected.collect())) and got.count() > 10
    assert found.where("kind != 'violation'").count() == 0


def test_late_events_and_stalled_runs(spark, tmp_path, rocksdb):
    at = datetime(2026, 1, 1)
    batches = [
        [(5, "a", "UPLOADED", at), (6, "a", "READY", at), (7, "b", "UPLOADED", at), (8, "c", "READY", at), (9, None, "READY", at)],
        [(4, "a", "PROFILED", at), (10, "b", "PROFILED", at + timedelta(hours=1))],
        [(11, "d", "UPLOADED", at + timedelta(days=9))],
        [(12, "d", "PROFILED", at + timedelta(days=9, hours=1))],
    ]
    found = watched(spark, tmp_path, landed(spark, str(tmp_path / "in"), batches))
    assert sorted(map(tuple, found.collect())) == [
        ("a", 4, "READY", "PROFILED", "late"), ("a", 6, "UPLOADED", "READY", "violation"), ("b", 10, "PROFILED", None, "stalled"),
    ]


def test_a_batch_delivered_twice_is_stored_once(spark, sf_dir, tmp_path, rocksdb):
    log = views.run_log(spark, sf_dir).select("event_id", "run_id", "stage", "created_at")
    middle = log.agg(F.expr("percentile_approx(event_id, 0.5)")).first()[0]
    halves = [log.where(F.col("event_id") <= middle), log.where(F.col("event_id") > middle)]
    stream = landed(spark, str(tmp_path / "in"), [halves[0], halves[0], halves[1], halves[1]])
    query = runs.store_events(stream, str(tmp_path / "out"), str(tmp_path / "ck"), delay="3650 days", available_now=True)
    query.awaitTermination(240)
    assert query.exception() is None
    stored = spark.read.parquet(str(tmp_path / "out")).drop("day")
    assert sorted(map(tuple, stored.select(log.columns).collect())) == sorted(map(tuple, log.collect()))
    # A restart with the same checkpoint adds nothing.
    runs.store_events(stream, str(tmp_path / "out"), str(tmp_path / "ck"), delay="3650 days", available_now=True).awaitTermination(240)
    assert spark.read.parquet(str(tmp_path / "out")).count() == stored.count()
