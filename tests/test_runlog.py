import random
from datetime import datetime, timedelta

import pytest

from auditflow.operators import runlog as r

START = datetime(2026, 1, 1)


def _log(spark, events):
    return spark.createDataFrame(
        [(i, run, stage, START + timedelta(seconds=i), reason) for i, run, stage, reason in events],
        "event_id long, run_id string, stage string, created_at timestamp, failure_reason string",
    )


@pytest.mark.parametrize("bucket", [1, 3, 10, 10**6])
def test_previous_stage_across_buckets(spark, bucket):
    """One run holds most of the log."""
    rng = random.Random(bucket)
    stages = list(r.ALLOWED_TRANSITIONS)
    ids = sorted(rng.sample(range(1000), 200))
    events = [(i, "hot" if rng.random() < 0.7 else f"r{rng.randrange(5)}", rng.choice([*stages, None]), None) for i in ids]
    last, expected = {}, []
    for i, run, stage, _ in events:
        if last.get(run) is not None:
            expected.append((run, i, last[run], stage))
        last[run] = stage
    found = r.transitions(_log(spark, events).repartition(4), bucket=bucket).collect()
    assert sorted(map(tuple, found), key=repr) == sorted(expected, key=repr)


def test_allowed_table():
    assert len(r.ALLOWED_TRANSITIONS) == 13
    assert all(t in r.ALLOWED_TRANSITIONS for targets in r.ALLOWED_TRANSITIONS.values() for t in targets)


def test_violations(spark, rows):
    good = ["UPLOADED", "PROFILED", "PLAN_READY", "PREPARING", "ANALYZING", "VALIDATING", "VALIDATED", "BUILDING_DASHBOARD", "READY"]
    events = [(i, "good", s, None) for i, s in enumerate(good)]
    events += [(100, "bad", "UPLOADED", None), (101, "bad", "READY", None), (102, "bad", "PREPARING", None)]
    events += [(200, "odd", "CANCELLED", None), (201, "odd", "READY", None), (202, "odd", "SOMETHING", None), (203, "odd", "PREPARING", None)]
    assert rows(r.transition_violations(_log(spark, events)), "run_id", "from_stage", "to_stage") == [
        ("bad", "UPLOADED", "READY"), ("odd", "CANCELLED", "READY"), ("odd", "READY", "SOMETHING"), ("odd", "SOMETHING", "PREPARING"),
    ]


def test_status(spark):
    events = [
        (1, "a", "UPLOADED", None), (2, "a", "NEEDS_REPAIR", None), (3, "a", "FAILED", "no files"),
        (4, "b", "UPLOADED", None), (5, "b", "FAILED", " "),
        (6, "c", "UPLOADED", None), (7, "c", "NEEDS_REPAIR", "x"), (8, "c", "NEEDS_REPAIR", None),
        (9, "d", "READY", None), (11, "d", "PREPARING", None),
    ]
    found = {x.run_id: x for x in r.run_status(_log(spark, events)).collect()}
    assert (found["a"].status, found["a"].failure_reason, found["a"].repair_attempts, found["a"].duration_seconds) == ("FAILED", "no files", 1, 2.0)
    assert (found["c"].status, found["c"].failure_reason, found["c"].repair_attempts, found["c"].completed_at) == ("RUNNING", None, 2, None)
    # a rerun keeps the time at which it was last ready
    assert (found["d"].status, found["d"].completed_at) == ("RUNNING", START + timedelta(seconds=9))
    status = r.run_status(_log(spark, events))
    assert [x.run_id for x in r.misleading_failures(status).collect()] == ["b"]


def test_call_log(spark):
    calls = spark.createDataFrame(
        [("agent", "success", 10, 1, 100), ("agent", "success", None, 2, 300), ("agent", "error", 5, 0, 50)],
        "caller_agent string, status string, input_tokens long, output_tokens long, duration_ms long",
    )
    found = {x.status: x for x in r.call_log_rollup(calls).collect()}
    assert (found["success"].calls, found["success"].input_tokens, found["success"].output_tokens, found["success"].max_duration) == (2, 10, 3, 300)
    assert found["success"].p95_duration == 300


def test_percentiles_are_exact_at_any_size(spark):
    n = 200_001
    calls = spark.range(n).selectExpr("'a' AS caller_agent", "CAST(NULL AS STRING) AS status", "1L AS input_tokens", "1L AS output_tokens", "id * 7919 % 200003 * 13 AS duration_ms")
    row = r.call_log_rollup(calls).first()
    durations = sorted(i * 7919 % 200003 * 13 for i in range(n))
    assert (row.calls, row.p50_duration, row.p95_duration) == (n, durations[-(-n // 2) - 1], durations[-(-n * 95 // 100) - 1])


def test_events_without_a_run_are_steps_of_one(spark, rows):
    events = [(1, None, "UPLOADED", None), (2, None, "READY", None)]
    assert rows(r.transition_violations(_log(spark, events)), "from_stage", "to_stage") == [("UPLOADED", "READY")]
