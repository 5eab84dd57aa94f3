"""Run logs as they arrive: transitions checked against the last stage of each run, events stored once."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

from pyspark.sql import DataFrame, Row, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from auditflow.operators.runlog import ALLOWED_TRANSITIONS, TERMINAL_STAGES
from auditflow.session import ship_package

STATE_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
FOUND = "run_id string, event_id long, from_stage string, to_stage string, kind string"
VIOLATION, LATE, STALLED = "violation", "late", "stalled"


class _LastStage(StatefulProcessor):
    """Per run: the last event and its stage, and a timer for a run that doesn't go on."""

    def __init__(self, allowed: Mapping[str, Sequence[str]], terminal: Sequence[str], stall_ms: int):
        self.allowed, self.terminal, self.stall_ms = {s: tuple(t) for s, t in allowed.items()}, tuple(terminal), stall_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "event_id long, stage string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        before = self.last.get()
        # Of a batch only identifiers, stages and times are held, to be put in order.
        events = sorted((r["event_id"], r["stage"], r["ms"]) for r in rows)
        stage_before, id_before, ms = (before[1], before[0], 0) if before is not None else (None, None, 0)
        for event_id, stage, at in events:
            ms = max(ms, at or 0)
            if id_before is not None and event_id <= id_before:
                yield Row(run_id=key[0], event_id=event_id, from_stage=stage_before, to_stage=stage, kind=LATE)
                continue
            if stage_before is not None and stage not in self.allowed.get(stage_before, ()):
                yield Row(run_id=key[0], event_id=event_id, from_stage=stage_before, to_stage=stage, kind=VIOLATION)
            id_before, stage_before = event_id, stage
        self.last.update((id_before, stage_before))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if stage_before not in self.terminal and self.stall_ms:
            self.handle.registerTimer(ms + self.stall_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        event_id, stage = self.last.get()
        yield Row(run_id=key[0], event_id=event_id, from_stage=stage, to_stage=None, kind=STALLED)

    def close(self) -> None:
        pass


def watch_transitions(
    stream: DataFrame, *, allowed: Mapping[str, Sequence[str]] = ALLOWED_TRANSITIONS, terminal: Sequence[str] = TERMINAL_STAGES,
    delay: str = "1 hour", stall_after_seconds: int = 86_400,
) -> DataFrame:
    """(run_id, event_id, from_stage, to_stage, kind) as events (run_id, event_id, stage, created_at) arrive.

    ``violation``: a step that is not allowed from the stage before it, as in
    ``runlog.transition_violations``. ``late``: an event older than one of its run that was
    judged in an earlier batch; it is reported, not judged. ``stalled``: a run without a terminal
    stage had no event for ``stall_after_seconds`` of event time behind the watermark.

    Events of a batch are put in order by event_id, so together small batches in order give the rows
    of one large batch. State is one event per run. The state store must be RocksDB
    (``STATE_PROVIDER``), set in the session before the stream starts. Events without a run are left out.
    """
    ship_package(stream.sparkSession)
    events = stream.where("run_id is not null").select("run_id", "event_id", "stage", "created_at", F.unix_millis("created_at").alias("ms"))
    return events.withWatermark("created_at", delay).groupBy("run_id").transformWithState(
        _LastStage(allowed, terminal, stall_after_seconds * 1000), FOUND, "append", "EventTime"
    )


def store_events(stream: DataFrame, path: str, checkpoint: str, *, delay: str = "1 day", available_now: bool = False) -> StreamingQuery:
    """Store arriving events exactly once in Parquet files, by day.

    An event delivered again within ``delay`` of event time is dropped by its event_id; state is one
    identifier per event of that time. The file sink commits a batch as a whole, so a restart neither
    loses nor repeats one. Read back with ``store.run_events``, which puts a run in order.
    """
    once = stream.withWatermark("created_at", delay).dropDuplicatesWithinWatermark(["event_id"])
    writer = once.withColumn("day", F.to_date("created_at")).writeStream.format("parquet").partitionBy("day")
    writer = writer.option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer).start(path)
