"""Stores of prepared facts, artifacts and run events, and the reads over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from auditflow.functions.parsing import month_key
from auditflow.operators.ledger import CLEAN_DATE
from auditflow.records import ARTIFACT, RUN_EVENT, conform

PERIOD = "period"


def write_by_month(fact: DataFrame, path: str, *, date_col: str = CLEAN_DATE) -> None:
    """Write a prepared fact with one folder per month.

    Rows are rebalanced by month first: small months do not leave many small files,
    and a month that holds much of the table is still written by several tasks.
    """
    keyed = fact.withColumn(PERIOD, month_key(F.col(date_col)))
    keyed.hint("rebalance", PERIOD).write.mode("overwrite").partitionBy(PERIOD).parquet(path)


def read_months(spark: SparkSession, path: str, first: str | None = None, last: str | None = None) -> DataFrame:
    """A fact written by month; folders outside ``first`` to ``last`` are not read."""
    stored = spark.read.parquet(path).withColumn(PERIOD, F.col(PERIOD).cast("string"))
    if first is not None:
        stored = stored.where(F.col(PERIOD) >= first)
    if last is not None:
        stored = stored.where(F.col(PERIOD) <= last)
    return stored.drop(PERIOD)


def as_artifacts(df: DataFrame, *, run_id: str, artifact_type: str, artifact_id: Column, created_at: Column | None = None) -> DataFrame:
    """Each row of ``df`` as one JSON document."""
    created = created_at if created_at is not None else F.current_timestamp()
    return conform(
        df.select(
            artifact_id.alias("artifact_id"),
            F.lit(run_id).alias("run_id"),
            F.lit(artifact_type).alias("artifact_type"),
            F.to_json(F.struct("*")).alias("data_json"),
            created.alias("created_at"),
        ),
        ARTIFACT,
    )


def append_artifacts(artifacts: DataFrame, path: str) -> None:
    conform(artifacts, ARTIFACT).write.mode("append").partitionBy("artifact_type").parquet(path)


def read_artifacts(spark: SparkSession, path: str) -> DataFrame:
    return conform(spark.read.schema(ARTIFACT).parquet(path), ARTIFACT)


def current_artifacts(artifacts: DataFrame) -> DataFrame:
    """The last version saved under each artifact id; a later save replaces an earlier one."""
    others = [c for c in artifacts.columns if c != "artifact_id"]
    newest = F.max_by(F.struct(*others), F.struct("created_at", "data_json"))
    return artifacts.groupBy("artifact_id").agg(newest.alias("row")).select("artifact_id", "row.*")


def latest_artifacts(artifacts: DataFrame) -> DataFrame:
    """The newest artifact of each run and type."""
    current = current_artifacts(artifacts)
    newest = F.max_by(F.struct("artifact_id", "data_json", "created_at"), F.struct("created_at", "artifact_id"))
    return current.groupBy("run_id", "artifact_type").agg(newest.alias("row")).select("run_id", "artifact_type", "row.*")


def append_events(events: DataFrame, path: str) -> None:
    conform(events, RUN_EVENT).write.mode("append").parquet(path)


def run_events(events: DataFrame, run_id: str) -> DataFrame:
    """The events of one run in order."""
    return events.where(F.col("run_id") == run_id).orderBy("event_id")


def newest(df: DataFrame, *, by: str = "created_at", tie: str | None = None, limit: int | None = None) -> DataFrame:
    """Rows newest first, the first ``limit`` of them if given."""
    order = [F.desc(by)] + ([F.col(tie)] if tie else [])
    ordered = df.orderBy(*order)
    return ordered if limit is None else ordered.limit(limit)


# ---------------------------------------------------------------------------
# Artifacts as a base and what came since
# ---------------------------------------------------------------------------
def write_base(artifacts: DataFrame, table: str, *, buckets: int = 64) -> None:
    """Store the current version of each artifact as a table, bucketed and sorted by artifact_id.

    The table must not exist: a base is never changed, a later one takes its place.
    """
    current = conform(current_artifacts(artifacts), ARTIFACT)
    current.write.format("parquet").bucketBy(buckets, "artifact_id").sortBy("artifact_id").mode("errorifexists").saveAsTable(table)


def append_delta(artifacts: DataFrame, delta: str) -> None:
    """Save artifacts after the base was written; the base is not touched."""
    conform(artifacts, ARTIFACT).write.mode("append").parquet(delta)


def merged_artifacts(spark: SparkSession, table: str, delta: str | None) -> DataFrame:
    """The current version of each artifact: the newer of base and delta.

    The delta is reduced to one row per artifact and dealt into the buckets of the base, which is
    read bucket by bucket and neither shuffled nor aggregated. Equal to ``current_artifacts``
    over everything ever saved.
    """
    base = spark.table(table)
    if delta is None:
        return base
    described = spark.sql(f"DESCRIBE EXTENDED {table}").where("col_name = 'Num Buckets'").first()
    dealt = conform(spark.read.schema(ARTIFACT).parquet(delta), ARTIFACT).repartition(int(described["data_type"]), "artifact_id")
    came = current_artifacts(dealt)
    names = [c for c in base.columns if c != "artifact_id"]

    def version(side: str) -> Column:
        order = [c for c in ("created_at", "data_json") if c in names]
        fields = [F.col(f"{side}.{c}") for c in [*order, *[n for n in names if n not in order]]]
        return F.when(F.col(f"{side}.artifact_id").isNotNull(), F.struct(*fields))

    # The newer one by time, then content; a side that lacks the artifact is null and loses.
    both = base.alias("base").join(came.alias("came").hint("merge"), F.col("base.artifact_id") == F.col("came.artifact_id"), "full_outer")
    newer = both.select(
        F.coalesce("base.artifact_id", "came.artifact_id").alias("artifact_id"), F.greatest(version("base"), version("came")).alias("row")
    )
    return conform(newer.select("artifact_id", "row.*"), ARTIFACT)


def compact(spark: SparkSession, table: str, delta: str, into: str, *, buckets: int = 64) -> None:
    """Write base and delta as a new base; afterwards ``into`` alone is current.

    Merged rows keep the buckets of the old base, if ``buckets`` is the same.
    """
    merged = merged_artifacts(spark, table, delta)
    merged.write.format("parquet").bucketBy(buckets, "artifact_id").sortBy("artifact_id").mode("errorifexists").saveAsTable(into)
