"""Exact deduplication with a stateful stream.

A stream reads records of (digest, identifier, length, locator) and keeps one state row per digest
in RocksDB, on disk, without watermark and so without expiry. A digest seen before is a hit. The
bytes of all hits are then read again through their locators (file and row) and compared with those
of the row that stays; rows that share a digest but not the bytes are grouped by the bytes. Only
DataFrame and SQL functions.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from auditflow.llm._store import keep, new_folder

STATE_ON_DISK = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # Else each state partition sets aside 4 MB of disk for its logs.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
}


def without_blanks(text: Column) -> Column:
    """The text without the characters ``[\\x20\\x09-\\x0D]``; null counts as empty."""
    out = F.coalesce(text, F.lit(""))
    for blank in " \t\n\x0b\x0c\r":
        out = F.replace(out, F.lit(blank), F.lit(""))
    return out


def records(docs: DataFrame, id_col: str, text_col: str, digest_bits: int) -> DataFrame:
    """Digest, identifier, code points and locator of every row of a table read from files."""
    sha = F.sha2(without_blanks(F.col(text_col)), 256)
    return docs.select(
        F.substring(sha, 1, digest_bits // 4).alias("digest"),
        sha.alias("text_sha256"),
        F.col(id_col).cast("long").alias("doc_id"),
        F.length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("points"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.row_index").alias("row"),
    )


def _preference() -> Column:
    """Larger is better: more code points, then the smaller identifier (none comes last), then the place."""
    return F.struct("points", F.col("doc_id").isNotNull().alias("known"), (-F.col("doc_id")).alias("minus_id"), "file", "row")


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]):
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def stream_groups(index: DataFrame, folder: str, files_per_batch: int) -> DataFrame:
    """Run the stream over all files of ``folder``: one row per digest with the row that stays and the group's size.

    Each micro-batch writes the groups it touched into a subfolder of its number, which a repeated
    batch overwrites; the newest row of a digest is its state.
    """
    spark = index.sparkSession
    out = new_folder(spark, "dedup-groups")
    with _settings(spark, STATE_ON_DISK):
        source = spark.readStream.schema(index.schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
        groups = source.groupBy("digest").agg(F.max(_preference()).alias("best"), F.count(F.lit(1)).alias("group_size"))

        def write(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

        stream = groups.writeStream.outputMode("update").foreachBatch(write).trigger(availableNow=True)
        stream.option("checkpointLocation", new_folder(spark, "dedup-state")).start().awaitTermination()
    schema = StructType([*groups.schema.fields, StructField("batch", LongType())])
    states = spark.read.schema(schema).option("basePath", out).parquet(f"{out}/batch=*") if _any(index) else spark.createDataFrame([], schema)
    newest = states.groupBy("digest").agg(F.max_by(F.struct("best", "group_size"), "batch").alias("s"))
    return newest.select("digest", "s.best", "s.group_size")


def _any(df: DataFrame) -> bool:
    return not df.limit(1).isEmpty()


def deduplicate(
    spark: SparkSession,
    path: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    files_per_batch: int = 16,
    digest_bits: int = 256,
) -> DataFrame:
    """One row per row of the Parquet table at ``path``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical without blanks; of equal texts the row with most code points
    stays, then the smallest identifier. A null text is empty, and empty texts form a group like
    any other. A row without an identifier stays only where all of its group lack one (``keep_id``
    is then null); of rows that repeat an identifier, the one whose place sorts last stays. Other
    columns aren't read; an empty table gives an empty one. ``digest_bits`` may be lowered in tests
    to force collisions, which the comparison of bytes resolves.
    """
    docs = spark.read.parquet(path)
    folder = new_folder(spark, "dedup-records")
    records(docs, id_col, text_col, digest_bits).write.option("compression", "zstd").parquet(folder)
    schema = records(docs, id_col, text_col, digest_bits).schema
    index = spark.read.schema(schema).parquet(folder)
    groups = keep(stream_groups(index, folder, files_per_batch), "dedup-state-rows")
    stays = (F.col("file") == F.col("best.file")) & (F.col("row") == F.col("best.row"))
    members = index.join(groups, "digest").withColumn("kept", stays)
    hits = members.where("group_size > 1").select("digest", "doc_id", "points", "file", "row", "kept", "text_sha256")

    # The bytes of all hits, read through their locators.
    located = docs.select(
        without_blanks(F.col(text_col)).alias("body"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")
    )
    bodies = keep(located.join(hits, ["file", "row"]), "dedup-bytes")
    staying = bodies.where("kept").select("digest", F.col("body").alias("kept_body"))
    unequal = keep(bodies.join(staying, "digest").where("body != kept_body").select("digest"), "dedup-unequal")
    single = keep(unequal.distinct(), "dedup-collisions")

    plain = members.select("digest", "doc_id", (-F.col("best.minus_id")).alias("keep_id"), "group_size", "kept", "text_sha256")
    if _any(single):  # a digest stands for several texts: group these by their bytes
        hit = bodies.join(single, "digest", "left_semi")
        by_bytes = keep(hit.groupBy("digest", "body").agg(F.max(_preference()).alias("best"), F.count(F.lit(1)).alias("group_size")), "dedup-by-bytes")
        regrouped = hit.drop("kept").join(by_bytes, ["digest", "body"]).withColumn("kept", stays)
        plain = plain.join(single, "digest", "left_anti").unionByName(
            regrouped.select("digest", "doc_id", (-F.col("best.minus_id")).alias("keep_id"), "group_size", "kept", "text_sha256")
        )
    return plain.drop("digest")
