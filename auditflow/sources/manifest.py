"""Files as data: admission, fingerprints, manifest, and changes since the last one."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from auditflow.functions.naming import table_name_of
from auditflow.sources import ranges
from auditflow.sources.csvtext import text_schema

# What may be ingested.
ALLOWED_EXTENSIONS = (".csv", ".xlsx")
MAX_FILE_BYTES = 100 * 1024 * 1024


def source_path() -> Column:
    """Path of the file a row was read from, with the escapes of its URI undone."""
    return F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))


def _file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)$", 1)


def list_files(spark: SparkSession, path: str | Sequence[str], *, recursive: bool = False) -> DataFrame:
    """Files with name and length. Their content is not read unless it is selected."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(path)
    return files.select(
        source_path().alias("path"),
        _file_name(source_path()).alias("file_name"),
        "length",
        "content",
    )


def admission(
    files: DataFrame, *, extensions: Sequence[str] = ALLOWED_EXTENSIONS, max_bytes: int | None = MAX_FILE_BYTES
) -> DataFrame:
    """Add why a file is turned away, or null. Without ``max_bytes`` any size is admitted."""
    extension = F.lower(F.regexp_extract("file_name", r"(\.[^.]*)$", 1))
    reason = F.when(~extension.isin(*extensions), F.concat(F.lit("Extension not allowed: "), extension))
    if max_bytes is not None:
        reason = reason.when(F.col("length") > max_bytes, F.lit(f"File exceeds {max_bytes} bytes"))
    return files.withColumn("reject_reason", reason)


LARGEST_BINARY_FILE = 2**31 - 1
#: Larger files are hashed by byte ranges.
ONE_ROW_BYTES = 256 * 1024 * 1024


def fingerprints(files: DataFrame) -> DataFrame:
    """SHA-256 per file, and why a file has none.

    A file is one row, so its bytes are read only up to 2 GiB; larger ones stay in
    the list without a hash. ``file_fingerprints`` hashes files of any size.
    """
    readable = F.col("length") <= LARGEST_BINARY_FILE
    reason = F.lit("Too large to be hashed as one row")
    return (
        files.where(readable).select("path", "file_name", "length", F.sha2("content", 256).alias("sha256"), F.lit(None).cast("string").alias("no_hash_reason"))
        .unionByName(files.where(~readable).select("path", "file_name", "length", F.lit(None).cast("string").alias("sha256"), reason.alias("no_hash_reason")))
    )


def file_fingerprints(spark: SparkSession, path: str | Sequence[str], *, recursive: bool = False, one_row_bytes: int = ONE_ROW_BYTES) -> DataFrame:
    """``fingerprints`` of the files at a path; no task reads a large file whole.

    Files above ``one_row_bytes`` are listed and hashed by ranges when this is called, at any size
    (see ``ranges``). Those that Hadoop does not give out by ranges, such as ``.gz``, stay one row.
    """
    files = list_files(spark, path, recursive=recursive)
    small, whole = F.col("length") <= one_row_bytes, F.col("file_name").rlike(ranges.NOT_BY_RANGES)
    found = files.where(~small & ~whole).select("path", "file_name", "length").collect() if ranges.available() else []
    if not found:
        return fingerprints(files)
    range_bytes = 1 << min(ranges.RANGE_BYTES, one_row_bytes).bit_length() - 1
    hashes = ranges.sha256_by_ranges(spark, list({r.path: r.length for r in found}.items()), range_bytes=range_bytes)
    # Apart, so that the length and the name reach the listing and nothing else is read.
    one_row = fingerprints(files.where(small)).unionByName(fingerprints(files.where(~small & whole)))
    return one_row.unionByName(spark.createDataFrame([(*r, hashes[r.path], None) for r in found], one_row.schema))


def rows_per_file(df: DataFrame) -> DataFrame:
    """Rows of a table read from files, by the file they lie in."""
    return df.groupBy(source_path().alias("path")).agg(F.count(F.lit(1)).alias("row_count"))


def csv_manifest(spark: SparkSession, path: str | Sequence[str], *, multiline: bool = False) -> DataFrame:
    """Per CSV file: table name, rows, columns, length and fingerprint."""
    files = file_fingerprints(spark, path)
    # The first line of a file, as a row whose block begins at 0: no file is read whole for it.
    lines = spark.read.text(path).select(source_path().alias("path"), "value", F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("place"))
    header = F.substring_index(F.min_by("value", "place"), "\r", 1)
    headers = lines.where("at = 0").groupBy("path").agg(F.size(F.split(header, ',(?=(?:[^"]*"[^"]*")*[^"]*$)')).cast("long").alias("column_count"))
    named = files.select("path", "file_name", "length", table_name_of(F.col("file_name")).alias("table_name"), "sha256")
    described = named.join(headers, "path", "left").withColumn("column_count", F.coalesce("column_count", F.lit(1).cast("long")))
    records = spark.read.option("header", True).option("escape", '"').option("multiLine", multiline)
    counts = (
        records.schema(text_schema(["first"])).csv(path)
        .groupBy(source_path().alias("path"))
        .agg(F.count(F.lit(1)).alias("row_count"))
    )
    return described.join(counts, "path", "left").withColumn("row_count", F.coalesce("row_count", F.lit(0).cast("long")))


def table_manifest(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Per table: rows and columns. Row counts of Parquet come from file footers."""
    counted = [
        df.agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(name).alias("table_name"), "row_count", F.lit(len(df.columns)).cast("long").alias("column_count")
        )
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, counted)


def file_changes(current: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files against an earlier manifest: unchanged, changed, missing or new."""
    now = current.select("path", F.col("sha256").alias("current_sha256"))
    then = manifest.select("path", F.col("sha256").alias("manifest_sha256"))
    state = (
        F.when(F.col("current_sha256").isNull(), "missing")
        .when(F.col("manifest_sha256").isNull(), "new")
        .when(F.col("current_sha256") != F.col("manifest_sha256"), "changed")
        .otherwise("unchanged")
    )
    return then.join(now, "path", "full_outer").withColumn("state", state)
