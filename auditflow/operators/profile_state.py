"""Column profiles kept as states of parts: new files are read once, then states are merged.

A load stores two tables: the distinct values of each part and column with their counts, and one
row per part and column with counts, moments and first values. A part may be a file, a month or a
batch. Merged states give the profile that ``profile.column_profile`` makes of all rows.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from auditflow.functions.parsing import DATE_FORMATS, has_leading_zero, is_missing, is_whole, parse_date, parse_double
from auditflow.operators import profile
from auditflow.records import COLUMN_PROFILE, conform

VALUES = "part string, name string, value string, n long"
MOMENTS = (
    "part string, name string, total_count long, present_count long, has_leading_zeros boolean, numbers long, dates long, "
    "all_whole boolean, min_num double, max_num double, mean_value double, squares double, min_date date, max_date date, "
    "first_values array<string>, kept int"
)


def add_load(
    df: DataFrame, folder: str, load: str, *, part: Column, date_formats: Sequence[str] = DATE_FORMATS, samples: int = 5
) -> None:
    """Store the states of the parts that ``df`` holds whole.

    ``df`` is read once. ``load`` names the load and orders it among others: of a part that came
    with several, the load with the greatest name counts. A load run again replaces itself, and
    none counts before its moments are written, so a failed one can simply be repeated. Rows
    with a null part form a part of their own. A load replaces only parts it has rows of.
    """
    if not re.fullmatch(r"[A-Za-z0-9_.-]+", load):
        raise ValueError("a load is named by letters, digits, '_', '.' and '-'")
    spark = df.sparkSession
    cells = profile.as_cells(df, part).withColumn("value", F.when(~is_missing(F.col("cell")), F.col("cell")))
    path = f"{folder}/values/load={load}"
    cells.groupBy("part", "name", "value").agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(path)

    stored = spark.read.schema(VALUES).parquet(path)
    moments = _moments(stored, date_formats)
    place = F.row_number().over(Window.partitionBy("part", "name").orderBy("value"))
    first = stored.where("value IS NOT NULL").withColumn("place", place).where(F.col("place") <= samples)
    first = first.groupBy("part", "name").agg(F.sort_array(F.collect_list("value")).alias("first_values"))
    full = _with(moments, first).withColumn("kept", F.lit(samples))
    full.write.mode("overwrite").parquet(f"{folder}/moments/load={load}")


def _with(left: DataFrame, right: DataFrame) -> DataFrame:
    """``left`` with the columns of ``right``'s row of the same part and name."""
    other = right.withColumnsRenamed({"part": "_part", "name": "_name"})
    same = F.col("part").eqNullSafe(F.col("_part")) & (F.col("name") == F.col("_name"))
    return left.join(other, same, "left").drop("_part", "_name")


def _moments(stored: DataFrame, date_formats: Sequence[str]) -> DataFrame:
    """Counts and moments per part and column from counted distinct values."""
    value, n = F.col("value"), F.col("n")
    typed = stored.select("part", "name", "value", "n", parse_double(value).alias("num"), parse_date(value, date_formats).alias("day"))

    def rows(has: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col(has).isNotNull(), n)), F.lit(0))

    counted = typed.groupBy("part", "name").agg(
        F.sum("n").alias("total_count"),
        rows("value").alias("present_count"),
        F.bool_or(has_leading_zero(value)).alias("has_leading_zeros"),
        rows("num").alias("numbers"),
        rows("day").alias("dates"),
        F.bool_and(is_whole(F.col("num"))).alias("all_whole"),
        F.min("num").alias("min_num"),
        F.max("num").alias("max_num"),
        F.try_divide(F.sum(F.col("num") * n), rows("num")).alias("mean_value"),
        F.min("day").alias("min_date"),
        F.max("day").alias("max_date"),
    )
    # Squares around the part's own mean: sums of plain squares would lose digits.
    apart = _with(typed.where("num IS NOT NULL"), counted.select("part", "name", "mean_value"))
    squares = apart.groupBy("part", "name").agg(F.sum(n * F.pow(F.col("num") - F.col("mean_value"), 2)).alias("squares"))
    return _with(counted, squares)


def read_states(spark: SparkSession, folder: str, parts: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Values and moments that count: of each part those of its newest load."""
    moments = spark.read.schema(f"{MOMENTS}, load string").parquet(f"{folder}/moments")
    values = spark.read.schema(f"{VALUES}, load string").parquet(f"{folder}/values")
    if parts is not None:
        moments, values = moments.where(parts), values.where(parts)
    newest = moments.groupBy(F.col("part").alias("_part")).agg(F.max("load").alias("_load"))
    same = F.col("part").eqNullSafe(F.col("_part")) & (F.col("load") == F.col("_load"))
    return values.join(newest, same, "left_semi"), moments.join(newest, same, "left_semi")


def merged_profile(
    spark: SparkSession,
    folder: str,
    table_id: str,
    columns: Sequence[str],
    *,
    parts: Column | None = None,
    id_columns: Sequence[str] | None = None,
    samples: int = 5,
) -> DataFrame:
    """The column profile of all stored parts, or of those for which ``parts`` holds (a condition on ``part``).

    No row of the profiled table is read. Moments have one row per part and column; exact distinct
    counts merge the stored values by key. ``samples`` may not exceed what every load kept.
    """
    values, moments = read_states(spark, folder, parts)
    weight = F.col("numbers")
    whole = moments.groupBy("name").agg(
        *[F.sum(c).alias(c) for c in ("total_count", "present_count", "numbers", "dates")],
        F.bool_or("has_leading_zeros").alias("has_leading_zeros"),
        F.bool_and("all_whole").alias("all_whole"),
        *[F.min(c).alias(c) for c in ("min_num", "min_date", "kept")],
        *[F.max(c).alias(c) for c in ("max_num", "max_date")],
        F.try_divide(F.sum(weight * F.col("mean_value")), F.sum(weight)).alias("mean_value"),
    )
    # Squares around the common mean: those inside each part and those of the part's mean.
    apart = moments.join(whole.select("name", F.col("mean_value").alias("_mean")), "name")
    between = weight * F.pow(F.col("mean_value") - F.col("_mean"), 2)
    squares = apart.groupBy("name").agg(F.sum(F.col("squares") + between).alias("squares"))
    distinct = values.groupBy("name").agg(F.count_distinct("value").alias("unique_count"))
    stats = whole.join(squares, "name", "left").join(distinct, "name", "left")
    spread = F.when(weight == 1, F.lit(0.0)).when(weight > 1, F.sqrt(F.col("squares") / (weight - 1)))
    stats = stats.withColumns({"std_dev": spread, "total_count": _enough(samples)})
    merged = profile.described(spark, stats, columns, table_id, id_columns)
    if samples:
        first = moments.select("name", F.explode("first_values").alias("cell"))
        merged = profile.with_samples(merged, profile.smallest_values(first, samples))
    return conform(merged, COLUMN_PROFILE)


def _enough(samples: int) -> Column:
    """The row count, or an error where a load kept fewer first values than are asked for."""
    short = F.raise_error(F.lit(f"a load kept fewer than {samples} first values"))
    return F.when(F.col("kept") < samples, short.cast("long")).otherwise(F.col("total_count"))
