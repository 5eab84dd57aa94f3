"""Column and table profiles of tables whose cells are text."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from auditflow.functions.naming import DATE_NAME_PARTS, ID_NAME_PARTS, display_title, has_part, row_meaning
from auditflow.functions.parsing import (
    DATE_FORMATS,
    has_leading_zero,
    is_missing,
    is_whole,
    parse_date,
    parse_double,
    percent_of_rows,
    sample_std,
)
from auditflow.records import COLUMN_PROFILE, TABLE_PROFILE, conform

CATEGORICAL_BELOW = 50
DATES_NEEDED_WITHOUT_NAME = 5


def as_cells(df: DataFrame, part: Column | None = None) -> DataFrame:
    """The table in long form: one row per cell, with the column's name and, if asked for, its row's ``part``."""
    columns = [F.col(f"`{c}`").cast("string").alias(c) for c in df.columns]
    if part is None:
        return df.select(*columns).unpivot([], [F.col(f"`{c}`") for c in df.columns], "name", "cell")
    tag = "part"
    while tag in {c.lower() for c in df.columns}:
        tag = f"_{tag}"
    tagged = df.select(part.cast("string").alias(tag), *columns)
    return tagged.unpivot([tag], [F.col(f"`{c}`") for c in df.columns], "name", "cell").withColumnRenamed(tag, "part")


def _named_like(name: Column, columns: Sequence[str], parts: Sequence[str]) -> Column:
    matching = [c for c in columns if has_part(c, parts)]
    return name.isin(*matching) if matching else F.lit(False)


def column_profile(
    df: DataFrame,
    table_id: str,
    *,
    id_columns: Sequence[str] | None = None,
    date_formats: Sequence[str] = DATE_FORMATS,
    samples: int = 5,
) -> DataFrame:
    """One row per column: counts, inferred type, role and statistics.

    Columns become rows first, so that wide tables do not make wide plans. The
    exact distinct count shares its two-step aggregate with the other statistics:
    cells are combined per distinct value before they meet in one row per column.
    ``id_columns`` replaces the rule that finds identifiers by name. Samples are
    the smallest distinct values; ``samples=0`` saves their pass over the table.
    """
    columns = df.columns
    cells = as_cells(df)
    cell = F.col("cell")
    present = ~is_missing(cell)
    long_form = cells.select(
        "name",
        F.when(present, cell).alias("value"),
        F.when(present, parse_double(cell)).alias("num"),
        F.when(present, parse_date(cell, date_formats)).alias("day"),
    )
    stats = long_form.groupBy("name").agg(
        F.count(F.lit(1)).alias("total_count"),
        F.count("value").alias("present_count"),
        F.count_distinct("value").alias("unique_count"),
        F.bool_or(has_leading_zero(F.col("value"))).alias("has_leading_zeros"),
        F.count("num").alias("numbers"),
        F.count("day").alias("dates"),
        F.bool_and(is_whole(F.col("num"))).alias("all_whole"),
        F.min("num").alias("min_num"),
        F.max("num").alias("max_num"),
        F.avg("num").alias("mean_value"),
        sample_std(F.col("num")).alias("std_dev"),
        F.min("day").alias("min_date"),
        F.max("day").alias("max_date"),
    )
    profile = described(df.sparkSession, stats, columns, table_id, id_columns)
    if samples:
        profile = with_samples(profile, smallest_values(cells, samples))
    return conform(profile, COLUMN_PROFILE)


def with_samples(profile: DataFrame, values: DataFrame) -> DataFrame:
    joined = profile.join(values, "name", "left")
    return joined.withColumn("sample_values", F.coalesce("sample_values", F.array().cast("array<string>")))


def described(
    spark: SparkSession, stats: DataFrame, columns: Sequence[str], table_id: str, id_columns: Sequence[str] | None = None
) -> DataFrame:
    """Statistics per column with the type and role that follow from them."""
    # One row per column of the table, also if the table has no rows.
    names = spark.range(1).select(
        F.inline(F.array(*[F.struct(F.lit(i).alias("position"), F.lit(c).alias("name")) for i, c in enumerate(columns)]))
    )
    name = F.col("name")
    is_id = name.isin(*id_columns) if id_columns is not None else _named_like(name, columns, ID_NAME_PARTS)
    is_id = is_id | F.col("has_leading_zeros")
    filled = F.col("present_count") > 0
    is_numeric = filled & (F.col("numbers") == F.col("present_count"))
    is_date = (
        filled
        & (F.col("dates") == F.col("present_count"))
        & (_named_like(name, columns, DATE_NAME_PARTS) | (F.col("dates") > DATES_NEEDED_WITHOUT_NAME))
    )
    number_type = F.when(F.col("all_whole"), "integer").otherwise("float")
    zero = F.lit(0).cast("long")
    profile = (
        names.join(stats, "name", "left")
        .withColumns({c: F.coalesce(F.col(c), zero) for c in ("total_count", "present_count", "unique_count", "numbers", "dates")})
        .withColumn("has_leading_zeros", F.coalesce("has_leading_zeros", F.lit(False)))
        .withColumn(
            "inferred_type",
            F.when(is_id, "string").when(is_numeric, number_type).when(is_date, "date").otherwise("string"),
        )
    )
    kind = F.col("inferred_type")
    role = (
        F.when(is_id, "id")
        .when(kind.isin("integer", "float"), "numeric")
        .when(kind == "date", "date")
        .when(F.col("unique_count") < CATEGORICAL_BELOW, "categorical")
    )
    null_count = F.col("total_count") - F.col("present_count")
    return profile.withColumns(
        {
            "table_id": F.lit(table_id),
            "column_role": role,
            "null_count": null_count,
            "null_percentage": percent_of_rows(null_count, F.col("total_count")),
            **{c: F.when(kind.isin("integer", "float"), F.col(c)) for c in ("min_num", "max_num", "mean_value", "std_dev")},
            **{c: F.when(kind == "date", F.col(c)) for c in ("min_date", "max_date")},
        }
    )


def smallest_values(cells: DataFrame, k: int) -> DataFrame:
    """The ``k`` smallest distinct non-missing values per column.

    Equal cells are reduced to one before values are ranked, and ranked before the
    shuffle as well: a task sends the first ``k`` values of each column, however
    many rows have them.
    """
    values = cells.where(~is_missing(F.col("cell"))).groupBy("name", "cell").agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy("name").orderBy("cell"))
    few = values.withColumn("place", place).where(F.col("place") <= k)
    return few.groupBy("name").agg(F.sort_array(F.collect_list("cell")).alias("sample_values"))


def profile_tables(tables: Mapping[str, DataFrame], **options) -> DataFrame:
    """Column profiles of several tables."""
    profiles = [column_profile(df, table_id, **options) for table_id, df in tables.items()]
    combined = profiles[0]
    for profile in profiles[1:]:
        combined = combined.unionByName(profile)
    return combined


def table_profile(
    columns: DataFrame,
    tables: Mapping[str, DataFrame],
    *,
    sources: Mapping[str, str] | None = None,
    file_hashes: Mapping[str, str] | None = None,
) -> DataFrame:
    """One row per table from its column profiles: size, meaning and columns by role."""

    def named(role: str) -> Column:
        return F.sort_array(F.collect_list(F.when(F.col("column_role") == role, F.col("name"))))

    def looked_up(values: Mapping[str, str | None]) -> Column:
        result = F.lit(None).cast("string")
        for table_id, value in values.items():
            result = F.when(F.col("table_id") == table_id, F.lit(value)).otherwise(result)
        return result

    rolled = columns.groupBy("table_id").agg(
        F.max("total_count").alias("row_count"),
        F.count("name").alias("column_count"),
        named("date").alias("date_columns"),
        named("id").alias("id_columns"),
        named("numeric").alias("numeric_columns"),
        named("categorical").alias("categorical_columns"),
    )
    return conform(
        rolled.withColumns(
            {
                "display_name": looked_up({t: display_title(t) for t in tables}),
                "row_semantic_meaning": looked_up({t: row_meaning(t, df.columns) for t, df in tables.items()}),
                "source": looked_up(sources or {}),
                "file_hash_sha256": looked_up(file_hashes or {}),
            }
        ),
        TABLE_PROFILE,
    )
