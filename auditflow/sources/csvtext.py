"""CSV files read as text, so that no cell is reinterpreted on the way in."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

CORRUPT_RECORD = "_corrupt_record"


def text_schema(columns: Sequence[str]) -> StructType:
    return StructType([StructField(c, StringType(), True) for c in columns])


def _reader(spark: SparkSession, multiline: bool):
    # Quotes inside a quoted cell are doubled; a file with line breaks inside
    # cells cannot be split, so that has to be asked for.
    return spark.read.option("header", True).option("escape", '"').option("multiLine", multiline)


def read_text_table(
    spark: SparkSession, path: str | Sequence[str], *, columns: Sequence[str] | None = None, multiline: bool = False
) -> DataFrame:
    """A CSV table with a header, every cell as text and empty cells as ``""``.

    Without ``columns`` the names are taken from the header. Leading zeros and
    words such as ``NA`` stay as written. Given columns save reading the header
    when the plan is made.
    """
    reader = _reader(spark, multiline)
    if columns is not None:
        reader = reader.schema(text_schema(columns))
    return reader.csv(path).na.fill("")


def read_flagging_malformed(
    spark: SparkSession, path: str | Sequence[str], columns: Sequence[str], *, multiline: bool = False
) -> DataFrame:
    """As ``read_text_table``, with the raw line of records that do not fit the columns."""
    schema = text_schema([*columns, CORRUPT_RECORD])
    reader = _reader(spark, multiline).schema(schema).option("mode", "PERMISSIVE")
    return reader.option("columnNameOfCorruptRecord", CORRUPT_RECORD).csv(path)


def malformed_records(df: DataFrame, table_id: str, *, samples: int = 3) -> DataFrame:
    """An issue record if any line of the file does not fit its columns."""
    from auditflow.operators.quality import _issues

    # The reader checks a line against the columns that a plan needs, so the test
    # must need all of them; their length is never below zero.
    columns = [F.col(f"`{c}`") for c in df.columns if c != CORRUPT_RECORD]
    has_columns = F.length(F.concat_ws("", *columns)) >= 0
    bad = F.col(CORRUPT_RECORD).isNotNull() & has_columns
    counted = df.agg(F.count(F.lit(1)).alias("total"), F.count_if(bad).alias("affected")).where(F.col("affected") > 0)
    few = df.where(bad).select(CORRUPT_RECORD).orderBy(CORRUPT_RECORD).limit(samples)
    evidence = few.agg(F.sort_array(F.collect_list(CORRUPT_RECORD)).alias("s")).scalar()
    return _issues(
        counted,
        issue_type="malformed_file",
        severity="warning",
        table_id=table_id,
        column=None,
        affected=F.col("affected"),
        total=F.col("total"),
        samples=evidence,
        description=F.concat(F.col("affected").cast("string"), F.lit(" lines do not fit the columns of the table.")),
        action="Correct the delimiter or quoting of these lines.",
        prefix="MALFORMED",
    )
