"""Schemas of the audit records which operators return.

Money inside the library is ``MONEY``; figures that leave it are doubles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    DateType,
    DecimalType,
    DoubleType,
    IntegerType,
    LongType,
    MapType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)

MONEY = DecimalType(18, 4)

UNKNOWN_MEMBER = "Unclassified"

STRINGS = ArrayType(StringType())


def _struct(*fields: tuple) -> StructType:
    return StructType([StructField(name, dtype, True) for name, dtype in fields])


COLUMN_PROFILE = _struct(
    ("table_id", StringType()),
    ("name", StringType()),
    ("inferred_type", StringType()),
    ("total_count", LongType()),
    ("null_count", LongType()),
    ("null_percentage", DoubleType()),
    ("unique_count", LongType()),
    ("has_leading_zeros", BooleanType()),
    ("column_role", StringType()),
    ("min_num", DoubleType()),
    ("max_num", DoubleType()),
    ("mean_value", DoubleType()),
    ("std_dev", DoubleType()),
    ("min_date", DateType()),
    ("max_date", DateType()),
    ("sample_values", STRINGS),
)

TABLE_PROFILE = _struct(
    ("table_id", StringType()),
    ("source", StringType()),
    ("display_name", StringType()),
    ("row_count", LongType()),
    ("column_count", LongType()),
    ("file_hash_sha256", StringType()),
    ("row_semantic_meaning", StringType()),
    ("date_columns", STRINGS),
    ("id_columns", STRINGS),
    ("numeric_columns", STRINGS),
    ("categorical_columns", STRINGS),
)

QUALITY_ISSUE = _struct(
    ("id", StringType()),
    ("issue_type", StringType()),
    ("severity", StringType()),
    ("table_id", StringType()),
    ("column", StringType()),
    ("affected_rows", LongType()),
    ("total_rows", LongType()),
    ("affected_percentage", DoubleType()),
    ("evidence_samples", STRINGS),
    ("description", StringType()),
    ("recommended_action", StringType()),
)

QUALITY_REPORT = _struct(
    ("issue_count", LongType()),
    ("has_blocking_issues", BooleanType()),
    ("coverage_start", DateType()),
    ("coverage_end", DateType()),
    ("is_last_period_incomplete", BooleanType()),
    ("incomplete_period_details", StringType()),
)

RELATIONSHIP = _struct(
    ("id", StringType()),
    ("left_table", StringType()),
    ("left_key", StringType()),
    ("right_table", StringType()),
    ("right_key", StringType()),
    ("cardinality", StringType()),
    ("match_rate_left", DoubleType()),
    ("orphan_count_left", LongType()),
    ("match_rate_right", DoubleType()),
    ("orphan_count_right", LongType()),
    ("risk_level", StringType()),
)

JOIN_CHECK = _struct(
    ("left_table", StringType()),
    ("right_table", StringType()),
    ("join_keys", StringType()),
    ("left_rows", LongType()),
    ("right_rows", LongType()),
    ("result_rows", LongType()),
    ("multiplication_factor", DoubleType()),
    ("orphans_left", LongType()),
    ("orphans_right", LongType()),
    ("metric_before", DoubleType()),
    ("metric_after", DoubleType()),
    ("metric_reconciled", BooleanType()),
    ("is_safe", BooleanType()),
    ("warning", StringType()),
)

TRANSFORMATION = _struct(
    ("step_index", IntegerType()),
    ("transformation_id", StringType()),
    ("operation", StringType()),
    ("columns_affected", STRINGS),
    ("parameters", MapType(StringType(), StringType())),
    ("rows_before", LongType()),
    ("rows_after", LongType()),
    ("rows_excluded", LongType()),
    ("exclusion_reason", StringType()),
    ("exclusion_samples", ArrayType(MapType(StringType(), StringType()))),
)

CONTRIBUTION = _struct(
    ("dimension", StringType()),
    ("dimension_value", StringType()),
    ("baseline_value", DoubleType()),
    ("current_value", DoubleType()),
    ("absolute_change", DoubleType()),
    ("percentage_change", DoubleType()),
    ("contribution_to_total_change", DoubleType()),
)

ANALYSIS_RESULT = _struct(
    ("result_id", StringType()),
    ("step_id", StringType()),
    ("category", StringType()),
    ("parameters", MapType(StringType(), StringType())),
    ("metric", StringType()),
    ("period", StringType()),
    ("warnings", STRINGS),
    ("validation_status", StringType()),
)

# One figure of a result. ``item`` tells repeated rows of a result apart, such as
# the months of a trend or the members of a dimension.
RESULT_VALUE = _struct(
    ("result_id", StringType()),
    ("item", StringType()),
    ("field", StringType()),
    ("value", DoubleType()),
)

VALIDATION_CHECK = _struct(
    ("result_id", StringType()),
    ("check_name", StringType()),
    ("passed", BooleanType()),
    ("severity", StringType()),
    ("evidence", StringType()),
)

METRIC_CARD = _struct(
    ("id", StringType()),
    ("title", StringType()),
    ("value", StringType()),
    ("comparison_text", StringType()),
    ("trend_direction", StringType()),
    ("result_id", StringType()),
    ("period", StringType()),
)

FINDING = _struct(
    ("id", StringType()),
    ("claim", StringType()),
    ("result_id", StringType()),
    ("metric_name", StringType()),
    ("observed_value", DoubleType()),
)

CITATION = _struct(
    ("source_type", StringType()),
    ("source_name", StringType()),
    ("filter_or_condition", StringType()),
    ("result_id", StringType()),
    ("details", StringType()),
)

ARTIFACT = _struct(
    ("artifact_id", StringType()),
    ("run_id", StringType()),
    ("artifact_type", StringType()),
    ("data_json", StringType()),
    ("created_at", TimestampType()),
)

RUN_EVENT = _struct(
    ("event_id", LongType()),
    ("run_id", StringType()),
    ("stage", StringType()),
    ("level", StringType()),
    ("message", StringType()),
    ("metadata_json", StringType()),
    ("created_at", TimestampType()),
)


def conform(df: DataFrame, schema: StructType) -> DataFrame:
    """Project ``df`` onto a record schema; fields it lacks become null."""

    def field(f: StructField) -> Column:
        source = F.col(f"`{f.name}`") if f.name in df.columns else F.lit(None)
        return source.cast(f.dataType).alias(f.name)

    return df.select(*[field(f) for f in schema.fields])
