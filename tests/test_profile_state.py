"""Profiles merged from states of parts equal the profile of all rows."""

import math
import statistics
from fractions import Fraction

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from tests.conftest import same_fields

from auditflow.operators import profile, profile_state
from auditflow.records import COLUMN_PROFILE

SCHEMA = "month string, code string, amount string, day string, Part string, note string"


def _rows(n):
    months = ["2026-01", "2026-02", "2026-03", None]
    return [
        (
            months[i % 4],
            f"{i % 7:03d}",
            [None, "", f"{i * 37 % 1000},5", f"{i}.25"][i % 4] if i % 5 else "1000000.125",
            None if i % 3 == 0 else f"2026-0{i % 9 + 1}-1{i % 9}",
            str(i % 2),
            "x" * 100_000 if i == 5 else [None, "a", "it's, \"q\"", " "][i % 4],
        )
        for i in range(n)
    ]


def _plain(df):
    found = {}
    for r in df.collect():
        values = r.asDict()
        found[values.pop("name")] = values
    return found


def _same(ours, theirs):
    ours, theirs = _plain(ours), _plain(theirs)
    assert ours.keys() == theirs.keys()
    for name, expected in theirs.items():
        for field, value in expected.items():
            got = ours[name][field]
            if isinstance(value, float):
                assert math.isclose(got, value, rel_tol=1e-12, abs_tol=1e-9), (name, field)
            else:
                assert got == value, (name, field)


@pytest.fixture
def table(spark):
    return spark.createDataFrame(_rows(200), SCHEMA)


def test_parts_of_several_loads_merge_to_the_whole(spark, table, tmp_path):
    folder, part = str(tmp_path / "state"), F.col("month")
    for i, month in enumerate(["month = '2026-01'", "month = '2026-02' OR month IS NULL", "month = '2026-03'"]):
        profile_state.add_load(table.where(month), folder, f"{i}", part=part)
    merged = profile_state.merged_profile(spark, folder, "t", table.columns)
    assert same_fields(merged, COLUMN_PROFILE)
    _same(merged, profile.column_profile(table, "t"))
    some = profile_state.merged_profile(spark, folder, "t", table.columns, parts=F.col("part") <= "2026-02", samples=2)
    _same(some, profile.column_profile(table.where("month <= '2026-02'"), "t", samples=2))


def test_a_part_that_came_again_counts_once_with_its_newest_rows(spark, table, tmp_path):
    folder, part = str(tmp_path / "state"), F.col("month")
    profile_state.add_load(table, folder, "1", part=part)
    changed = table.where("month = '2026-02'").withColumn("amount", F.lit("7"))
    for _ in range(2):  # a load run again replaces itself
        profile_state.add_load(changed, folder, "2", part=part)
    merged = profile_state.merged_profile(spark, folder, "t", table.columns)
    now = table.where("month IS DISTINCT FROM '2026-02'").unionByName(changed)
    _same(merged, profile.column_profile(now, "t"))


def test_a_load_without_moments_does_not_count(spark, table, tmp_path):
    folder, part = str(tmp_path / "state"), F.col("month")
    profile_state.add_load(table, folder, "1", part=part)
    lost = spark.createDataFrame([("2026-01", "code", "999", 1)], "part string, name string, value string, n long")
    lost.write.parquet(f"{folder}/values/load=2")
    _same(profile_state.merged_profile(spark, folder, "t", table.columns), profile.column_profile(table, "t"))


def test_random_numbers_keep_their_digits(spark, tmp_path):
    numbers = spark.range(5000).select(
        F.col("id").cast("string").alias("row_no"),
        (F.lit(1e9) + F.pmod(F.hash("id"), F.lit(10_000)) / 1000).cast("string").alias("v"),
    )
    folder = str(tmp_path / "state")
    profile_state.add_load(numbers, folder, "a", part=F.col("row_no") % 13)
    found = _plain(profile_state.merged_profile(spark, folder, "t", numbers.columns))["v"]
    # Against exact arithmetic: a deviation of 3 around a thousand million, where means of parts round at 1e-7.
    exact = [Fraction(float(r["v"])) for r in numbers.collect()]
    assert math.isclose(found["mean_value"], statistics.mean(exact), rel_tol=1e-15)
    assert math.isclose(found["std_dev"], statistics.stdev(exact), rel_tol=1e-8)
    assert found["unique_count"] == len(set(exact))


def test_no_rows_and_one_row(spark, table, tmp_path):
    for i, rows in enumerate([table.limit(0), spark.createDataFrame([("m", "1", "2", None, None, "")], SCHEMA)]):
        folder = str(tmp_path / f"state-{i}")
        profile_state.add_load(rows, folder, "1", part=F.col("month"))
        _same(profile_state.merged_profile(spark, folder, "t", table.columns), profile.column_profile(rows, "t"))


def test_more_samples_than_kept_is_an_error(spark, table, tmp_path):
    folder = str(tmp_path / "state")
    profile_state.add_load(table, folder, "1", part=F.col("month"), samples=2)
    with pytest.raises(PySparkException):
        profile_state.merged_profile(spark, folder, "t", table.columns, samples=3).collect()
    with pytest.raises(ValueError):
        profile_state.add_load(table, folder, "a/b", part=F.col("month"))


def test_merging_reads_states_only(spark, table, tmp_path):
    folder, stored = str(tmp_path / "state"), str(tmp_path / "rows")
    table.write.parquet(stored)
    profile_state.add_load(spark.read.parquet(stored), folder, "1", part=F.col("month"))
    merged = profile_state.merged_profile(spark, folder, "t", table.columns)
    assert all("/state/" in f for f in merged.inputFiles())
