"""Stages of the pipeline on rows without an identifier and rows that share one."""

import corpus_pipeline
from tests.llm.conftest import prose

SCHEMA = "doc_id long, text string, source string"


def left(stage, spark, rows, sf_dir):
    return sorted(map(tuple, stage(spark, spark.createDataFrame(rows, SCHEMA), sf_dir).collect()), key=repr)


def test_decontamination_goes_by_row(spark, sf_dir):
    items = [r["text"] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("text").limit(3).collect()]
    clean = [(None, prose(1, 80), "a"), (3, prose(2, 80), "a"), (3, prose(2, 80), "a"), (None, None, "a"), (None, None, "a"), (5, "", None)]
    rows = [*clean, (None, items[0], "a"), (3, items[1], "a"), (4, items[2], "b")]
    assert left(corpus_pipeline.decontamination_stage, spark, rows, sf_dir) == sorted(clean, key=repr)


def test_one_row_of_a_component_stays(spark):
    a, b, c = prose(3, 300), prose(4, 300), prose(5, 300)
    rows = [(None, a, "s"), (None, a, "t"), (7, b, "s"), (7, c, "s"), (2, b, "s"), (2, b, "s"), (9, c, "t")]
    got = left(corpus_pipeline.near_duplicate_stage, spark, rows, "")
    assert [(i, t) for i, t, _ in got] == sorted([(None, a), (2, b), (7, c)], key=repr)
