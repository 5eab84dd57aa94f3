"""Tables written once into the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from auditflow.session import ensure_checkpoint_dir


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder (``spark.checkpoint.dir``)."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it from there.

    Later steps neither repeat the work nor need the executors that did it, and Spark knows the
    size of the table, so it broadcasts it only under its own limit.
    """
    path = new_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
