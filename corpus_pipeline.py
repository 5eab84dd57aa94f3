"""A corpus pipeline of five stages, from the documents to token ids.

Each stage works on all rows that the one before it left; ``run`` writes them into the shared
folder and reads them again for the next stage.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession, functions as F

from auditflow.llm import decontaminate, mixing, quality, simhash, token_output
from auditflow.llm._store import keep
from auditflow.llm.queries import WEIGHTS, tokenizer_path
from auditflow.session import ship_package


def _free(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` doesn't have."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def _numbered(docs: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``docs`` with a number of each row, written once so that the numbers stay, and the number's column."""
    key = _free(docs, "row_key")
    return keep(docs.withColumn(key, F.monotonically_increasing_id()), name), key


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier accepts.

    Null and empty texts are scored like any other; rows are judged one by one, so repeated rows
    and identifiers stay or go together. Without labels nothing is learned and the classifier's
    own rule for that holds; no documents give none. Other columns pass through.
    """
    return quality.accepted(docs, quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: fingerprints of 3-word shingles linked at two differing bits or fewer.

    It is the row of the least identifier; rows without one come last, and rows of one identifier
    are ordered by their texts, equal rows arbitrarily. Null and blank texts have fingerprint zero
    and are one group. No documents give none. Columns of any name pass through.
    """
    rows, key = _numbered(docs, "near-rows")
    groups = simhash.near_duplicates(rows, id_col=key, shingle=3).select(F.col("doc_id").alias(key), "component_id")
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("text"), F.col(key).alias("key"))
    first = rows.select(key, place.alias("place")).join(groups, key).groupBy("component_id").agg(F.min("place").alias("place"))
    return rows.join(first.select(F.col("place.key").alias(key)), key, "left_semi").select(docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth stands in the benchmark.

    Null and empty texts have no words and stay, as everything does without a benchmark. Rows are
    judged one by one, whatever their identifiers. Columns of any name pass through.
    """
    rows, key = _numbered(docs, "decontamination-rows")
    found = decontaminate.search(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col=key)
    gone = found.where(decontaminate.contaminated(F.col("n_hit"), F.col("n_words"))).select(F.col("doc_id").alias(key))
    return rows.join(gone, key, "left_anti").select(docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources repeated or thinned to their target weights.

    Null sources count as the rest. Rows without an identifier draw by their text. No documents
    give none. Columns of any name pass through, also those that mixing itself adds.
    """
    own = {c: _free(docs, f"own_{c}") for c in docs.columns if c.lower() in ("copy", "shuffle_key")}
    mixed = mixing.mix(docs.withColumnsRenamed(own), WEIGHTS, seed=42).drop("copy", "shuffle_key")
    return mixed.withColumnsRenamed({v: k for k, v in own.items()}).select(docs.columns)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in bit-plane files, and the index of documents read back from them.

    Null texts have the end id only, rows without an identifier come first, and copies of a
    document stand side by side: the files are in ascending order of identifier, as their reader
    expects. No documents give empty files.
    """
    return token_output.token_index(spark, token_output.write_tokens(docs, tokenizer_path()))


def _shipped(stage):
    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return stage(spark, docs, sf_dir)

    return run_stage


STAGES = [
    ("quality_classifier", _shipped(quality_stage)),
    ("simhash_near_dedup", _shipped(near_duplicate_stage)),
    ("benchmark_decontamination", _shipped(decontamination_stage)),
    ("source_mixing", _shipped(mixing_stage)),
    ("token_output", _shipped(token_stage)),
]

#: The classifier, the fingerprints and the tokenizer have no SQL; tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
