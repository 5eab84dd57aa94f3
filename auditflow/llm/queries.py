"""Named queries of this subpackage; each reads whole tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, functions as F

from auditflow.llm import (
    collocations, decontaminate, exact_dedup, langid, license_scan, mixing, prefix_trie, private_data, quality, simhash, substring_dedup, token_output, warc,
)
from auditflow.session import ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

#: Shares that the sources are to have; sources not named share that of OTHER.
WEIGHTS = {"src0": 0.2, "src1": 0.1, "src2": 0.1, "src3": 0.05, mixing.OTHER: 0.55}


def query(fn):
    @wraps(fn)
    def shipped(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return fn(spark, sf_dir)

    QUERIES[fn.__name__] = shipped
    return shipped


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op8_exact_dedup(spark, sf_dir):
    return exact_dedup.deduplicate(spark, f"{sf_dir}/documents.parquet")


@query
def op9_poisson_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"), WEIGHTS, seed=42)


@query
def op7_covering_simhash(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op1_license_scan(spark, sf_dir):
    return license_scan.scan_licenses(table(spark, sf_dir, "documents")).withColumn("n_spans", F.size("spans").cast("long")).drop("spans")


@query
def op2_substring_dedup(spark, sf_dir):
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), with_text=False)


@query
def op5_warc_archive(spark, sf_dir):
    headers, payloads = warc.write_archive(table(spark, sf_dir, "pages"))
    return warc.catalogue(warc.read_records(headers, payloads)).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


@query
def op4_decontamination(spark, sf_dir):
    found = decontaminate.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), slop=1)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        decontaminate.contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"), "n_near_items",
    )


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query
def op6_bit_plane_tokens(spark, sf_dir):
    return token_output.token_index(spark, token_output.write_tokens(table(spark, sf_dir, "documents"), tokenizer_path()))


@query
def op10_language_spans(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.where(~langid.held_out()))
    found = langid.label(docs, model)
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score", F.size("spans").cast("long").alias("n_spans"))


@query
def op3_cotrained_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))


@query
def op13_private_data(spark, sf_dir):
    return private_data.summary(private_data.find_private(table(spark, sf_dir, "documents").select("doc_id", "text")))


@query
def op11_prefix_trie(spark, sf_dir):
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


@query
def op12_collocations(spark, sf_dir):
    return collocations.collocations(table(spark, sf_dir, "documents"))
