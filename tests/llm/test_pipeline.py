"""Every stage of the pipeline against a plain version of it, each on what the stage before it left."""

import hashlib
import math

import corpus_pipeline
from pyspark.sql import functions as F
from auditflow.llm import quality
from auditflow.llm._store import keep
from auditflow.llm.queries import WEIGHTS
from tests.llm.test_decontaminate import plain as plain_hits
from tests.llm.test_simhash import plain as plain_components
from tests.llm.test_token_output import plain as plain_tokens


def plain_copies(rows, seed=42):
    """doc_id to number of copies."""
    def group(source):
        return source if source in WEIGHTS else "__other__"

    sizes = {}
    for r in rows:
        sizes[group(r["source"])] = sizes.get(group(r["source"]), 0) + len(r["text"] or "")
    out = {}
    for r in rows:
        g = group(r["source"])
        rate = sum(sizes.values()) * WEIGHTS[g] / sum(WEIGHTS.values()) / sizes[g]
        u = (int(hashlib.md5(f"{seed}|{r['doc_id']}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        term = total = math.exp(-rate)
        n = 0
        while u > total and n < 200:
            n += 1
            term *= rate / n
            total += term
        out[r["doc_id"]] = n
    return out


def test_stages_match_plain_versions(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_classifier", "simhash_near_dedup", "benchmark_decontamination", "source_mixing", "token_output"]

    def left(name, df):
        out = keep(stages[name](spark, df, sf_dir), name)
        assert out.columns == columns
        return out, out.collect()

    good, rows = left("quality_classifier", docs)
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in quality.score(docs, model).where("accepted").collect()}
    assert 100 < len(rows) < 200

    single, kept = left("simhash_near_dedup", good)
    components = plain_components([(r["doc_id"], r["text"]) for r in rows])
    assert sorted(r["doc_id"] for r in kept) == sorted({c for _, _, c in components})

    clean, rows = left("benchmark_decontamination", single)
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    hits = plain_hits([(r["doc_id"], r["text"]) for r in kept], items)
    assert sorted(r["doc_id"] for r in rows) == sorted(i for i, n, h, _ in hits if not (h > 0 and 20 * h >= n))

    mixed, copies = left("source_mixing", clean)
    expected = plain_copies(rows)
    counted = {i: 0 for i in expected}
    for r in copies:
        counted[r["doc_id"]] += 1
    assert counted == expected

    tokens = stages["token_output"](spark, mixed, sf_dir)
    by_text = sorted(((r["doc_id"], r["text"]) for r in copies), key=lambda r: r[0])
    assert sorted(map(tuple, tokens.collect())) == sorted(plain_tokens(by_text))


def test_run_is_the_stages_in_order(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


NAMES = ("row_key", "row_key_", "component_id", "key", "place", "copy", "shuffle_key", "own_copy", "fingerprint", "doc", "Copy_", "part", "segment")


def test_stages_bear_awkward_rows_and_any_names(spark, sf_dir, awkward):
    """Nulls, blanks, long and repeated texts, shared identifiers, and columns named as the stages' own."""
    docs = awkward.select("*", *(F.lit("own").alias(n) for n in NAMES if n != "copy"))
    stages = dict(corpus_pipeline.STAGES)
    for name in list(stages)[:-1]:
        out = stages[name](spark, docs, sf_dir)
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert {r[n] for r in rows for n in NAMES if n != "copy"} <= {"own"} and {r["copy"] for r in rows} <= {"clash"}, name
        given = {(r["doc_id"], r["text"], r["source"]) for r in docs.collect()}
        assert {(r["doc_id"], r["text"], r["source"]) for r in rows} <= given and rows, name
    tokens = stages["token_output"](spark, docs, sf_dir).collect()
    assert len(tokens) == docs.count()
    single = stages["simhash_near_dedup"](spark, docs, sf_dir).collect()
    # Blank and null texts are one group, whose least identifier is 4; equal texts leave one row, too.
    assert sorted(r["doc_id"] for r in single if not (r["text"] or "").split()) == [4]
    assert len({r["text"] for r in single}) == len(single)


def test_stages_of_no_documents(spark, sf_dir, no_rows):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, no_rows, sf_dir).count() == 0, name
