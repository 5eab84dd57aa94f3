"""SimHash near-duplicates with covering locality-sensitive hashing.

Fingerprints of 64 bits are cut by bit masks. Bit ``i`` carries a fixed non-zero vector ``m(i)`` of
radius + 1 bits, and the mask of a vector ``v`` has the bits whose ``m(i)`` has an odd number of
ones in common with ``v``. The vectors of at most ``radius`` differing bits cannot span all
radius + 1 dimensions, so some ``v`` is orthogonal to all of them: its mask leaves these bits out,
and in its table the pair collides. No pair within the radius is missed.

Inside a bucket no pairs are listed. Two fingerprints differ in at most two bits exactly if a value
lies within one bit of both, so each fingerprint that shares a bucket is joined to its neighbours
by one flipped bit, and those that meet at a value are linked. That is linear in the bucket's size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from auditflow.llm._components import components
from auditflow.llm._store import keep

RADIUS = 2
SEED = 42


def covering_masks(radius: int = RADIUS, bits: int = 64) -> list[int]:
    """2^(radius+1) - 1 masks; every mask keeps more than half of the bits."""
    vectors = range(1, 2 ** (radius + 1))
    carried = [i % len(vectors) + 1 for i in range(bits)]
    return [sum(1 << i for i, m in enumerate(carried) if (m & v).bit_count() % 2) for v in vectors]


def fingerprint(text: bytes | None, shingle: int = 3) -> int:
    """SimHash of the word shingles of an UTF-8 text, as an unsigned number."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    size = min(shingle, len(words))
    starts = np.concatenate(([0], ends[: len(words) - size] + 1)).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[size - 1 :].tolist(), strict=True)], "<u8")
    counts = np.zeros(64, np.int64)
    for part in range(0, len(hashes), 1 << 16):  # bounded memory for very long texts
        block = hashes[part : part + (1 << 16)].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fp) per row; fp is the fingerprint's bits as a signed long. Null texts have 0."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            values = np.array([fingerprint(t.as_py(), shingle) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values)], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(rows, "doc_id long, fp long")


def _signed(value: int) -> int:
    return value - 2**64 if value >= 2**63 else value


def links(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (u, v) whose components are those of all pairs of ``nodes`` (fp, node) within two bits.

    ``fp`` doesn't repeat. Rows grow with the fingerprints that share a bucket, at most 65 for each.
    """
    if radius != RADIUS:
        raise ValueError("one flipped bit on either side reaches pairs of two bits")
    masks = covering_masks(radius)
    places = F.array(*(F.struct(F.lit(t).alias("table"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for t, m in enumerate(masks)))
    tables = nodes.select("fp", F.explode(places).alias("p")).select("fp", "p.table", "p.key")
    shared = tables.groupBy("table", "key").agg(F.min("fp").alias("a"), F.max("fp").alias("b")).where("a != b").select("table", "key")
    shared = keep(shared, "simhash-buckets")
    left_out = F.element_at(F.array(*(F.lit(_signed(~m & (2**64 - 1))) for m in masks)), F.col("table") + 1)
    # The bits in which a fingerprint may differ from one that shares a bucket.
    free = tables.join(shared, ["table", "key"]).select("fp", left_out.alias("bits")).groupBy("fp").agg(F.bit_or("bits").alias("bits"))
    candidates = nodes.join(keep(free, "simhash-candidates"), "fp")
    bits = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda b: F.call_function("shiftright", F.col("bits"), b).bitwiseAND(F.lit(1)) == 1)
    flipped = F.transform(bits, lambda b: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), b)))
    met = candidates.select("node", F.explode(F.concat(F.array("fp"), flipped)).alias("z"))
    # At most 65 different fingerprints lie within one bit of a value, so the set is bounded.
    groups = met.groupBy("z").agg(F.min("node").alias("u"), F.collect_set("node").alias("vs")).where(F.size("vs") > 1)
    return groups.select("u", F.explode("vs").alias("v")).where("u != v").distinct()


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row.

    Two rows are linked when their fingerprints differ in at most two bits; component_id is the
    smallest identifier reachable. Null, empty and blank texts have fingerprint zero and are linked
    like any other. A row without an identifier joins its component, but gives it no name: where a
    whole component has no identifier, component_id is null. Repeated identifiers keep their rows.
    Only the two columns named are read; an empty table gives an empty one.
    """
    prints = keep(fingerprints(docs, id_col=id_col, text_col=text_col, shingle=shingle), "simhash-fingerprints")
    # Fingerprints stand for themselves in the graph, so that rows without an identifier count.
    distinct = keep(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    edges = links(distinct.select("fp", F.col("fp").alias("node")))
    found = components(edges)
    joined = distinct.join(found, distinct.fp == found.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    joined = keep(joined, "simhash-roots")
    names = keep(joined.groupBy("root").agg(F.min("least").alias("component_id")), "simhash-names")
    named = keep(joined.join(names, "root").select("fp", "component_id"), "simhash-named")
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
