"""Substring dedup with repeated-phrase automata.

A window is a fixed number of consecutive words. Each window has an anchor, the word n-gram of
least hash inside it, so equal windows have equal anchors, and neighbouring windows mostly share
one. The windows that share an anchor's place form a block.

1. Census: anchors and block digests of every document; anchors of a single document can't repeat.
2. Confirm: a block whose digest a document with a smaller identifier has is a recurring passage.
   Where an anchor stands in several different blocks, the windows of one copy of each block are
   digested one by one, since equal windows may lie in unequal blocks. Digests have 128 bits
   (BLAKE2b over the words).
3. Automata: documents are dealt into shards of bounded size. Each shard compiles one Aho-Corasick
   automaton of the passages its documents have, each with the least identifier that has it, and
   streams all its documents through it to locate every occurrence.

A window of a document that a smaller document also has lies in a block of its own document. If
that block repeats a smaller one, the whole block is such a passage. If not, its windows are among
those digested, and so is a copy of every other block of the anchor. Further copies of a digested
block in the rows of the same identifier get the passages found in it. So none is missed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from auditflow.llm._store import keep

WINDOW = 50
ANCHOR = 20
#: UTF-8 bytes of a shard's texts, about; a task holds the texts of one shard.
SHARD_BYTES = 4 << 20
#: Copies of a row that are numbered at a time.
COPY_BLOCK = 100_000
#: Texts that are hashed at a time.
PIECE_BYTES = 1 << 18
#: Words of a stretch of merged passages; the automaton's C code walks a key's letters recursively.
STRETCH_WORDS = 10_000
#: Code points that stand for words: all beyond the basic plane.
LETTERS = range(0x10000, 0x110000)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class _Powers:
    """Powers of a base modulo 2^64, as many as the longest piece so far needs."""

    def __init__(self, base: int):
        self.base, self.values = base, np.ones(1, np.uint64)

    def upto(self, n: int) -> np.ndarray:
        if len(self.values) < n:
            powers = np.full(max(n, 2 * len(self.values)), self.base, np.uint64)
            powers[0] = 1
            self.values = np.multiply.accumulate(powers)
        return self.values[:n]


class Blocks:
    """Anchors and blocks of texts, many texts at a time."""

    def __init__(self, window: int, anchor: int):
        self.window, self.anchor = window, anchor
        self.up, self.down = _Powers(_BASE), _Powers(_INVERSE)

    def of(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes], np.ndarray, np.ndarray]:
        """Number of the text, anchor hash, digest, first word and number of words of every block."""
        joined = [b" ".join(t.split()) for t in texts]
        numbers = [i for i, t in enumerate(joined) if t]
        data = b" ".join([joined[i] for i in numbers])
        codes = np.frombuffer(data, np.uint8)
        blanks = np.flatnonzero(codes == 32)
        starts, ends = np.concatenate(([0], blanks + 1)), np.concatenate((blanks, [len(data)]))
        n, width = len(starts), self.window - self.anchor + 1
        if not data or n < self.window:
            none = np.zeros(0, np.int64)
            return none, none, [], none, none
        sizes = np.array([joined[i].count(b" ") + 1 for i in numbers])
        text_of, first_of = np.repeat(np.arange(len(numbers)), sizes), np.concatenate(([0], np.cumsum(sizes)[:-1]))

        # A rolling hash of the bytes of each n-gram of words.
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((codes + np.uint64(1)) * self.up.upto(len(data)))))
        begins = starts[: n - self.anchor + 1]
        value = _mixed((total[ends[self.anchor - 1 :]] - total[begins]) * self.down.upto(len(data))[begins])
        # The last n-gram of the least hash in each window: upper half the hash, lower half the place from behind.
        least = (value & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(value), 0, -1).astype(np.uint64)
        span = 1
        while span < width:
            step = min(span, width - span)
            least = np.minimum(least[step:], least[:-step])
            span += step
        at = len(value) - (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
        inside = np.flatnonzero(text_of[: len(at)] == text_of[self.window - 1 :])  # windows within one text
        if not len(inside):
            none = np.zeros(0, np.int64)
            return none, none, [], none, none
        change = np.concatenate(([0], np.flatnonzero(np.diff(at[inside])) + 1))
        first, words = inside[change], np.diff(np.concatenate((change, [len(inside)]))) + self.window - 1
        digests = [
            hashlib.blake2b(data[a:z], digest_size=16).digest() for a, z in zip(starts[first].tolist(), ends[first + words - 1].tolist(), strict=True)
        ]
        texts_at = text_of[first]
        return np.array(numbers)[texts_at], value[at[first]].view(np.int64), digests, first - first_of[texts_at], words


def _joined(words: list[bytes]) -> tuple[bytes, list[int]]:
    """The words joined by one space, and where each begins; the last entry is behind the end."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    return b" ".join(words), np.concatenate(([0], np.cumsum(sizes + 1))).tolist()


def _digest(joined: bytes, places: list[int], first: int, n: int) -> bytes:
    return hashlib.blake2b(joined[places[first] : places[first + n] - 1], digest_size=16).digest()


def census(docs: DataFrame, window: int, anchor: int) -> DataFrame:
    """(anchor, digest, doc_id, row_key, start, n) of every block of every document."""
    names = ["anchor", "digest", "doc_id", "row_key", "start", "n"]

    def found(blocks: Blocks, ids: list[int], keys: list[int], texts: list[bytes]) -> pa.RecordBatch:
        number, anchors, digests, first, n = blocks.of(texts)
        arrays = [
            pa.array(anchors, pa.int64()), pa.array(digests, pa.binary()), pa.array(np.array(ids, np.int64)[number], pa.int64()),
            pa.array(np.array(keys, np.int64)[number], pa.int64()), pa.array(first.astype(np.int32)), pa.array(n.astype(np.int32)),
        ]
        return pa.RecordBatch.from_arrays(arrays, names=names)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, ids, keys, texts, size = Blocks(window, anchor), [], [], [], 0
        for batch in batches:
            for doc_id, key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary())):
                text = text.as_py()
                if doc_id is None or not text:
                    continue
                ids.append(doc_id)
                keys.append(key)
                texts.append(text)
                size += len(text)
                if size >= PIECE_BYTES:
                    yield found(blocks, ids, keys, texts)
                    ids, keys, texts, size = [], [], [], 0
        if texts:
            yield found(blocks, ids, keys, texts)

    return docs.select("doc_id", "row_key", "text").mapInArrow(rows, "anchor long, digest binary, doc_id long, row_key long, start int, n int")


def _windows(window: int):
    """Digests of all windows of the asked stretches, from the texts of a shard."""

    def rows(docs: pa.Table, asked: pa.Table) -> pa.Table:
        digests, ids, keys, starts, offsets = [], [], [], [], []
        if asked.num_rows:
            wanted: dict[int, list[tuple[int, int]]] = {}
            for key, start, n in zip(asked["row_key"].to_pylist(), asked["start"].to_pylist(), asked["n"].to_pylist()):
                wanted.setdefault(key, []).append((start, n))
            for doc_id, key, text in zip(docs["doc_id"].to_pylist(), docs["row_key"].to_pylist(), docs["text"].cast(pa.binary())):
                words = (text.as_py() or b"").split() if key in wanted else []
                joined, places = _joined(words) if words else (b"", [])
                for start, n in wanted.get(key, ()):
                    windows = n - window + 1
                    digests += [_digest(joined, places, first, window) for first in range(start, start + windows)]
                    ids += [doc_id] * windows
                    keys += [key] * windows
                    starts += [start] * windows
                    offsets += range(windows)
        columns = {"digest": pa.array(digests, pa.binary()), "doc_id": pa.array(ids, pa.int64()), "row_key": pa.array(keys, pa.int64())}
        return pa.table(columns | {"start": pa.array(starts, pa.int32()), "offset": pa.array(offsets, pa.int32())})

    return rows


def _stretches(passages: Iterator[tuple[int, int, int, int]]) -> dict[int, list[tuple[int, int, int]]]:
    """By row: maximal stretches (start, end, owner) of its overlapping or adjoining passages (row key, start, n, owner).

    A text that has such a stretch has all passages in it, so it loses the whole of it if its
    identifier is larger than those of all their owners. None is longer than ``STRETCH_WORDS``,
    unless a passage is; a passage that would make it longer begins the next one.
    """
    out: dict[int, list[tuple[int, int, int]]] = {}
    for key, start, n, owner in sorted(passages):
        found = out.setdefault(key, [])
        if found and start <= found[-1][1] and start + n - found[-1][0] <= STRETCH_WORDS:
            first, end, most = found[-1]
            found[-1] = (first, max(end, start + n), max(most, owner))
        else:
            found.append((start, start + n, owner))
    return out


class _Letters(dict):
    """The letters of each passage word: one code point, or, for more words than there are, two each.

    Of two, the first is from the lower half of the code points and the second from the upper, so a
    match never begins inside a word.
    """

    def __init__(self, words: set[bytes], points: range = LETTERS):
        half = len(points) // 2
        self.width = 1 if len(words) <= len(points) else 2
        self.unknown = "\0" * self.width
        if self.width == 1:
            super().__init__(zip(words, map(chr, points)))
        elif len(words) <= half * half:
            super().__init__((w, chr(points[i // half]) + chr(points[half + i % half])) for i, w in enumerate(words))
        else:
            raise ValueError("more words than pairs of letters")


def _automaton(docs: list[tuple[int, list[bytes]]], passages: Iterator[tuple[int, int, int, int]], points: range = LETTERS):
    """The automaton of a shard's passages, and the letters of each of their words."""
    stretches = _stretches(passages)
    phrases = [(words[start:end], owner) for key, words in docs for start, end, owner in stretches.get(key, ())]
    letters = _Letters({w for phrase, _ in phrases for w in phrase}, points)
    owners: dict[str, int] = {}
    for phrase, owner in phrases:
        key = "".join([letters[w] for w in phrase])
        owners[key] = min(owner, owners.get(key, owner))
    machine = ahocorasick.Automaton()
    for key, owner in owners.items():
        machine.add_word(key, (len(key) // letters.width, owner))
    if owners:
        machine.make_automaton()
    return (machine if owners else None), letters


def _located(with_text: bool, points: range = LETTERS):
    """Stream the texts of a shard through the automaton of its passages, and take out what is covered."""

    def rows(docs: pa.Table, passages: pa.Table) -> pa.Table:
        split = [(i, (t.as_py() or b"").split()) for i, t in zip(docs["doc_id"].to_pylist(), docs["text"].cast(pa.binary()))]
        columns = (passages[c].to_pylist() for c in ("row_key", "start", "n", "owner"))
        machine, letters = _automaton([(k, w) for k, (_, w) in zip(docs["row_key"].to_pylist(), split)], zip(*columns), points)
        removed, hashes, texts = [], [], []
        for doc_id, words in split:
            kept = words
            if machine is not None and doc_id is not None and words:
                cover = None
                get, unknown, width = letters.get, letters.unknown, letters.width
                for end, (n, owner) in machine.iter("".join([get(w, unknown) for w in words])):
                    if owner < doc_id:
                        end //= width
                        cover = bytearray(len(words)) if cover is None else cover
                        cover[end - n + 1 : end + 1] = b"\1" * n
                if cover is not None:
                    kept = [w for w, c in zip(words, cover) if not c]
            removed.append(len(words) - len(kept))
            text = b" ".join(kept)
            hashes.append(hashlib.sha256(text).hexdigest())
            texts.append(text.decode() if with_text else None)
        out = {
            "doc_id": docs["doc_id"], "copies": docs["copies"], "n_words": pa.array([len(w) for _, w in split], pa.int64()),
            "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(hashes, pa.string()),
        }
        return pa.table(out | ({"kept_text": pa.array(texts, pa.string())} if with_text else {}))

    return rows


def remove_repeats(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, anchor: int = ANCHOR, shard_bytes: int = SHARD_BYTES,
    with_text: bool = True,
) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, ``with_text``, kept_text of every row.

    A word goes when a window of words that covers it also starts in a row with a smaller
    identifier, in the texts as given. Words are parted by ASCII blanks and unchanged. Null and
    empty texts have no words. Rows without an identifier neither lose words nor take any from
    others; rows that repeat an identifier don't count as smaller than each other, and keep their
    own passages. Only the two columns named are read; an empty table gives an empty one.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # Equal rows have equal results, so one of them with a count is enough; it has a key of its own.
    counted = docs.groupBy("doc_id", "text").agg(F.count(F.lit(1)).alias("copies"))
    docs = keep(counted.withColumn("row_key", F.monotonically_increasing_id()), "different-rows")
    blocks = keep(census(docs, window, anchor), "census")
    repeated = blocks.groupBy("anchor").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("anchor")
    found = keep(blocks.join(keep(repeated, "anchors"), "anchor"), "blocks")

    # One copy of each block: of the rows with the least identifier.
    least = found.groupBy("anchor", "digest").agg(F.min(F.struct("doc_id", "row_key", "start", "n")).alias("first"))
    least = keep(least.select("anchor", "digest", "first.*"), "least-blocks")
    owners = least.select("anchor", "digest", F.col("doc_id").alias("owner"))
    whole = found.join(owners, ["anchor", "digest"]).where("doc_id > owner").select("row_key", "start", "n", "owner")

    several = keep(least.groupBy("anchor").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("anchor"), "several-blocks")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-size // shard_bytes))
    dealt = F.pmod(F.xxhash64("row_key"), F.lit(shards))
    texts = docs.withColumn("shard", dealt).groupBy("shard")
    asked = keep(least.join(several, "anchor"), "asked-blocks")
    cut = asked.select("row_key", "start", "n").withColumn("shard", dealt).groupBy("shard")
    single = keep(texts.cogroup(cut).applyInArrow(_windows(window), "digest binary, doc_id long, row_key long, start int, offset int"), "windows")
    first = keep(
        single.groupBy("digest").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last")).where("owner < last").select("digest", "owner"),
        "least-windows",
    )
    parts = keep(single.join(first, "digest").where("doc_id > owner").select("row_key", "start", "offset", "owner"), "window-passages")
    # The same block elsewhere in the rows of that identifier has the same passages.
    copy = asked.select("anchor", "digest", F.col("doc_id").alias("least_id"), F.col("row_key").alias("least_row"), F.col("start").alias("least_start"))
    again = found.join(copy, ["anchor", "digest"]).where("doc_id = least_id and (row_key != least_row or start != least_start)")
    again = again.select("row_key", "start", "least_row", "least_start")
    others = again.alias("a").join(parts.alias("p"), F.expr("a.least_row = p.row_key and a.least_start = p.start"))
    others = others.select("a.row_key", "a.start", "p.offset", "p.owner")
    single_windows = parts.unionByName(others).select("row_key", (F.col("start") + F.col("offset")).alias("start"), F.lit(window).alias("n"), "owner")

    passages = whole.unionByName(single_windows).withColumn("shard", dealt).groupBy("shard")
    names = ["doc_id", "n_words", "n_removed", "kept_sha256", *(["kept_text"] if with_text else [])]
    schema = "doc_id long, copies long, n_words long, n_removed long, kept_sha256 string" + (", kept_text string" if with_text else "")
    located = texts.cogroup(passages).applyInArrow(_located(with_text), schema)
    # Every row again; in blocks, so that no array has all copies of a row.
    first = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"), F.lit(COPY_BLOCK).cast("long")))
    numbers = F.sequence(F.col("first"), F.least(F.col("copies"), F.col("first") + (COPY_BLOCK - 1)))
    return located.withColumn("first", first).withColumn("copy", F.explode(numbers)).select(names)
