"""Benchmark decontamination with a distributed positional inverted index.

The training texts are cut into blocks of documents. A block has one row for each word that some
test item contains: the places where it stands, counted through the block. The index is a table in
the shared folder. A phrase goes to the blocks that have its rarest word. There the lists of its
words, each moved back by the word's offset, are intersected from the rarest on, which leaves the
places where the phrase begins; with a slop, words may stand so many places off.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from auditflow.llm._store import keep

WINDOW = 13
#: Words of a block, about; a task holds the lists of one block.
BLOCK_WORDS = 500_000
#: Bits of the filter of test words that every task holds: 1 MiB, however many words there are.
FILTER_BITS = 1 << 23
_WORD_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)


def words_of(text: bytes | None) -> list[bytes]:
    """Runs of ASCII digits, letters (A-Z lowered) and whatever lies beyond ASCII."""
    return (text or b"").translate(_WORD_BYTES).split()


def phrases_of(items: DataFrame, window: int) -> DataFrame:
    """(phrase, words array, item_ids) of every different window of the items; item_ids are sorted texts."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, phrases = [], []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
                words = words_of(text.as_py())
                size = min(window, len(words))
                for start in range(len(words) - size + 1 if words and item is not None else 0):
                    ids.append(item)
                    phrases.append(b" ".join(words[start : start + size]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(phrases, pa.binary())], names=["item_id", "words"])

    found = items.mapInArrow(rows, "item_id string, words binary").distinct()
    return found.select("item_id", F.decode("words", "UTF-8").alias("phrase"))


def word_filter(phrases: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """A bit for the CRC of each test word; a bounded array, however many words there are."""
    word = F.explode(F.split("phrase", " "))
    marks = phrases.select(word.alias("w")).select((F.crc32(F.encode("w", "UTF-8")) % bits).alias("bit")).distinct()
    packed = marks.groupBy((F.col("bit") / 64).cast("int").alias("i")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("bit") % 64).cast("int"))).alias("w"))
    out = np.zeros(bits // 64, np.int64)
    for row in packed.toLocalIterator():  # at most bits / 64 rows
        out[row["i"]] = row["w"]
    return np.unpackbits(out.view(np.uint8), bitorder="little").astype(bool)


class _Vocabulary(dict):
    """Numbers of the words that the filter lets through; 0 for the others."""

    def __init__(self, allowed: np.ndarray):
        self.allowed, self.words = allowed, [b""]

    def __missing__(self, word: bytes) -> int:
        number = 0
        if self.allowed[zlib.crc32(word) % len(self.allowed)]:
            number = len(self.words)
            self.words.append(word)
        self[word] = number
        return number


def build_index(docs: DataFrame, allowed: np.ndarray, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(block, word, n, places, ids, starts, sizes): postings of each block, and one row without word with its documents.

    Places are int32 counted through the block; a gap behind each document keeps phrases inside it.
    """
    names = ["block", "word", "n", "places", "ids", "starts", "sizes"]
    schema = "block long, word binary, n long, places binary, ids array<long>, starts binary, sizes binary"

    def flush(block: int, docs: list[tuple[int | None, np.ndarray]], vocabulary: _Vocabulary) -> pa.RecordBatch:
        sizes = np.array([len(d) for _, d in docs], np.int32)
        starts = np.concatenate(([0], np.cumsum(sizes + GAP)[:-1])).astype(np.int32)
        codes = np.concatenate([d for _, d in docs])
        places = np.arange(len(codes), dtype=np.int32) + np.repeat(np.arange(len(docs), dtype=np.int32) * GAP, sizes)
        some = np.flatnonzero(codes)
        order = some[np.argsort(codes[some], kind="stable")]
        numbers, first = np.unique(codes[order], return_index=True)
        lists = np.split(places[order].astype("<i4"), first[1:]) if len(numbers) else []
        k = len(lists)
        columns = [
            [block] * (k + 1), [vocabulary.words[i] for i in numbers.tolist()] + [None], [len(x) for x in lists] + [len(docs)],
            [x.tobytes() for x in lists] + [None], [None] * k + [[i for i, _ in docs]], [None] * k + [starts.astype("<i4").tobytes()],
            [None] * k + [sizes.astype("<i4").tobytes()],
        ]
        kinds = [pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32  # the index is written once, so the numbers stay
        vocabulary, docs, total = _Vocabulary(allowed), [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
                words = words_of(text.as_py())
                docs.append((doc_id, np.fromiter(map(vocabulary.__getitem__, words), np.int32, len(words))))
                total += len(words) + GAP
                if total >= block_words:
                    yield flush(block, docs, vocabulary)
                    block, docs, total = block + 1, [], 0
                    if len(vocabulary) > 500_000:
                        vocabulary = _Vocabulary(allowed)
        if docs:
            yield flush(block, docs, vocabulary)

    return docs.mapInArrow(rows, schema)


#: Places left free behind each document; more than any phrase and slop.
GAP = 64


def _from_rarest(lists: dict[str, np.ndarray], words: list[str]) -> list[int]:
    """Places of a phrase's words, that of the rarest first."""
    return sorted(range(len(words)), key=lambda i: (len(lists[words[i]]), i))


def intersect(lists: dict[str, np.ndarray], words: list[str], slop: int = 0) -> np.ndarray:
    """Places where a phrase begins: its words' lists moved back by their offsets, met from the rarest on.

    With a slop a place is where the phrase would begin, seen from its rarest word.
    """
    order = _from_rarest(lists, words)
    starts = lists[words[order[0]]] - order[0]
    for i in order[1:]:
        if not len(starts):
            break
        there = lists[words[i]]
        at = np.searchsorted(there, starts + (i - slop))
        near = at < len(there)
        near[near] = there[at[near]] <= starts[near] + (i + slop)
        starts = starts[near]
    return starts


def _places(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<i4").astype(np.int64)


class _Block:
    """The documents of a block, and where the asked phrases stand in them."""

    def __init__(self, index: pa.Table, asked: pa.Table):
        self.lists: dict[str, np.ndarray] = {}
        for row in index.to_pylist():
            if row["word"] is None:
                self.ids, self.starts, self.sizes = row["ids"], _places(row["starts"]), _places(row["sizes"])
            else:
                self.lists[row["word"].decode()] = _places(row["places"])
        self.asked = zip(asked["phrase"].to_pylist(), asked["item_ids"].to_pylist())

    def matches(self, slop: int) -> Iterator[tuple[list[str], int, bool, np.ndarray, np.ndarray]]:
        """Items, number of words, whether exact, numbers of the documents and starts inside them, of each phrase found.

        The document is that of the rarest word: a near phrase may seem to begin before it.
        """
        for phrase, item_ids in self.asked:
            words = phrase.split(" ")
            if all(w in self.lists for w in words):
                exact = intersect(self.lists, words)
                rarest = _from_rarest(self.lists, words)[0]
                near = np.setdiff1d(intersect(self.lists, words, slop), exact, assume_unique=True) if slop else exact[:0]
                for found, whole in ((exact, True), (near, False)):
                    if len(found):
                        docs = np.searchsorted(self.starts, found + rarest, "right") - 1
                        yield item_ids, len(words), whole, docs, np.maximum(found - self.starts[docs], 0)


def _search(slop: int):
    def rows(index: pa.Table, asked: pa.Table) -> pa.Table:
        """What is found in each document of a block."""
        out: list[list] = [[] for _ in range(5)]
        if index.num_rows:
            block = _Block(index, asked)
            hits: list[list[tuple[int, int]]] = [[] for _ in block.ids]
            items: list[set[str]] = [set() for _ in block.ids]
            near: list[set[str]] = [set() for _ in block.ids]
            for item_ids, n, exact, docs, starts in block.matches(slop):
                for doc, start in zip(docs.tolist(), starts.tolist()):
                    (items if exact else near)[doc].update(item_ids)
                    if exact:
                        hits[doc].append((start, n))
            for doc, doc_id in enumerate(block.ids):
                cover = np.zeros(int(block.sizes[doc]) + 1, np.int32)
                for start, n in hits[doc]:
                    cover[start] += 1
                    cover[start + n] -= 1
                n_hit = int((np.cumsum(cover[:-1]) > 0).sum()) if hits[doc] else 0
                for values, value in zip(out, (doc_id, int(block.sizes[doc]), n_hit, sorted(items[doc]), len(near[doc] - items[doc]))):
                    values.append(value)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.int64()]
        names = ["doc_id", "n_words", "n_hit", "item_ids", "n_near_items"]
        return pa.table({n: pa.array(v, t) for n, v, t in zip(names, out, kinds)})

    return rows


def _matches(slop: int):
    def rows(index: pa.Table, asked: pa.Table) -> pa.Table:
        """Every match in a block."""
        out: list[list] = [[] for _ in range(5)]
        block = _Block(index, asked) if index.num_rows else None
        for item_ids, n, exact, docs, starts in block.matches(slop) if block else ():
            for doc, start in zip(docs.tolist(), starts.tolist()):
                for item in item_ids:
                    for values, value in zip(out, (block.ids[doc], item, start, n, exact)):
                        values.append(value)
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.bool_()]
        return pa.table({n: pa.array(v, t) for n, v, t in zip(["doc_id", "item_id", "start", "n", "exact"], out, kinds)})

    return rows


def _asked_blocks(docs: DataFrame, items: DataFrame, window: int, slop: int, block_words: int) -> tuple[DataFrame, DataFrame]:
    """The index of ``docs`` (id, text), and (block, phrase, item_ids): the blocks that have a phrase's rarest word."""
    if window + slop >= GAP:
        raise ValueError(f"window and slop must stay below {GAP} together")
    pairs = keep(phrases_of(items, window), "phrases")
    index = keep(build_index(docs, word_filter(pairs), block_words), "postings")

    # The rarest word of each phrase, by its count in all documents.
    postings = index.where("word is not null").select("block", F.decode("word", "UTF-8").alias("w"), "n")
    counts = keep(postings.groupBy("w").agg(F.sum("n").alias("n")), "word-counts")
    phrases = pairs.groupBy("phrase").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"))
    each = phrases.select("phrase", F.explode(F.array_distinct(F.split("phrase", " "))).alias("w"))
    counted = each.join(counts, "w", "left").groupBy("phrase").agg(
        F.min(F.struct("n", "w")).alias("rarest"), F.count(F.when(F.col("n").isNull(), 1)).alias("absent")
    )
    seeds = keep(counted.where("absent = 0").select("phrase", F.col("rarest.w").alias("w")), "rarest-words")
    return index, keep(seeds.join(postings.select("w", "block"), "w").select("block", "phrase"), "asked-blocks").join(phrases, "phrase")


def _named(docs: DataFrame, items: DataFrame, id_col: str, text_col: str, item_col: str, item_text_col: str) -> tuple[DataFrame, DataFrame]:
    docs = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    return docs, items.select(F.col(item_col).cast("string"), F.col(item_text_col).cast("string"))


def matches(
    docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    window: int = WINDOW, slop: int = 0, block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """(doc_id, item_id, start, n, exact) of every place where a phrase of an item stands in a row of ``docs``.

    ``start`` counts words from 0 and ``n`` is the phrase's number of words. A near match
    (``exact`` false) has its words within ``slop`` places of where they should be, seen from the
    rarest one; its start is where the phrase would begin, 0 at least. Phrases, nulls and empty
    tables are as for ``search``; rows that repeat an identifier list their own matches.
    """
    docs, items = _named(docs, items, id_col, text_col, item_col, item_text_col)
    index, asked = _asked_blocks(docs, items, window, slop, block_words)
    schema = "doc_id long, item_id string, start long, n long, exact boolean"
    return index.groupBy("block").cogroup(asked.groupBy("block")).applyInArrow(_matches(slop), schema)


def search(
    docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    window: int = WINDOW, slop: int = 0, block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """doc_id, n_words, n_hit, item_ids and n_near_items of every row of ``docs``.

    A phrase is ``window`` consecutive words of an item, or all words of a shorter one. ``n_hit``
    counts the words inside any occurrence, ``item_ids`` lists (as sorted texts) the items that
    have one, and ``n_near_items`` counts further items with a phrase whose words all stand within
    ``slop`` places of where they should. Null and empty texts have no words; items without words
    or identifier have no phrases. Repeated rows and identifiers keep their rows. Only the named
    columns are read; with no documents the result is empty, with no items nothing is hit.
    """
    docs, items = _named(docs, items, id_col, text_col, item_col, item_text_col)
    index, asked = _asked_blocks(docs, items, window, slop, block_words)
    schema = "doc_id long, n_words long, n_hit long, item_ids array<string>, n_near_items long"
    return index.groupBy("block").cogroup(asked.groupBy("block")).applyInArrow(_search(slop), schema)


def contaminated(n_hit, n_words):
    """At least a twentieth of the words are hit."""
    return (n_hit > 0) & (20 * n_hit >= n_words)
