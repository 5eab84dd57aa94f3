"""Token ids in bit-plane shuffled chunks.

Documents are sorted by identifier and encoded; their ids form one long stream. It is cut into
segments of whole documents, and each segment into chunks of a fixed number of ids. A chunk is
transposed into planes - its lowest bytes, then the next ones, or single bits - and every plane is
compressed alone with zstandard. An index has the place and sizes of each chunk, so that any stretch
of the stream can be read without the rest. A segment's chunks, their index
and that of its documents are a row of a table that Spark writes and reads, so the files may lie in
any store it knows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from auditflow.llm._store import new_folder

CHUNK_IDS = 1 << 16
SEGMENT_IDS = 1 << 20
#: Characters of texts that are cut into pieces together.
STRETCH = 1 << 21
#: Entries of a generation of the table from a piece to its ids; a task holds two.
CACHED_WORDS = 400_000


def shuffle_planes(ids: np.ndarray, *, bits: bool = False) -> list[bytes]:
    """The planes of a chunk, lowest first, each compressed."""
    raw = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    planes = np.unpackbits(raw, axis=1, bitorder="little").T if bits else raw.T
    pack = zstandard.ZstdCompressor(level=1)
    return [pack.compress((np.packbits(p, bitorder="little") if bits else np.ascontiguousarray(p)).tobytes()) for p in planes]


def unshuffle_planes(planes: list[bytes], n: int) -> np.ndarray:
    """The ids of a chunk, from 4 byte planes or 32 bit planes."""
    unpack = zstandard.ZstdDecompressor()
    if len(planes) == 4:
        raw = np.stack([np.frombuffer(unpack.decompress(p), np.uint8) for p in planes], axis=1)
    else:
        each = [np.unpackbits(np.frombuffer(unpack.decompress(p), np.uint8), count=n, bitorder="little") for p in planes]
        raw = np.packbits(np.stack(each, axis=1), axis=1, bitorder="little")
    return np.ascontiguousarray(raw).view("<u4").reshape(-1)


def _tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks side by side
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


#: Texts whose pieces can be told without the library: printable ASCII and Latin letters that
#: normalise and lower-case one by one, and blanks. Special tokens are left to the library.
_PLAIN = re.compile(r"[ \t\n\r!-~À-ÖØ-öø-ÿ]*")
#: Fixed value: how the vocabulary splits such a text, lower-cased, before merging.
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-z0-9ß-öø-ÿ]+")


#: Kinds of bytes of a plain text, lower-cased: blanks, letters (all beyond ASCII, too), digits, signs.
_KINDS = np.full(256, 3, np.uint8)
_KINDS[[9, 10, 13, 32]], _KINDS[97:123], _KINDS[128:], _KINDS[48:58] = 0, 1, 1, 2
#: Bytes of a piece that are compared as numbers, eight at a time.
_LANES = 4
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def _is_plain(text: str) -> bool:
    return _PLAIN.fullmatch(text) is not None and "<|" not in text


def _stretches(text: str) -> Iterator[str]:
    """A text in stretches, cut at blanks."""
    at = 0
    while len(text) - at > STRETCH:
        cut = text.rfind(" ", at + 1, at + STRETCH)
        if cut < 0:
            break
        yield text[at:cut]
        at = cut
    yield text[at:] if at else text


def _pieces_of(texts: list[bytes]) -> tuple[list[str], np.ndarray, np.ndarray] | None:
    """The different pieces of plain texts without apostrophes, which one stands where, and the text of each place.

    Pieces are told apart by all their bytes, taken as numbers. None if a piece has too many.
    """
    data = b"\n".join(texts)
    codes = np.frombuffer(data, np.uint8)
    kinds = _KINDS[codes]
    new = np.ones(len(kinds), bool)
    new[1:] = (kinds[1:] != kinds[:-1]) | (kinds[1:] == 2)
    last = np.ones(len(kinds), bool)
    last[:-1] = new[1:]
    starts, ends = np.flatnonzero(new & (kinds > 0)), np.flatnonzero(last & (kinds > 0)) + 1
    sizes = ends - starts
    if not len(starts) or sizes.max() > 8 * _LANES:
        return None if len(starts) else ([], starts, starts)
    padded = np.concatenate((codes, np.zeros(8 * _LANES + 8, np.uint8)))
    eight = np.ndarray(len(codes) + 8 * _LANES, "<u8", padded, strides=(1,))  # the number at every byte
    lanes = [eight[starts] & _MASKS[np.minimum(sizes, 8)]]
    mixed = lanes[0] * np.uint64(0x9E3779B97F4A7C15)
    for lane in range(1, (int(sizes.max()) + 7) // 8):
        lanes.append(eight[starts + 8 * lane] & _MASKS[np.clip(sizes - 8 * lane, 0, 8)])
        mixed = (mixed ^ (mixed >> np.uint64(31)) ^ lanes[-1]) * np.uint64(0xBF58476D1CE4E5B9)
    _, first, which = np.unique(mixed, return_index=True, return_inverse=True)
    if any((lane != lane[first][which]).any() for lane in lanes):
        return None  # different pieces were mixed to one number
    words = [data[a:z].decode() for a, z in zip(starts[first].tolist(), ends[first].tolist())]
    behind = np.cumsum([len(t) + 1 for t in texts])
    return words, which, np.searchsorted(behind, starts, "right")


class _Known:
    """Ids by word in two generations: what was not met since the last change is forgotten, the rest stays."""

    def __init__(self, size: int):
        self.size, self.young, self.old = size, {}, {}

    def grow_old(self) -> None:
        if len(self.young) > self.size:
            self.young, self.old = {}, self.young

    def missing(self, words: set[str]) -> list[str]:
        """Words that have no ids yet; those of the older generation come over."""
        old, out = self.old, []
        for word in words.difference(self.young):
            ids = old.get(word)
            if ids is None:
                out.append(word)
            else:
                self.young[word] = ids
        return out


class Encoder:
    """Ids of texts, as little-endian 32-bit numbers.

    The vocabulary drops white space and merges inside pieces (words, digits, signs) only, so the
    ids of a text are those of its pieces, one after the other, and each piece is encoded once. New
    pieces of many texts are encoded together and told apart by the tokens that end one. Plain texts
    are cut into pieces as arrays of bytes; those with an apostrophe, which begins pieces of its own,
    by a pattern. A text with other characters is cut at ASCII blanks, and its parts that have them
    are encoded whole.
    """

    def __init__(self, path: str):
        self.tokenizer, self.pieces, self.parts = _tokenizer(path), _Known(CACHED_WORDS), _Known(CACHED_WORDS // 10)
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def _alone(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: list[str]) -> None:
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(new)], add_special_tokens=False)[0].ids, "<u4")
        ends = np.flatnonzero(self.ends_word[ids]) + 1
        if len(ends) == len(new) and ends[-1] == len(ids):
            cuts, data = (ends * 4).tolist(), ids.tobytes()
            coded = [data[a:z] for a, z in zip([0, *cuts], cuts)]
        else:
            coded = self._alone(new)
        self.pieces.young.update(zip(new, coded, strict=True))

    def _odd(self, text: str) -> list[str | tuple[str]]:
        """Pieces of a text with other characters; a part that has them is a tuple."""
        out: list[str | tuple[str]] = []
        for part in text.replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" "):
            if _is_plain(part):
                out += _PIECES.findall(part.lower())
            else:
                out.append((part,))
        return out

    def _ids_of(self, words: set[str]) -> dict[str, bytes]:
        if new := self.pieces.missing(words):
            self._learn(new)
        return self.pieces.young

    def _plain(self, texts: list[str]) -> list[bytes]:
        """Ids of plain texts."""
        found = _pieces_of([t.lower().encode() for t in texts])
        if found is None:
            return self._others(texts) if len(texts) == 1 else [x for t in texts for x in self._plain([t])]
        words, which, text_of = found
        known = self._ids_of(set(words))
        coded = [known[w] for w in words]
        ids, sizes = np.frombuffer(b"".join(coded), "<u4"), np.fromiter(map(len, coded), np.int64, len(coded)) // 4
        begins = np.cumsum(sizes) - sizes
        n = sizes[which]
        upto = np.cumsum(n)
        out = ids[np.repeat(begins[which] - upto + n, n) + np.arange(n.sum())].tobytes()
        cuts = np.concatenate(([0], upto))[np.searchsorted(text_of, np.arange(len(texts) + 1))] * 4
        return [out[a:z] for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist())]

    def _others(self, texts: list[str]) -> list[bytes]:
        """Ids of any texts."""
        split = [_PIECES.findall(t.lower()) if _is_plain(t) else self._odd(t) for t in texts]
        words = set().union(*split)
        odd = {x for x in words if isinstance(x, tuple)}
        words -= odd
        known = self._ids_of(words)
        if odd:
            if rest := self.parts.missing({x[0] for x in odd}):
                self.parts.young.update(zip(rest, self._alone(rest), strict=True))
            known = {**{w: known[w] for w in words}, **{x: self.parts.young[x[0]] for x in odd}}
        return [b"".join(map(known.__getitem__, pieces)) for pieces in split]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        out: list[list[bytes]] = [[] for _ in texts]
        plain: list[tuple[int, str]] = []

        def flush() -> None:
            self.pieces.grow_old()
            for (i, _), ids in zip(plain, self._plain([t for _, t in plain]), strict=True):
                out[i].append(ids)
            plain.clear()

        size = 0
        for i, text in enumerate(texts):
            if not text:
                continue
            if "'" in text or not _is_plain(text):
                self.pieces.grow_old()
                self.parts.grow_old()
                out[i] = self._others([text])
                continue
            for stretch in _stretches(text):
                plain.append((i, stretch))
                size += len(stretch)
                if size >= STRETCH:
                    flush()
                    size = 0
        if plain:
            flush()
        return [b"".join(ids) for ids in out]


@lru_cache(maxsize=2)
def _encoder(path: str) -> Encoder:
    """One for all tasks of a worker."""
    return Encoder(path)


_ROW = (
    "part int, segment int, n_ids long, chunks array<array<binary>>, chunk_ids array<long>, plane_bytes array<array<long>>, "
    "doc_id array<long>, start array<long>, n_tokens array<long>"
)
_NAMES = ["part", "segment", "n_ids", "chunks", "chunk_ids", "plane_bytes", "doc_id", "start", "n_tokens"]


def _segment_row(part: int, segment: int, data: list[bytes], ids: list[int | None], bits: bool) -> pa.RecordBatch:
    """The row of a segment: its chunks, their index (ids and bytes of each plane), and its documents."""
    stream = np.frombuffer(b"".join(data), "<u4")
    sizes = np.array([len(d) // 4 for d in data], np.int64)
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    cuts = range(0, len(stream), CHUNK_IDS)
    chunks = [shuffle_planes(stream[a : a + CHUNK_IDS], bits=bits) for a in cuts]
    columns = [
        part, segment, len(stream), chunks, [min(CHUNK_IDS, len(stream) - a) for a in cuts], [[len(p) for p in c] for c in chunks],
        ids, starts.tolist(), sizes.tolist(),
    ]
    longs = pa.list_(pa.int64())
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.list_(pa.binary())), longs, pa.list_(longs), longs, longs, longs]
    return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(columns, kinds, strict=True)], names=_NAMES)


def write_tokens(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, bits: bool = False) -> str:
    """Encode all texts in ascending order of identifier and write them; returns the folder.

    ``end_id`` follows each document. A null text has the end id only. Rows without an identifier
    come first; rows that repeat one keep their own ids, in order of their texts. Other columns
    aren't read; an empty table writes empty files.
    """
    spark = docs.sparkSession
    folder = new_folder(spark, "token-ids")
    end = np.array([end_id], "<u4").tobytes()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, segment, encoder = TaskContext.get().partitionId(), 0, _encoder(tokenizer_path)
        data, ids, total = [], [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                some = batch.slice(at, 1000)
                for doc_id, coded in zip(some.column(0).to_pylist(), encoder.encode(some.column(1).to_pylist()), strict=True):
                    data.append(coded + end)
                    ids.append(doc_id)
                    total += len(data[-1]) // 4
                    if total >= SEGMENT_IDS:
                        yield _segment_row(part, segment, data, ids, bits)
                        data, ids, total, segment = [], [], 0, segment + 1
        if data:
            yield _segment_row(part, segment, data, ids, bits)

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # Ranges of (identifier, hash of the text): rows of one identifier can be parted, too.
    ranged = texts.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    ranged.mapInArrow(rows, _ROW).write.parquet(folder)
    return folder


def _segments(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(_ROW).parquet(folder)


def segment_starts(spark: SparkSession, folder: str) -> DataFrame:
    """(part, segment, before): ids of the stream before each segment.

    Sums by part first, so that only one row per part meets in a single task.
    """
    sizes = _segments(spark, folder).select("part", "segment", F.col("n_ids").alias("n"))
    earlier = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("n").alias("n"))
    parts = parts.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("parts_before"))
    inside = W.partitionBy("part").orderBy("segment").rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    return sizes.join(parts, "part").select("part", "segment", (F.col("parts_before") + F.col("inside")).alias("before"))


def _decoded(row: dict) -> np.ndarray:
    return np.concatenate([unshuffle_planes(c, n) for c, n in zip(row["chunks"], row["chunk_ids"], strict=True)])


def _each_document(make, kind: pa.DataType, last: str):
    """Rows (part, segment, doc_id, start, n_tokens, ``last``), the last one made from the document's ids."""
    names = ["part", "segment", "doc_id", "start", "n_tokens", last]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                stream, k = _decoded(row), len(row["doc_id"])
                made = [make(stream[a : a + n].astype("<u4").tobytes()) for a, n in zip(row["start"], row["n_tokens"], strict=True)]
                columns = ([row["part"]] * k, [row["segment"]] * k, row["doc_id"], row["start"], row["n_tokens"], made)
                kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), kind)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    return rows


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """(part, segment, doc_id, start, n_tokens, ids) of every document; ids are little-endian 32-bit, start counts inside the segment."""
    schema = "part int, segment int, doc_id long, start long, n_tokens long, ids binary"
    return _segments(spark, folder).mapInArrow(_each_document(bytes, pa.binary(), "ids"), schema)


def read_stretch(spark: SparkSession, folder: str, part: int, segment: int, start: int, n: int) -> np.ndarray:
    """``n`` ids of a segment from ``start`` on; decompresses only the chunks that hold them."""
    first, last = start // CHUNK_IDS, (start + n - 1) // CHUNK_IDS
    row = _segments(spark, folder).where((F.col("part") == part) & (F.col("segment") == segment))
    chunks, sizes = row.select(F.slice("chunks", first + 1, last - first + 1), F.slice("chunk_ids", first + 1, last - first + 1)).first()
    stream = np.concatenate([unshuffle_planes([bytes(p) for p in c], k) for c, k in zip(chunks, sizes, strict=True)])
    return stream[start - first * CHUNK_IDS :][:n]


def token_index(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files read back."""
    schema = "part int, segment int, doc_id long, start long, n_tokens long, ids_crc32 long"
    found = _segments(spark, folder).mapInArrow(_each_document(zlib.crc32, pa.int64(), "ids_crc32"), schema)
    joined = found.join(segment_starts(spark, folder), ["part", "segment"])
    return joined.select("doc_id", (F.col("before") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")
