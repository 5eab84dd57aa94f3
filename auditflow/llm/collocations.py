"""Phrase collocations, counted without loss in quotient filters.

1. Shards: texts are cut into words once. A shard of documents keeps its words as numbers of its
   own vocabulary, and counts them. Summed over all shards, words get one number for the whole
   corpus, per language; rare words get none, for no phrase with one is frequent enough.
2. A shard packs the numbers of every n-gram of frequent words into a fixed number of bits, mixes
   them by a permutation that can be undone, and counts them in a quotient filter: the highest bits
   are the quotient, all others the remainder, so nothing is lost and no two n-grams are confused.
   Entries are sorted, a quotient is stored as the length of its run only.
3. Filters of all shards are merged by ranges of quotients. The merge also tells each shard which of
   its n-grams are frequent, so that longer ones are counted only where both parts are.

The permutation spreads n-grams evenly, so a frequent word makes no range larger; a frequent n-gram
is one entry of a shard's filter.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from auditflow.llm._store import keep

#: Words of a shard, about; a shard holds whole documents.
SHARD_WORDS = 1 << 20
#: Entries, about, that one task merges.
RANGE_ENTRIES = 1 << 21
QUOTIENT_BITS = 16
REMAINDER_BITS = 64 - QUOTIENT_BITS
LEAST_COUNT = 10
#: Phrases of a language that are ranked by one task are at most this many times ``top``.
RANKED_PARTS = 64

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_UNMIX = tuple(np.uint64(pow(int(m), -1, 1 << 64)) for m in _MIX)


def permuted(x: np.ndarray) -> np.ndarray:
    """A permutation of the 64-bit numbers."""
    x = (x ^ (x >> np.uint64(32))) * _MIX[0]
    x = (x ^ (x >> np.uint64(29))) * _MIX[1]
    return x ^ (x >> np.uint64(32))


def restored(x: np.ndarray) -> np.ndarray:
    """What ``permuted`` was given."""
    x = (x ^ (x >> np.uint64(32))) * _UNMIX[1]
    x = x ^ (x >> np.uint64(29)) ^ (x >> np.uint64(58))
    x = x * _UNMIX[0]
    return x ^ (x >> np.uint64(32))


def packed(first: np.ndarray, second: np.ndarray, third: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Two lanes of an n-gram of two or three 32-bit numbers: the mixed first lane, and the third number.

    The first lane is mixed with the third number, which can be undone as that is kept whole.
    """
    pair = permuted((first.astype(np.uint64) << np.uint64(32)) | second.astype(np.uint64))
    if third is None:
        return pair, np.zeros(len(pair), np.uint32)
    third = third.astype(np.uint32)
    return permuted(pair ^ (third.astype(np.uint64) * _ODD)), third


def unpacked(lane: np.ndarray, third: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if length == 3:
        lane = restored(lane) ^ (third.astype(np.uint64) * _ODD)
    pair = restored(lane)
    return pair >> np.uint64(32), pair & np.uint64(0xFFFFFFFF), third.astype(np.uint64)


class QuotientFilter:
    """Counts of n-grams, sorted by their two lanes: runs of quotients, full remainders, counters."""

    def __init__(self, lane: np.ndarray, third: np.ndarray, counts: np.ndarray):
        self.lane, self.third, self.counts = lane, third, counts

    @classmethod
    def of(cls, lane: np.ndarray, third: np.ndarray, counts: np.ndarray | None = None) -> QuotientFilter:
        """Equal entries are added up."""
        order = np.lexsort((third, lane)) if third.any() else np.argsort(lane, kind="stable")
        lane, third = lane[order], third[order]
        new = np.ones(len(lane), bool)
        new[1:] = (lane[1:] != lane[:-1]) | (third[1:] != third[:-1])
        at = np.flatnonzero(new)
        if counts is None:
            sums = np.diff(np.concatenate((at, [len(lane)])))
        else:
            sums = np.add.reduceat(counts[order], at) if len(at) else counts[:0]
        return cls(lane[at], third[at], sums.astype(np.int64))

    def __len__(self) -> int:
        return len(self.lane)

    def cut(self, ranges: int) -> Iterator[tuple[int, dict]]:
        """Number of the range and stored form of each stretch of quotients that has entries."""
        quotients = self.lane >> np.uint64(REMAINDER_BITS)
        for r in range(ranges):
            low, high = _quotients(r, ranges)
            a, z = np.searchsorted(quotients, (low, high))
            if a < z:
                runs = np.bincount((quotients[a:z] - np.uint64(low)).astype(np.int64), minlength=high - low).astype("<u4")
                rests = self.lane[a:z].astype("<u8").view(np.uint8).reshape(-1, 8)[:, : REMAINDER_BITS // 8]
                third = self.third[a:z].astype("<u4").tobytes() if self.third[a:z].any() else b""
                yield r, {"runs": runs.tobytes(), "rests": rests.tobytes(), "third": third, "counts": self.counts[a:z].astype("<u4").tobytes()}

    @classmethod
    def stored(cls, row: dict, number: int, ranges: int) -> QuotientFilter:
        """A stretch from its stored form."""
        low, high = _quotients(number, ranges)
        runs = np.frombuffer(row["runs"], "<u4")
        lane = np.repeat(np.arange(low, high, dtype=np.uint64), runs) << np.uint64(REMAINDER_BITS)
        rests = np.zeros((len(lane), 8), np.uint8)
        rests[:, : REMAINDER_BITS // 8] = np.frombuffer(row["rests"], np.uint8).reshape(-1, REMAINDER_BITS // 8)
        third = np.frombuffer(row["third"], "<u4") if row["third"] else np.zeros(len(lane), np.uint32)
        return cls(lane | rests.view("<u8").reshape(-1), third, np.frombuffer(row["counts"], "<u4").astype(np.int64))


def _quotients(number: int, ranges: int) -> tuple[int, int]:
    size = 1 << QUOTIENT_BITS
    return number * size // ranges, (number + 1) * size // ranges


#: A to Z in lower case, ends of pieces as line feeds, tabs as blanks.
_BYTES = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\v\f\r\t", b"abcdefghijklmnopqrstuvwxyz" + b"\n" * 9 + b" ")


def parts_of(text: bytes | None) -> list[bytes]:
    """The words of a text in order, a line feed for each end of a piece, and empty parts."""
    return (text or b"").translate(_BYTES).replace(b"\n", b" \n ").split(b" ")


def shards(docs: DataFrame, lang_col: str, text_col: str, shard_words: int) -> DataFrame:
    """(shard, words, lang, word, local, n): a row with the word numbers of each shard, and one per word of its vocabulary.

    Numbers begin with 1; 0 parts pieces. Word numbers are per language.
    """
    names = ["shard", "words", "lang", "word", "local", "n"]
    kinds = [pa.int64(), pa.binary(), pa.string(), pa.string(), pa.int32(), pa.int64()]

    def flush(shard: int, vocabularies: dict[str, _Numbers], coded: list[np.ndarray]) -> pa.RecordBatch:
        stream = np.concatenate(coded)
        known = [(number, lang, word.decode()) for lang, words in vocabularies.items() for word, number in words.items() if number > 0]
        n, k = np.bincount(stream, minlength=1).tolist(), len(known)
        numbers, langs, words = zip(*known) if known else ((), (), ())
        columns = [[shard] * (k + 1), [None] * k + [stream.tobytes()], [*langs, None], [*words, None], [*numbers, None], [*(n[i] for i in numbers), None]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId() << 32  # the table is written once, so the numbers stay
        vocabularies: dict[str, _Numbers] = {}
        counter, coded, total = count(1), [], 0
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
                if lang not in vocabularies:
                    vocabularies[lang] = _Numbers(counter)
                parts = parts_of(text.as_py())
                numbers = np.fromiter(map(vocabularies[lang].__getitem__, parts), np.int32, len(parts))
                coded += (numbers[numbers >= 0].astype("<u4"), np.zeros(1, "<u4"))
                total += len(parts)
                if total >= shard_words:
                    yield flush(shard, vocabularies, coded)
                    shard, vocabularies, counter, coded, total = shard + 1, {}, count(1), [], 0
        if coded:
            yield flush(shard, vocabularies, coded)

    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(rows, "shard long, words binary, lang string, word string, local int, n long")


class _Numbers(dict):
    """Numbers of a language's words in a shard; the languages of a shard share a counter."""

    def __init__(self, counter: Iterator[int]):
        super().__init__({b"\n": 0, b"": -1})
        self.counter = counter

    def __missing__(self, word: bytes) -> int:
        number = self[word] = next(self.counter)
        return number


def numbered(words: DataFrame) -> DataFrame:
    """``words`` with ``id`` 1, 2, ...: their place, counted per partition of the table and summed up."""
    parted = words.withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", 33))
    parted = keep(parted, "frequent-words")
    sizes = parted.groupBy("part").agg(F.max("at").alias("last"))
    size = F.col("last") - F.shiftleft(F.col("part"), 33) + 1
    before = F.coalesce(F.sum(size).over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("part", before.alias("before"))  # one row per partition of the table
    found = parted.join(sizes, "part").withColumn("id", F.col("before") + F.col("at") - F.shiftleft(F.col("part"), 33) + 1)
    return found.drop("at", "part", "before")


_SLICE = "kind string, range int, shard long, runs binary, rests binary, third binary, counts binary, ids binary"


def _slice_row(kind: str, number: int, shard: int, stored: dict | None = None, ids: bytes | None = None) -> pa.RecordBatch:
    stored = stored or {}
    columns = [kind, number, shard, *(stored.get(c) for c in ("runs", "rests", "third", "counts")), ids]
    kinds = [pa.string(), pa.int32(), pa.int64(), *[pa.binary()] * 5]
    names = ["kind", "range", "shard", "runs", "rests", "third", "counts", "ids"]
    return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(columns, kinds)], names=names)


def _pairs_of(shard: int, ids: np.ndarray, ranges: int) -> Iterator[pa.RecordBatch]:
    at = np.flatnonzero((ids[:-1] > 0) & (ids[1:] > 0))
    yield _slice_row("ids", 0, shard, ids=ids.astype("<u4").tobytes())
    for number, stored in QuotientFilter.of(*packed(ids[at], ids[at + 1])).cut(ranges):
        yield _slice_row("filter", number, shard, stored)


def count_pairs(found: DataFrame, words: DataFrame, ranges: int) -> DataFrame:
    """Slices of each shard's filter of word pairs (kind ``filter``), and its words by corpus number (kind ``ids``)."""

    def rows(own: pa.Table, known: pa.Table) -> pa.Table:
        coded = [w for w in own["words"].to_pylist() if w is not None]
        if not coded:
            return _slice_row("", 0, 0).schema.empty_table()
        stream = np.frombuffer(coded[0], "<u4")
        number_of = np.zeros(int(stream.max(initial=0)) + 1, np.uint32)
        ids = known["id"].to_numpy()
        if ids.max(initial=0) >= 1 << 32:
            raise ValueError("more than 2^32 frequent words")
        number_of[known["local"].to_numpy()] = ids.astype(np.uint32)
        return pa.Table.from_batches(_pairs_of(own["of"][0].as_py(), number_of[stream], ranges))

    streams = found.where("words is not null").select(F.col("shard").alias("of"), "words").groupBy("of")
    vocabulary = found.where("words is null").select("shard", "lang", "word", "local").join(words.select("lang", "word", "id"), ["lang", "word"])
    return streams.cogroup(vocabulary.select("shard", "local", "id").groupBy("shard")).applyInArrow(rows, _SLICE)


def merge_filters(slices: DataFrame, length: int, ranges: int, least: int) -> DataFrame:
    """Merged filters of the frequent n-grams (kind ``merged``), and those of them that each shard has (kind ``known``)."""

    def rows(key, group):
        number = key[0].as_py()
        parts = [(r["shard"], QuotientFilter.stored(r, number, ranges)) for r in group.to_pylist()]
        merged = QuotientFilter.of(*(np.concatenate([getattr(f, c) for _, f in parts]) for c in ("lane", "third", "counts")))
        some = merged.counts >= least
        frequent = QuotientFilter(merged.lane[some], merged.third[some], merged.counts[some])
        out = [_merged_row("merged", number, None, frequent)]
        if length == 2 and len(frequent):
            for shard, f in parts:
                own = f.lane[np.isin(f.lane, frequent.lane, assume_unique=True)]
                if len(own):
                    out.append(_merged_row("known", number, shard, QuotientFilter(own, own[:0], own[:0])))
        return pa.Table.from_batches(out)

    # A range holds about the same number of entries, whatever they are.
    return slices.groupBy("range").applyInArrow(rows, "kind string, shard long, lane binary, third binary, counts binary")


def _merged_row(kind: str, number: int, shard: int | None, f: QuotientFilter) -> pa.RecordBatch:
    columns = [kind, shard, f.lane.astype("<u8").tobytes(), f.third.astype("<u4").tobytes(), f.counts.astype("<i8").tobytes()]
    kinds = [pa.string(), pa.int64(), *[pa.binary()] * 3]
    return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(columns, kinds)], names=["kind", "shard", "lane", "third", "counts"])


def count_triples(slices: DataFrame, merged: DataFrame, ranges: int) -> DataFrame:
    """Slices of each shard's filter of three words, of which both pairs are frequent."""

    def rows(own: pa.Table, known: pa.Table) -> pa.Table:
        out = []
        if own.num_rows and known.num_rows:
            ids = np.frombuffer(own["ids"][0].as_py(), "<u4")
            frequent = np.sort(np.concatenate([np.frombuffer(x, "<u8") for x in known["lane"].to_pylist()]))
            at = np.flatnonzero((ids[:-1] > 0) & (ids[1:] > 0))
            lane, _ = packed(ids[at], ids[at + 1])
            place = np.minimum(np.searchsorted(frequent, lane), len(frequent) - 1)
            pair = np.zeros(len(ids) + 1, bool)
            pair[at[frequent[place] == lane]] = True
            at = np.flatnonzero(pair[:-1] & pair[1:])
            for number, stored in QuotientFilter.of(*packed(ids[at], ids[at + 1], ids[at + 2])).cut(ranges):
                out.append(_slice_row("filter", number, own["shard"][0].as_py(), stored))
        return pa.Table.from_batches(out, schema=_slice_row("", 0, 0).schema)

    ids = slices.where("kind = 'ids'").select("shard", "ids").groupBy("shard")
    known = merged.where("kind = 'known'").select("shard", "lane").groupBy("shard")
    return ids.cogroup(known).applyInArrow(rows, _SLICE)


def _counted(merged: DataFrame, length: int) -> DataFrame:
    """(w1, w2, w3, a) of the n-grams of merged filters; w3 is 0 for pairs."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lane, third, counts in zip(*(batch.column(c).to_pylist() for c in ("lane", "third", "counts"))):
                ids = unpacked(np.frombuffer(lane, "<u8"), np.frombuffer(third, "<u4"), length)
                yield pa.RecordBatch.from_arrays([*(pa.array(x.astype(np.int64)) for x in ids), pa.array(np.frombuffer(counts, "<i8"))], names=["w1", "w2", "w3", "a"])

    return merged.where("kind = 'merged'").select("lane", "third", "counts").mapInArrow(rows, "w1 long, w2 long, w3 long, a long")


def _score(a: str, left: str, right: str) -> Column:
    """floor(1000000 a a / (l r)), exactly: decimals of 38 digits hold products of counts below 10^16."""
    a, left, right = (f"cast({c} as decimal(16,0))" for c in (a, left, right))
    return F.expr(f"{a} * {a} * 1000000 div ({left} * {right})")


def collocations(
    docs: DataFrame, *, lang_col: str = "lang", text_col: str = "text", least: int = LEAST_COUNT, cover_percent: int = 50, top: int = 2000,
    shard_words: int = SHARD_WORDS, range_entries: int = RANGE_ENTRIES,
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of the ``top`` collocations of two or three words of each language.

    A phrase stands inside a piece of text between ``.,;:!?`` and line ends; only A-Z are
    lower-cased. ``a`` counts its occurrences, ``n`` all words of the language. It is cut where
    floor(1000000 a a / (l r)) is least (ties: the first cut), with ``l`` and ``r`` the
    occurrences of both sides, and goes if a longer candidate that holds it has at least
    ``cover_percent`` of its occurrences. Candidates occur ``least`` times or more.

    Null languages count as ``und``, null and empty texts have no words, and rows repeated as a
    whole count as often as they stand there. Ties in score go by ``a``, then by phrase in the
    order of its bytes. Only the two columns named are read; an empty table gives no phrase.
    """
    found = keep(shards(docs, lang_col, text_col, shard_words), "shards")
    words = keep(found.where("words is null").groupBy("lang", "word").agg(F.sum("n").alias("f")), "words")
    totals = keep(words.groupBy("lang").agg(F.sum("f").alias("n")), "word-totals")
    frequent = keep(numbered(words.where(F.col("f") >= least)), "numbered-words")
    spoken = totals.agg(F.sum("n")).first()[0] or 0
    ranges = int(min(1 << QUOTIENT_BITS, max(1, -(-spoken // range_entries))))

    slices = keep(count_pairs(found, frequent, ranges), "pair-filters")
    pairs_merged = keep(merge_filters(slices.where("kind = 'filter'"), 2, ranges, least), "merged-pairs")
    triple_slices = keep(count_triples(slices, pairs_merged, ranges), "triple-filters")
    triples_merged = keep(merge_filters(triple_slices, 3, ranges, least), "merged-triples")
    pairs = keep(_counted(pairs_merged, 2).select("w1", "w2", "a"), "pairs")
    triples = keep(_counted(triples_merged, 3), "triples")

    def word(number: str, *, text: bool = False) -> DataFrame:
        columns = [F.col("word").alias(f"t{number}"), *([F.col("lang")] if number == "1" else [])]
        return frequent.select(F.col("id").alias(f"w{number}"), F.col("f").alias(f"f{number}"), *columns)

    def pair(first: str, second: str) -> DataFrame:
        return pairs.select(F.col("w1").alias(f"w{first}"), F.col("w2").alias(f"w{second}"), F.col("a").alias(f"f{first}{second}"))

    covered = triples.select(F.explode(F.array(F.struct("w1", "w2"), F.struct(F.col("w2").alias("w1"), F.col("w3").alias("w2")))).alias("p"), "a")
    covered = covered.groupBy("p.w1", "p.w2").agg(F.max("a").alias("longest"))
    two = pairs.join(covered, ["w1", "w2"], "left").where(F.col("longest").isNull() | (100 * F.col("longest") < cover_percent * F.col("a")))
    two = two.join(word("1"), "w1").join(word("2"), "w2").select(
        "lang", F.concat_ws(" ", "t1", "t2").alias("phrase"), "a", F.col("f1").alias("l"), F.col("f2").alias("r"), _score("a", "f1", "f2").alias("score")
    )
    three = triples.join(pair("1", "2"), ["w1", "w2"]).join(pair("2", "3"), ["w2", "w3"]).join(word("1"), "w1").join(word("2"), "w2").join(word("3"), "w3")
    three = three.withColumn("s1", _score("a", "f1", "f23")).withColumn("s2", _score("a", "f12", "f3"))
    first = F.col("s1") <= F.col("s2")
    three = three.select(
        "lang", F.concat_ws(" ", "t1", "t2", "t3").alias("phrase"), "a", F.when(first, F.col("f1")).otherwise(F.col("f12")).alias("l"),
        F.when(first, F.col("f23")).otherwise(F.col("f3")).alias("r"), F.least("s1", "s2").alias("score"),
    )

    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    scored = two.unionByName(three).withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(RANKED_PARTS)))
    # The best of each part first, so that no task ranks all phrases of a language.
    best = scored.withColumn("place", F.row_number().over(W.partitionBy("lang", "part").orderBy(*order))).where(F.col("place") <= top)
    ranked = best.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
