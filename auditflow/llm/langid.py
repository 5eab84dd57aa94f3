"""Language spans of mixed-language text.

Each word is scored under every learned language by its byte n-grams. The script of the word
narrows the languages that may stand for it. Viterbi finds the best sequence of languages over the
words of a text, with a penalty for each switch, and neighbouring words of one language form a span.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

UNKNOWN = "und"
BUCKETS = 1 << 15
ORDERS = (2, 3, 4)
#: Log-likelihood that a switch of language costs.
SWITCH_PENALTY = 6.0
#: A language may stand for a word if its script has at least this share of the language's words.
LEAST_SCRIPT_SHARE = 0.01

#: First and last code point of ranges of scripts.
SCRIPTS = (
    ("latin", 0x0041, 0x024F), ("greek", 0x0370, 0x03FF), ("cyrillic", 0x0400, 0x052F), ("armenian", 0x0530, 0x058F),
    ("hebrew", 0x0590, 0x05FF), ("arabic", 0x0600, 0x077F), ("devanagari", 0x0900, 0x097F), ("bengali", 0x0980, 0x09FF),
    ("tamil", 0x0B80, 0x0BFF), ("thai", 0x0E00, 0x0E7F), ("georgian", 0x10A0, 0x10FF), ("latin", 0x1E00, 0x1EFF),
    ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x9FFF), ("hangul", 0xAC00, 0xD7AF), ("han", 0x20000, 0x2FFFF),
)
SCRIPT_NAMES = [*dict.fromkeys(name for name, _, _ in SCRIPTS), "other"]
#: Bytes of words: ASCII letters and everything beyond ASCII; others part words.
_WORD_BYTES = bytes(c if c >= 128 or 65 <= c <= 90 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: str) -> list[bytes]:
    return text.lower().encode().translate(_WORD_BYTES).split()


def script_of(word: bytes) -> int:
    for c in map(ord, word.decode(errors="replace")):
        for name, first, last in SCRIPTS:
            if first <= c <= last and chr(c).isalpha():
                return SCRIPT_NAMES.index(name)
    return len(SCRIPT_NAMES) - 1


def grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the byte n-grams of blank-bounded words, and the number of the word each belongs to."""
    data = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8).astype(np.uint32)
    ends = np.cumsum([len(w) + 1 for w in words])  # place of the blank behind each word
    owner = np.zeros(len(data), np.int64)
    owner[ends[:-1] + 1] = 1
    owner = np.cumsum(owner)  # a word has the blank behind it, and the one before it by the gram's start
    found, owners = [], []
    for order in ORDERS:
        code = np.zeros(len(data) - order + 1, np.uint32)
        for i in range(order):
            code = code * np.uint32(257) + data[i : len(data) - order + 1 + i]
        code = (code + np.uint32(order)) * np.uint32(2654435761)
        inside = np.ones(len(code), bool)
        blanks = np.concatenate(([0], np.cumsum(data == 32)))
        if order > 2:  # no gram spans a blank in its middle
            inside = blanks[order - 1 : len(data)] - blanks[1 : len(code) + 1] == 0
        found.append((code >> np.uint32(17)).astype(np.int64)[inside])
        owners.append(owner[1 : len(code) + 1][inside])
    return np.concatenate(found), np.concatenate(owners)


@dataclass
class Model:
    """Log-probabilities of the n-gram buckets and admitted scripts of each language."""

    languages: list[str]
    logs: np.ndarray  # buckets x languages
    admitted: np.ndarray  # scripts x languages

    def score(self, words: list[bytes]) -> np.ndarray:
        buckets, owners = grams(words)
        out = np.zeros((len(words), len(self.languages)), np.float32)
        for i in range(len(self.languages)):
            out[:, i] = np.bincount(owners, self.logs[buckets, i], len(words))
        scripts = np.fromiter(map(script_of, words), np.int64, len(words))
        return out - np.where(self.admitted[scripts], np.float32(0), np.float32(1e4))


class _Scores(dict):
    """Row numbers of the scores of known words."""

    def __init__(self, model: Model):
        self.model, self.table = model, np.zeros((0, len(model.languages)), np.float32)

    def of(self, texts: list[list[bytes]]) -> list[np.ndarray]:
        new = list(dict.fromkeys(w for words in texts for w in words if w not in self))
        if len(self) + len(new) > 300_000:
            self.clear()
            self.table = self.table[:0]
            new = list(dict.fromkeys(w for words in texts for w in words))
        if new:
            for i, w in enumerate(new, len(self.table)):
                self[w] = i
            self.table = np.concatenate((self.table, self.model.score(new)))
        return [np.fromiter(map(self.__getitem__, words), np.int64, len(words)) for words in texts]


def train(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", smoothing: float = 0.5) -> Model:
    """Learn from all given rows with a text and a language.

    Tasks send counts by language and bucket, summed by Spark; the driver gets one row for each.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            by_lang: dict[str, Counter] = {}
            for text, lang in zip(batch.column(0), batch.column(1).to_pylist()):
                by_lang.setdefault(lang, Counter()).update(words_of(text.as_py()))
            for lang, words in by_lang.items():
                total = counts.setdefault(lang, np.zeros(BUCKETS + len(SCRIPT_NAMES), np.int64))
                if words:
                    different, times = list(words), np.fromiter(words.values(), np.int64, len(words))
                    buckets, owners = grams(different)
                    total[:BUCKETS] += np.bincount(buckets, times[owners], BUCKETS).astype(np.int64)
                    scripts = np.fromiter(map(script_of, different), np.int64, len(different))
                    total[BUCKETS:] += np.bincount(scripts, times, len(SCRIPT_NAMES)).astype(np.int64)
        for lang, total in counts.items():
            some = np.flatnonzero(total)
            arrays = [pa.array([lang] * len(some), pa.string()), pa.array(some.astype(np.int32)), pa.array(total[some])]
            yield pa.RecordBatch.from_arrays(arrays, names=["lang", "bucket", "n"])

    learned = docs.select(F.col(text_col).cast("string").alias("t"), F.col(lang_col).cast("string").alias("l")).where("t is not null and l is not null")
    summed = learned.mapInArrow(rows, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    table = summed.toArrow().to_pandas()
    languages = sorted(table["lang"].unique().tolist())
    counts = np.zeros((BUCKETS + len(SCRIPT_NAMES), len(languages)))
    counts[table["bucket"], [languages.index(x) for x in table["lang"]]] = table["n"]
    seen = counts[:BUCKETS] + smoothing
    logs = np.log(seen / seen.sum(axis=0)) / len(ORDERS)
    scripts = counts[BUCKETS:]
    admitted = scripts >= LEAST_SCRIPT_SHARE * np.maximum(scripts.sum(axis=0), 1)
    admitted[~admitted.any(axis=1)] = True  # a script nobody uses narrows nothing
    return Model(languages, logs.astype(np.float32), admitted)


def viterbi(scores: list[np.ndarray], penalty: float) -> list[np.ndarray]:
    """Best language of each word of several texts at once; the longest text comes first."""
    sizes = np.array([len(s) for s in scores])
    longest, texts, n = int(sizes[0]), len(scores), scores[0].shape[1]
    padded = np.zeros((longest, texts, n), np.float32)
    for i, s in enumerate(scores):
        padded[: len(s), i] = s
    active = np.searchsorted(-sizes, -np.arange(longest), "left")  # texts longer than t
    stays, came = np.zeros((longest, texts, n), bool), np.zeros((longest, texts), np.int16)
    state = padded[0].copy()
    for t in range(1, longest):
        k = active[t]
        now = state[:k]
        best = now.max(axis=1, keepdims=True) - penalty
        came[t, :k] = now.argmax(axis=1)
        stays[t, :k] = now >= best
        np.maximum(now, best, out=now)
        now -= best  # keeps the numbers small, so that they stay exact in texts of any length
        now += padded[t, :k]
    at = state.argmax(axis=1)
    path = np.zeros((longest, texts), np.int16)
    for t in range(longest - 1, -1, -1):
        k = active[t]
        path[t, :k] = at[:k]
        if t:
            at[:k] = np.where(stays[t, np.arange(k), at[:k]], at[:k], came[t, :k])
    return [path[: len(s), i] for i, s in enumerate(scores)]


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


SCHEMA = "doc_id long, lang_pred string, score double, spans array<struct<start: long, end: long, lang: string>>"


def label(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", penalty: float = SWITCH_PENALTY) -> DataFrame:
    """doc_id, lang_pred, score and spans (words from 0, end exclusive) of every row's whole text.

    ``lang_pred`` is the language with most bytes of words, ties to the first by name, and
    ``score`` its share of them. Null texts and texts without a letter are ``und`` with score 0 and
    no spans, as is everything if nothing was learned. Rows are independent; other columns aren't read.
    """
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())])

    def some(ids: list, texts: list[str | None], cache: _Scores) -> pa.RecordBatch:
        split = [words_of(t) if t and any(map(str.isalpha, t)) and model.languages else [] for t in texts]
        rows, order = cache.of(split), sorted((i for i in range(len(split)) if split[i]), key=lambda i: -len(split[i]))
        labels, scores, spans = [UNKNOWN] * len(split), [0.0] * len(split), [[] for _ in split]
        while order:
            k = max(1, 300_000 // len(split[order[0]]))
            group, order = order[:k], order[k:]
            for i, path in zip(group, viterbi([cache.table[rows[i]] for i in group], penalty), strict=True):
                sizes = np.fromiter(map(len, split[i]), np.int64, len(split[i]))
                shares = np.bincount(path, sizes, len(model.languages))
                best = int(shares.argmax())
                labels[i], scores[i] = model.languages[best], float(shares[best] / shares.sum())
                cuts = np.concatenate(([0], np.flatnonzero(np.diff(path)) + 1, [len(path)])).tolist()
                spans[i] = [{"start": a, "end": b, "lang": model.languages[path[a]]} for a, b in zip(cuts, cuts[1:])]
        arrays = [pa.array(ids, pa.int64()), pa.array(labels, pa.string()), pa.array(scores, pa.float64()), pa.array(spans, pa.list_(span))]
        return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "lang_pred", "score", "spans"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _Scores(model)
        for batch in batches:
            for part in range(0, batch.num_rows, 1000):
                piece = batch.slice(part, 1000)
                yield some(piece.column(0).to_pylist(), piece.column(1).to_pylist(), cache)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(rows, SCHEMA)
