"""Quality classifier by co-training of two views.

One classifier sees the words of a text, the other what is known about the page: its source,
language and size, and the shape of its lines and characters. Both are naive Bayes models, whose
counts are sums over all documents. In each round either model labels the unlabelled documents it
is sure of, and the other one learns from these labels and the given ones. Scores are calibrated on
a fold of labelled documents that no model learns from; the calibrated views are then combined.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from auditflow.llm._store import keep

TEXT_BUCKETS, PAGE_BUCKETS = 1 << 14, 1 << 12
ROUNDS = 2
#: A model labels a document for the other one if its calibrated probability is this far up or down.
CONFIDENCE = 0.97
#: One labelled document in so many is kept for calibration.
FOLDS = 5
BINS, WIDEST = 256, 16.0
#: Classes of size, by the number of different words, that are calibrated apart.
SIZES = 10
JOINT_BINS = 64

_UPPER, _DIGITS = bytes(range(65, 91)), bytes(range(48, 58))
_SIGNS = bytes(c for c in range(33, 127) if not chr(c).isalnum())


class _TextBuckets(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        value = self[word] = zlib.crc32(word) % TEXT_BUCKETS
        return value


def text_view(words: list[bytes], buckets: _TextBuckets) -> np.ndarray:
    """Buckets of the different words."""
    return np.fromiter(sorted(set(map(buckets.__getitem__, words))), np.uint16)


def page_view(text: bytes, words: list[bytes], source: str | None, lang: str | None) -> np.ndarray:
    """Buckets of the page's properties, sizes and shares in steps.

    What a share says depends on the size (one capital is a lot of a short line), so the shape of
    lines and characters is told apart by size class.
    """
    size, n = max(1, len(text)), max(1, len(words))
    size_class = min(5, size.bit_length() // 2)

    def share(chars: bytes) -> str:
        return f"{round(40 * (1 - len(text.translate(None, chars)) / size))}|{size_class}"

    different = len(set(words))
    values = {
        "source": source, "lang": lang, "size": round(2 * math.log2(size)), "lines": round(2 * math.log2(1 + text.count(b"\n"))),
        "line_length": f"{round(2 * math.log2(size / (1 + text.count(b'\n'))))}|{size_class}",
        "word_length": f"{round(4 * math.log2(size / n))}|{size_class}",
        "upper": share(_UPPER), "digits": share(_DIGITS), "signs": share(_SIGNS),
        # How many words repeat depends on the length, so steps of both.
        "different": f"{round(20 * different / n)}|{round(math.log2(n))}",
        "repeats": f"{round(20 * sum(map(bytes.__eq__, words, words[1:])) / n)}|{size_class}",
        "longest": f"{round(2 * math.log2(1 + max(map(len, words), default=0)))}|{size_class}",
    }
    return np.fromiter((zlib.crc32(f"{k}={v}".encode()) % PAGE_BUCKETS for k, v in values.items()), np.uint16)


def _views(batch: pa.RecordBatch, buckets: _TextBuckets) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Both views of rows (id, text, source, lang)."""
    texts, pages = [], []
    for text, source, lang in zip(batch.column(1).cast(pa.binary()), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
        text = text.as_py() or b""
        words = text.split()
        texts.append(text_view([w.lower() for w in words], buckets))
        pages.append(page_view(text, words, source, lang))
    return texts, pages


@dataclass
class View:
    """Log-odds of each bucket for a good document, and the calibration of their sum."""

    odds: np.ndarray
    slope: float = 1.0
    shifts: np.ndarray | None = None  # by class of size: little text is little evidence, not evidence of a bad page

    def raw(self, rows: list[np.ndarray]) -> np.ndarray:
        """Sum over a document's buckets, divided by the root of their number."""
        sizes = np.fromiter(map(len, rows), np.int64, len(rows))
        flat = np.concatenate(rows) if len(rows) else np.zeros(0, np.uint16)
        owners = np.repeat(np.arange(len(rows)), sizes)
        total = np.bincount(owners, self.odds[flat], len(rows))
        return np.clip(total / np.sqrt(np.maximum(sizes, 1)), -WIDEST, WIDEST)

    def logit(self, rows: list[np.ndarray], sizes: np.ndarray) -> np.ndarray:
        shift = 0.0 if self.shifts is None else self.shifts[sizes]
        return np.clip(self.slope * self.raw(rows) + shift, -WIDEST, WIDEST)


def size_classes(texts: list[np.ndarray]) -> np.ndarray:
    return np.fromiter((min(len(t).bit_length(), SIZES - 1) for t in texts), np.int64, len(texts))


@dataclass
class QualityModel:
    text: View
    page: View
    combined: tuple[float, float, float]  # weights of both logits, and shift

    def probabilities(self, texts: list[np.ndarray], pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """By text, by page, and by both."""
        sizes = size_classes(texts)
        t, p = self.text.logit(texts, sizes), self.page.logit(pages, sizes)
        both = self.combined[0] * t + self.combined[1] * p + self.combined[2]
        return _probability(t), _probability(p), _probability(both)


def _probability(logit: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def fit_logistic(x: np.ndarray, good: np.ndarray, bad: np.ndarray, pull: np.ndarray | float = 1e-2) -> np.ndarray:
    """Weights and shift of a logistic regression on counted points, with a weak pull to zero."""
    x = np.column_stack((x, np.ones(len(x))))
    w, pull = np.zeros(x.shape[1]), np.broadcast_to(pull, x.shape[1])
    for _ in range(100):
        p = _probability(x @ w)
        gradient = x.T @ (good - (good + bad) * p) - pull * w
        step = np.linalg.solve((x * ((good + bad) * p * (1 - p))[:, None]).T @ x + np.diag(pull), gradient)
        w = w + np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-9:
            break
    return w


def _features(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, page, label, calibrates): compact views of every document, with its label if it has one."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = _TextBuckets()
        for batch in batches:
            texts, pages = _views(batch, buckets)
            arrays = [batch.column(0), pa.array([t.tobytes() for t in texts], pa.binary()), pa.array([p.tobytes() for p in pages], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "text_view", "page_view"])

    views = docs.mapInArrow(rows, "doc_id long, text_view binary, page_view binary")
    calibrates = F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)) == 0
    return keep(views.join(labels, "doc_id", "left").withColumn("calibrates", calibrates & F.col("label").isNotNull()), "quality-views")


def _arrays(batch: pa.RecordBatch) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray, np.ndarray]:
    texts, pages = ([np.frombuffer(b or b"", np.uint16) for b in batch.column(i).to_pylist()] for i in (0, 1))
    label = np.array([-1 if v is None else v for v in batch.column(2).to_pylist()], np.int64)
    return texts, pages, label, np.array(batch.column(3).to_pylist(), bool)


def _summed(views: DataFrame, count, cells: int) -> np.ndarray:
    """(cells, 2) array of counts of bad and good; ``count`` adds a batch to a task's array, Spark sums those."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((cells, 2), np.int64)
        for batch in batches:
            count(total, *_arrays(batch))
        some = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some, 0]), pa.array(total[some, 1])], names=["cell", "bad", "good"])

    sent = views.select("text_view", "page_view", "label", "calibrates").mapInArrow(rows, "cell long, bad long, good long")
    table = sent.groupBy("cell").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).toArrow()
    out = np.zeros((cells, 2), np.int64)
    out[table["cell"].to_numpy()] = np.column_stack((table["bad"].to_numpy(), table["good"].to_numpy()))
    return out


def _add(total: np.ndarray, first: int, rows: list[np.ndarray], label: np.ndarray, size: int) -> None:
    for value in (0, 1):
        chosen = [r for r, v in zip(rows, label) if v == value]
        if chosen:
            total[first : first + size, value] += np.bincount(np.concatenate(chosen), minlength=size)


def _bins(values: np.ndarray, n: int) -> np.ndarray:
    return np.minimum(((values + WIDEST) / (2 * WIDEST) * n).astype(np.int64), n - 1)


def _middles(n: int) -> np.ndarray:
    return (np.arange(n) + 0.5) / n * 2 * WIDEST - WIDEST


def _learn(views: DataFrame, models: tuple[View, View] | None) -> tuple[View, View]:
    """Both models from the given labels and, if there are earlier models, from the labels each one is sure of."""

    def count(total, texts, pages, label, calibrates):
        for_text, for_page = label.copy(), label.copy()
        if models is not None:
            sizes = size_classes(texts)
            for target, view, rows in ((for_text, models[1], pages), (for_page, models[0], texts)):
                p = _probability(view.logit(rows, sizes))
                free = label < 0
                target[free & (p >= CONFIDENCE)] = 1
                target[free & (p <= 1 - CONFIDENCE)] = 0
        for_text[calibrates] = for_page[calibrates] = -1
        _add(total, 0, texts, for_text, TEXT_BUCKETS)
        _add(total, TEXT_BUCKETS, pages, for_page, PAGE_BUCKETS)
        for place, target in ((-2, for_text), (-1, for_page)):
            total[place] += np.bincount(target[target >= 0], minlength=2)

    counts = _summed(views, count, TEXT_BUCKETS + PAGE_BUCKETS + 2).astype(float)

    def odds(part: np.ndarray, documents: np.ndarray) -> View:
        # Shares of documents that have a bucket. One more document, spread over the classes as all
        # are, is added to each: an unseen bucket says nothing.
        documents = np.maximum(documents, 1)
        share = np.log((part + documents / documents.sum()) / documents)
        return View(share[:, 1] - share[:, 0])

    return odds(counts[:TEXT_BUCKETS], counts[-2]), odds(counts[TEXT_BUCKETS:-2], counts[-1])


def _calibrate(views: DataFrame, models: tuple[View, View]) -> None:
    """Fit slope and shifts of both views on the fold that no model learned from."""
    cells = BINS * SIZES

    def count(total, texts, pages, label, calibrates):
        sizes = size_classes(texts)
        for i, (view, rows) in enumerate(((models[0], texts), (models[1], pages))):
            place = i * cells + sizes * BINS + _bins(view.raw(rows), BINS)
            np.add.at(total, (place[calibrates], label[calibrates]), 1)

    counts = _summed(views, count, 2 * cells)
    points = np.column_stack((np.tile(_middles(BINS), SIZES), np.repeat(np.eye(SIZES), BINS, axis=0)))
    pull = np.array([1e-2] + [0.3] * SIZES + [1e-2])  # a class with few documents stays near the common shift
    for view, part in zip(models, (counts[:cells], counts[cells:]), strict=True):
        weights = fit_logistic(points, part[:, 1], part[:, 0], pull)
        view.slope, view.shifts = float(weights[0]), weights[1:-1] + weights[-1]


def _combine(views: DataFrame, models: tuple[View, View]) -> tuple[float, float, float]:
    def count(total, texts, pages, label, calibrates):
        sizes = size_classes(texts)
        t, p = (_bins(view.logit(rows, sizes), JOINT_BINS) for view, rows in ((models[0], texts), (models[1], pages)))
        np.add.at(total, ((t * JOINT_BINS + p)[calibrates], label[calibrates]), 1)

    counts = _summed(views, count, JOINT_BINS**2)
    middles = _middles(JOINT_BINS)
    points = np.column_stack((np.repeat(middles, JOINT_BINS), np.tile(middles, JOINT_BINS)))
    return tuple(map(float, fit_logistic(points, counts[:, 1], counts[:, 0])))


def _columns(docs: DataFrame, id_col: str, text_col: str, source_col: str, lang_col: str) -> DataFrame:
    """(doc_id, text, source, lang); a property that the table lacks is null."""
    def known(c):
        return F.col(c).cast("string") if c in docs.columns else F.lit(None).cast("string")

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), known(source_col).alias("source"), known(lang_col).alias("lang"))


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang",
          label_col: str = "quality", rounds: int = ROUNDS) -> QualityModel | None:
    """Learn from all documents and ``labels`` (id_col, label_col of 0 or 1).

    Labels that are null or contradict each other for one document are left out; rows that repeat
    an identifier all get its label. None if either class is absent from the labels or the fold.
    """
    label = F.col(label_col).cast("int")
    given = labels.where(label.isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("doc_id"))
    given = given.agg(F.min(label).alias("label"), F.max(label).alias("other")).where("label = other").select("doc_id", "label")
    views = _features(_columns(docs, id_col, text_col, source_col, lang_col), given)
    present = {(r["label"], r["calibrates"]) for r in views.where("label is not null").select("label", "calibrates").distinct().collect()}
    if len(present) < 4:
        return None
    models = _learn(views, None)
    _calibrate(views, models)
    for _ in range(rounds):
        models = _learn(views, models)
        _calibrate(views, models)
    return QualityModel(*models, _combine(views, models))


def score(docs: DataFrame, model: QualityModel | None, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang",
          least: float = 0.5) -> DataFrame:
    """doc_id, text_score, page_score, score (probabilities of good) and accepted (score >= least) of every row.

    Null and empty texts have no words and are judged by the page. Without a model (no labels of
    both classes) all scores are 0.5. Repeated rows each get a row.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = _TextBuckets()
        for batch in batches:
            n = batch.num_rows
            each = model.probabilities(*_views(batch, buckets)) if model else [np.full(n, 0.5)] * 3
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *map(pa.array, each), pa.array(each[2] >= least)], names=["doc_id", "text_score", "page_score", "score", "accepted"]
            )

    schema = "doc_id long, text_score double, page_score double, score double, accepted boolean"
    return _columns(docs, id_col, text_col, source_col, lang_col).mapInArrow(rows, schema)


def accepted(docs: DataFrame, model: QualityModel | None, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
             lang_col: str = "lang", least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that the model accepts, with all their columns, without a join."""
    names = docs.columns

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = _TextBuckets()
        for batch in batches:
            if model:
                own = pa.RecordBatch.from_arrays(batch.columns[len(names) :], names=["doc_id", "text", "source", "lang"])
                batch = batch.filter(pa.array(model.probabilities(*_views(own, buckets))[2] >= least))
            yield pa.RecordBatch.from_arrays(batch.columns[: len(names)], names=names)

    def known(c):
        return F.col(c).cast("string") if c in names else F.lit(None).cast("string")

    used = [F.col(id_col).alias("__id"), known(text_col).alias("__text"), known(source_col).alias("__source"), known(lang_col).alias("__lang")]
    return docs.select(*names, *used).mapInArrow(rows, docs.schema)
