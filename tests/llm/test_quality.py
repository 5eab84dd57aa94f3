import math

import numpy as np
from pyspark.sql import functions as F

from auditflow.llm import quality
from auditflow.llm.queries import QUERIES


def test_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 0
    model = quality.train(docs, labels.where(~held))
    got = quality.score(docs, model).join(labels, "doc_id").where(held)
    rows = got.select("quality", "accepted").collect()
    good = [r["accepted"] for r in rows if r["quality"] == 1]
    bad = [r["accepted"] for r in rows if r["quality"] == 0]
    assert sum(good) >= 0.9 * len(good) and sum(bad) <= 0.35 * len(bad)


def test_query_scores_every_document(spark, sf_dir):
    rows = QUERIES["op3_cotrained_quality"](spark, sf_dir).collect()
    assert len(rows) == 200 and all(0 <= r["score"] <= 1 and r["accepted"] == (r["score"] >= 0.5) for r in rows)


def test_accepted_rows_keep_all_columns(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(docs, labels)
    kept = quality.accepted(docs, model)
    assert kept.columns == docs.columns
    scored = quality.score(docs, model)
    assert {r[0] for r in kept.select("doc_id").collect()} == {r[0] for r in scored.where("accepted").select("doc_id").collect()}


def test_awkward_rows_and_labels(spark, awkward, no_rows):
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (3, None), (7, 1), (7, 0), (None, 1), (8, 5)], "doc_id long, quality int")
    model = quality.train(awkward, labels)
    assert quality.score(awkward, model).count() == awkward.count()
    assert quality.score(no_rows, None).count() == 0
    assert quality.accepted(awkward, None).count() == awkward.count()
    assert quality.train(no_rows, labels) is None
    views = [(i, f"good text number {i}" if i % 2 else "BUY!! NOW!! $$$", None, None, 1) for i in range(60)]
    docs = spark.createDataFrame(views, no_rows.schema)
    model = quality.train(docs, spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int"))
    scored = {r["doc_id"]: r["accepted"] for r in quality.score(docs, model).collect()}
    assert all(scored[i] == bool(i % 2) for i in range(60))
    assert quality.accepted(awkward, model).columns == awkward.columns


def plain_training(rows, labels):
    """Views, rounds and calibration of ``train``, document by document. ``rows`` are (doc_id, text view, page view, in the fold)."""
    def odds(target, view, size):
        have, n = np.zeros((size, 2)), np.zeros(2)
        for doc, value in target.items():
            n[value] += 1
            for bucket in view[doc]:
                have[bucket, value] += 1
        n = np.maximum(n, 1)
        share = np.log((have + n / n.sum()) / n)
        return share[:, 1] - share[:, 0]

    def raw(weights, view):
        return float(np.clip(sum(weights[b] for b in view) / math.sqrt(max(len(view), 1)), -16, 16))

    def size_of(doc):
        return min(len(texts[doc]).bit_length(), quality.SIZES - 1)

    def calibrated(weights, view):
        points = np.zeros((quality.SIZES, quality.BINS, 2))
        for doc in fold:
            points[size_of(doc), min(int((raw(weights, view[doc]) + 16) / 32 * quality.BINS), quality.BINS - 1), labels[doc]] += 1
        x = [[(b + 0.5) / quality.BINS * 32 - 16, *(1.0 if s == k else 0.0 for k in range(quality.SIZES))] for s in range(quality.SIZES) for b in range(quality.BINS)]
        flat = points.reshape(-1, 2)
        w = quality.fit_logistic(np.array(x), flat[:, 1], flat[:, 0], np.array([1e-2] + [0.3] * quality.SIZES + [1e-2]))
        return weights, w[0], w[1:-1] + w[-1]

    def logit(model, view, doc):
        weights, slope, shifts = model
        return float(np.clip(slope * raw(weights, view[doc]) + shifts[size_of(doc)], -16, 16))

    texts, pages = {r[0]: r[1].tolist() for r in rows}, {r[0]: r[2].tolist() for r in rows}
    fold = [r[0] for r in rows if r[3] and r[0] in labels]
    given = {d: v for d, v in labels.items() if d in texts and d not in fold}
    text, page = (calibrated(odds(given, v, n), v) for v, n in ((texts, quality.TEXT_BUCKETS), (pages, quality.PAGE_BUCKETS)))
    for _ in range(quality.ROUNDS):
        for_text, for_page = dict(given), dict(given)
        for doc in texts:
            if doc not in labels:
                for target, p in ((for_text, 1 / (1 + math.exp(-logit(page, pages, doc)))), (for_page, 1 / (1 + math.exp(-logit(text, texts, doc))))):
                    if p >= quality.CONFIDENCE or p <= 1 - quality.CONFIDENCE:
                        target[doc] = int(p >= quality.CONFIDENCE)
        text, page = calibrated(odds(for_text, texts, quality.TEXT_BUCKETS), texts), calibrated(odds(for_page, pages, quality.PAGE_BUCKETS), pages)
    joint = np.zeros((quality.JOINT_BINS, quality.JOINT_BINS, 2))
    for doc in fold:
        place = [min(int((logit(m, v, doc) + 16) / 32 * quality.JOINT_BINS), quality.JOINT_BINS - 1) for m, v in ((text, texts), (page, pages))]
        joint[place[0], place[1], labels[doc]] += 1
    middle = [(b + 0.5) / quality.JOINT_BINS * 32 - 16 for b in range(quality.JOINT_BINS)]
    w = quality.fit_logistic(np.array([[a, b] for a in middle for b in middle]), joint.reshape(-1, 2)[:, 1], joint.reshape(-1, 2)[:, 0])
    return {d: 1 / (1 + math.exp(-np.clip(w[0] * logit(text, texts, d) + w[1] * logit(page, pages, d) + w[2], -30, 30))) for d in texts}


def test_scores_match_plain_training(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    buckets, rows = quality._TextBuckets(), []
    table = docs.select("*", (F.pmod(F.xxhash64("doc_id"), F.lit(quality.FOLDS)) == 0).alias("fold")).collect()
    for r in table:
        words = (r["text"] or "").encode().split()
        page = quality.page_view((r["text"] or "").encode(), words, r["source"], r["lang"])
        rows.append((r["doc_id"], quality.text_view([w.lower() for w in words], buckets), page, r["fold"]))
    expected = plain_training(rows, {r["doc_id"]: r["quality"] for r in labels.collect()})
    got = {r["doc_id"]: r["score"] for r in QUERIES["op3_cotrained_quality"](spark, sf_dir).collect()}
    assert got.keys() == expected.keys() and max(abs(got[d] - expected[d]) for d in got) < 1e-6


def test_the_regression_is_at_its_optimum():
    pick = np.random.default_rng(2)
    x, good, bad = pick.normal(0, 2, (50, 2)), pick.integers(0, 9, 50).astype(float), pick.integers(0, 9, 50).astype(float)
    w = quality.fit_logistic(x, good, bad)
    p = 1 / (1 + np.exp(-(x @ w[:2] + w[2])))
    rest = good - (good + bad) * p
    assert np.allclose([*(x * rest[:, None]).sum(axis=0) - 1e-2 * w[:2], rest.sum() - 1e-2 * w[2]], 0, atol=1e-6)
