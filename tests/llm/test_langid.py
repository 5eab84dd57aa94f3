import itertools

import numpy as np
import pytest

from auditflow.llm import langid
from auditflow.llm.queries import QUERIES


def test_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.01"
    got = QUERIES["op10_language_spans"](spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang"), "doc_id")
    rows = got.where("held_out and lang is not null").collect()
    assert len(rows) > 250 and sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.97 * len(rows)
    assert got.count() == 1000 and all(0 <= r["score"] <= 1 for r in rows)


@pytest.mark.parametrize("seed", range(4))
def test_viterbi_finds_the_best_path(seed):
    pick = np.random.default_rng(seed)
    texts = [pick.normal(0, 3, (n, 3)).astype(np.float32) for n in (6, 5, 5, 1)]
    for scores, path in zip(texts, langid.viterbi(texts, 2.0)):
        def value(p):
            return sum(scores[i, k] for i, k in enumerate(p)) - 2.0 * sum(a != b for a, b in zip(p, p[1:]))

        best = max(map(value, itertools.product(range(3), repeat=len(scores))))
        assert len(path) == len(scores) and abs(value(path.tolist()) - best) < 1e-4


def test_viterbi_stays_exact_in_long_texts():
    """A short outlier changes nothing behind it, after however many words."""
    n = 1_500_000
    scores = np.tile(np.array([[-2.0, -9.0]], np.float32), (n, 1))
    scores[-1000:-997] = [-9.0, -2.0]
    scores[1000:1100] = [-9.0, -2.0]
    (path,) = langid.viterbi([scores], 20.0)
    assert path[1000:1100].all() and path.sum() == 103 - 3 * (path[-1000:-997] == 0).all()
    (short,) = langid.viterbi([scores[-5000:]], 20.0)
    assert (path[-4000:] == short[-4000:]).all()


LINES = {
    "en": "the children were walking along the river while their mother was reading the newspaper in the garden with a friend",
    "de": "die kinder gingen am fluss entlang während ihre mutter mit einer freundin im garten die zeitung gelesen hat und dann schlief",
    "ru": "дети шли вдоль реки пока мать читала газету в саду вместе со своей подругой и слушала птиц",
}


@pytest.fixture(scope="module")
def model(spark):
    rows = [(i, text, lang) for i, (lang, text) in enumerate(LINES.items())]
    return langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))


def test_mixed_text_falls_into_spans(spark, model):
    text = LINES["en"] + ". " + LINES["de"] + " " + LINES["ru"]
    row = langid.label(spark.createDataFrame([(1, text)], "doc_id long, text string"), model, penalty=3.0).first()
    assert [s["lang"] for s in row["spans"]] == ["en", "de", "ru"]
    n = len(LINES["en"].split())
    assert abs(row["spans"][0]["end"] - n) <= 1 and row["spans"][-1]["end"] == len(langid.words_of(text))


def test_script_narrows_the_languages(spark, model):
    row = langid.label(spark.createDataFrame([(1, "щщщ ъъъ")], "doc_id long, text string"), model).first()
    assert row["lang_pred"] == "ru" and row["score"] == 1.0
    assert langid.SCRIPT_NAMES[langid.script_of("été".encode())] == "latin" and langid.SCRIPT_NAMES[langid.script_of("日本".encode())] == "han"


def test_awkward_rows(spark, model, awkward, no_rows):
    rows = langid.label(awkward, model).collect()
    assert len(rows) == awkward.count()
    by_id = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    assert all(by_id[i]["lang_pred"] == "und" and by_id[i]["score"] == 0 and by_id[i]["spans"] == [] for i in (4, 5, 6, 10))
    assert by_id[11]["lang_pred"] in ("de", "en")
    assert langid.label(no_rows, model).count() == 0
    nothing = langid.train(no_rows)
    assert {r["lang_pred"] for r in langid.label(awkward, nothing).collect()} == {"und"}


def plain_grams(word):
    out, padded = [], b" " + word + b" "
    for order in langid.ORDERS:
        for at in range(len(padded) - order + 1):
            code = 0
            for byte in padded[at : at + order]:
                code = (code * 257 + byte) % 2**32
            out.append((code + order) * 2654435761 % 2**32 >> 17)
    return out


def plain_model(rows):
    """Languages, log-probabilities of buckets, and admitted scripts, from (lang, text)."""
    languages = sorted({lang for lang, _ in rows})
    counts, scripts = np.zeros((langid.BUCKETS, len(languages))), np.zeros((len(langid.SCRIPT_NAMES), len(languages)))
    for lang, text in rows:
        for word in langid.words_of(text):
            scripts[langid.script_of(word), languages.index(lang)] += 1
            for bucket in plain_grams(word):
                counts[bucket, languages.index(lang)] += 1
    logs = np.log((counts + 0.5) / (counts + 0.5).sum(axis=0)) / len(langid.ORDERS)
    admitted = scripts >= 0.01 * np.maximum(scripts.sum(axis=0), 1)
    admitted[~admitted.any(axis=1)] = True
    return languages, logs, admitted


def plain_path(scores, penalty):
    best, ways = list(scores[0]), []
    for row in scores[1:]:
        top = max(range(len(best)), key=lambda k: best[k])
        ways.append([k if best[k] >= best[top] - penalty else top for k in range(len(best))])
        best = [max(best[k], best[top] - penalty) + row[k] for k in range(len(best))]
    at = max(range(len(best)), key=lambda k: best[k])
    path = [at]
    for way in reversed(ways):
        at = way[at]
        path.append(at)
    return path[::-1]


def test_model_and_labels_match_plain_versions(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    learned = docs.where(~langid.held_out()).where("text is not null and lang is not null").collect()
    languages, logs, admitted = plain_model([(r["lang"], r["text"]) for r in learned])
    model = langid.train(docs.where(~langid.held_out()))
    assert model.languages == languages and (model.admitted == admitted).all()
    assert np.allclose(model.logs, logs, atol=1e-5)
    found = {r["doc_id"]: r for r in langid.label(docs, model).collect()}
    cache = {}
    for r in docs.collect():
        words, got = langid.words_of(r["text"] or ""), found[r["doc_id"]]
        if not words:
            assert got["lang_pred"] == "und"
            continue
        for w in words:
            if w not in cache:
                cache[w] = logs[plain_grams(w)].sum(axis=0) - np.where(admitted[langid.script_of(w)], 0, 1e4)
        path = plain_path([cache[w] for w in words], langid.SWITCH_PENALTY)
        shares = [sum(len(w) for w, p in zip(words, path) if p == k) for k in range(len(languages))]
        assert got["lang_pred"] == languages[int(np.argmax(shares))] and abs(got["score"] - max(shares) / sum(shares)) < 1e-9
        assert [languages[p] for p in path] == [s["lang"] for s in got["spans"] for _ in range(s["start"], s["end"])]
