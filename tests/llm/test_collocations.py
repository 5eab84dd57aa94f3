"""Collocations against plain counting."""

import random
import re

import numpy as np
import pytest
from auditflow.llm import collocations as c
from auditflow.llm.queries import QUERIES


def plain(rows, least=10, top=2000):
    counts, totals = {}, {}
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            words = re.findall("[^\x20\x09]+", piece)
            totals[lang] = totals.get(lang, 0) + len(words)
            for k in (1, 2, 3):
                for i in range(len(words) - k + 1):
                    key = (lang, tuple(words[i : i + k]))
                    counts[key] = counts.get(key, 0) + 1
    found = {k: a for k, a in counts.items() if len(k[1]) > 1 and a >= least}
    out, longest = [], {}
    for (lang, q), b in found.items():
        for inner in (q[:-1], q[1:]) if len(q) == 3 else ():
            longest[lang, inner] = max(b, longest.get((lang, inner), 0))
    for (lang, p), a in found.items():
        if 100 * longest.get((lang, p), 0) >= 50 * a:
            continue
        cuts = [(counts[lang, p[:k]], counts[lang, p[k:]]) for k in range(1, len(p))]
        score, k = min((1_000_000 * a * a // (left * right), k) for k, (left, right) in enumerate(cuts))
        out.append((lang, " ".join(p), a, *cuts[k], totals[lang], score))
    ranked = []
    for lang in totals:
        mine = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))
        ranked += [(r[0], i, *r[1:]) for i, r in enumerate(mine[:top], 1)]
    return sorted(ranked)


def ours(df):
    return sorted((r["lang"], r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in df.collect())


def texts(seed, n=150):
    pick = random.Random(seed)
    words = ["Ä", "é!", "the", "The", "of", "new york", "\tx", "😀", "a\x00b", "ÉCOLE", "\x1c", "z."] + [f"w{i}" for i in range(8)]
    langs = ["en", "de", None, "und"]
    return [(pick.choice(langs), pick.choice([" ", "\t", "  "]).join(pick.choice(words) for _ in range(pick.randrange(60)))) for _ in range(n)]


@pytest.mark.parametrize("seed,shard_words,range_entries", [(1, 1 << 20, 1 << 21), (2, 200, 300), (3, 1, 1)])
def test_against_plain_counts(spark, seed, shard_words, range_entries):
    rows = texts(seed)
    df = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    assert ours(c.collocations(df, shard_words=shard_words, range_entries=range_entries)) == plain(rows)
    assert ours(c.collocations(df, least=3, top=7)) == plain(rows, 3, 7)


def test_awkward_rows_and_long_text(spark, awkward, no_rows):
    rows = [(r["lang"], r["text"]) for r in awkward.collect()]
    assert ours(c.collocations(awkward.withColumn("word", awkward.text), least=2)) == plain(rows, 2)
    assert ours(c.collocations(no_rows)) == []
    long = [("en", "one two three " * 50_000), ("en", None), ("fr", ""), (None, "...")]
    assert ours(c.collocations(spark.createDataFrame(long, "lang string, text string"))) == plain(long)


def test_lanes_are_undone():
    pick = np.random.default_rng(5)
    a, b, third = (pick.integers(0, 1 << 32, 10_000, dtype=np.uint64) for _ in range(3))
    x = pick.integers(0, 1 << 63, 10_000, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    assert (c.restored(c.permuted(x)) == x).all()
    for more in ((), (third,)):
        got = c.unpacked(*c.packed(a, b, *more), 2 + len(more))
        assert all((x == y).all() for x, y in zip(got, (a, b, *more)))


@pytest.mark.parametrize("ranges", [1, 7, 65536])
def test_filter_is_whole_again_from_its_stretches(ranges):
    pick = np.random.default_rng(ranges)
    lane, third = pick.integers(0, 1 << 63, 500, dtype=np.uint64) * np.uint64(2), pick.integers(0, 3, 500).astype(np.uint32)
    lane[250:] = lane[:250]
    whole = c.QuotientFilter.of(lane, third)
    parts = [c.QuotientFilter.stored(row, r, ranges) for r, row in whole.cut(ranges)] if ranges < 1000 else []
    for p in parts:
        assert len(p)
    if parts:
        assert (np.concatenate([p.lane for p in parts]) == whole.lane).all() and (np.concatenate([p.third for p in parts]) == whole.third).all()
    counted = {}
    for x in zip(lane.tolist(), third.tolist()):
        counted[x] = counted.get(x, 0) + 1
    assert dict(zip(zip(whole.lane.tolist(), whole.third.tolist()), whole.counts.tolist())) == counted


def test_scores_are_exact_for_large_counts(spark):
    a, left, right = 3_000_000_000_007, 7_000_000_000_009, 9_000_000_000_011
    row = spark.createDataFrame([(a, left, right)], "a long, l long, r long").select(c._score("a", "l", "r").alias("s")).first()
    assert row["s"] == 1_000_000 * a * a // (left * right)


def test_query_on_the_given_table(spark, sf_dir):
    rows = [(r["lang"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert ours(QUERIES["op12_collocations"](spark, sf_dir)) == plain(rows)
