import hashlib
import random

import pyarrow as pa
import pytest

from auditflow.llm.queries import QUERIES
from auditflow.llm.substring_dedup import LETTERS, Blocks, _located, remove_repeats
from tests.llm.conftest import prose


def plain(rows, window):
    first = {}
    texts = [(i, (t or "").encode().split()) for i, t in rows]
    for i, words in texts:
        for p in range(len(words) - window + 1 if i is not None else 0):
            key = tuple(words[p : p + window])
            first[key] = min(i, first.get(key, i))
    out = []
    for i, words in texts:
        gone = set()
        for p in range(len(words) - window + 1 if i is not None else 0):
            if first[tuple(words[p : p + window])] < i:
                gone.update(range(p, p + window))
        kept = b" ".join(w for p, w in enumerate(words) if p not in gone)
        out.append((i, len(words), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def ours(df):
    return sorted((tuple(r)[:4] for r in df.collect()), key=repr)


def test_query_matches_plain_version_on_whole_table(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    assert ours(QUERIES["op2_substring_dedup"](spark, sf_dir)) == plain([tuple(r) for r in rows], 50)


@pytest.mark.parametrize("seed", range(3))
def test_short_windows_over_many_unequal_blocks(spark, seed):
    shared = prose(seed, 12)
    rows = [(i, f"{prose(100 + i % 7, 5)} {shared} {prose(200 + i % 5, 6)} {shared if i % 3 else ''}") for i in range(40)]
    rows += [(50, "a " * 30), (51, "a " * 25), (52, "a " * 7 + "b"), (None, shared), (53, shared)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = remove_repeats(df, window=8, anchor=3, shard_bytes=2000)
    assert ours(got) == plain(rows, 8)


def repeated_segments(seed, n, window, ids):
    """Texts made of few segments, which stand several times in a text, too."""
    pick = random.Random(seed)
    segments = [prose(1000 * seed + i, pick.randrange(window // 2, 2 * window)) for i in range(12)]
    return [(ids(i), " ".join(pick.choice(segments) for _ in range(pick.randrange(1, 9)))) for i in range(n)]


@pytest.mark.parametrize("window,n", [(8, 80), (50, 60)])
@pytest.mark.parametrize("repeated", [False, True])
def test_segments_repeated_inside_texts(spark, window, n, repeated):
    tables = [repeated_segments(seed, n, window, (lambda i: i % 17) if repeated else (lambda i: i)) for seed in range(10)]
    for rows in tables:
        df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
        got = remove_repeats(df, window=window, anchor=window // 3, shard_bytes=20_000) if window == 8 else remove_repeats(df)
        assert ours(got) == plain(rows, window)


def test_awkward_rows(spark, awkward, no_rows):
    rows = [tuple(r) for r in awkward.select("doc_id", "text").collect()]
    got = remove_repeats(awkward)
    assert ours(got) == plain(rows, 50)
    assert remove_repeats(no_rows).count() == 0


def test_equal_windows_have_equal_anchors():
    blocks, words = Blocks(10, 4), prose(5, 300).encode().split()
    seen = {}
    texts = [b" ".join([b"x"] * shift + words) for shift in (0, 3)]
    number, anchors, _, firsts, sizes = blocks.of([texts[0], b"", b"too short", texts[1]])
    for text, anchor, first, n in zip(number.tolist(), anchors.tolist(), firsts.tolist(), sizes.tolist()):
        shift = {0: 0, 3: 3}[text]
        for p in range(first, first + n - 9):
            if p >= shift:
                assert seen.setdefault(p - shift, anchor) == anchor
    assert len(seen) == 291


def test_rows_of_one_identifier_keep_their_own_passages(spark):
    a, z = prose(61, 300), prose(62, 300)
    rows = [(1, a), (5, a), (5, z), (5, z), (5, a), (None, a), (None, a), (None, None)]
    got = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    left = sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in got.collect()), key=repr)
    none = [(None, 300, 0, a)] * 2 + [(None, 0, 0, "")]
    assert left == sorted([(1, 300, 0, a)] + [(5, 300, 300, "")] * 2 + [(5, 300, 0, z)] * 2 + none, key=repr)


def located(rows, passages, points=LETTERS):
    """(n_removed, kept_text) of each text; rows are (doc_id, text), passages (row number, start, n, owner)."""
    ids, texts = zip(*rows)
    docs = pa.table({"doc_id": pa.array(ids, pa.int64()), "row_key": range(len(ids)), "text": texts, "copies": [1] * len(ids)})
    asked = pa.table(dict(zip(("row_key", "start", "n", "owner"), zip(*passages))))
    out = _located(True, points)(docs, asked)
    return list(zip(out["n_removed"].to_pylist(), out["kept_text"].to_pylist()))


def test_more_words_than_letters_are_located_all_the_same():
    text = prose(71, 200)
    rows = [(1, text), (5, f"new {text} end"), (7, " ".join(text.split()[1:])), (3, prose(72, 50))]
    passages = [(1, 1, 200, 1), (2, 20, 60, 1)]
    assert located(rows, passages, range(0x10000, 0x10000 + 60)) == located(rows, passages)
    assert located(rows, passages)[1] == (200, "new end")


def test_a_long_text_of_over_a_million_different_words():
    words = [f"{i:x}" for i in range(len(LETTERS) + 1000)]
    rows = [(1, "x y"), (5, " ".join(["new", *words, "end"]))]
    passages = [(1, at, min(80, len(words) + 1 - at), 1) for at in range(1, len(words) + 1, 40)]
    assert located(rows, passages) == [(0, "x y"), (len(words), "new end")]
