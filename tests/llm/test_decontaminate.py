import hashlib
import re

import numpy as np
import pytest

from auditflow.llm import decontaminate
from auditflow.llm.decontaminate import intersect, search
from auditflow.llm.queries import QUERIES

PATTERN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain(docs, items, window=13):
    def words_of(t):
        return PATTERN.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))

    windows = {}
    for item, text in items:
        words = words_of(text)
        n = min(window, len(words))
        for p in range(len(words) - n + 1 if words and item is not None else 0):
            windows.setdefault(tuple(words[p : p + n]), set()).add(str(item))
    out = []
    for doc_id, text in docs:
        words, hit, found = words_of(text), set(), set()
        for n in {len(w) for w in windows}:
            for p in range(len(words) - n + 1):
                if (key := tuple(words[p : p + n])) in windows:
                    found |= windows[key]
                    hit.update(range(p, p + n))
        out.append((doc_id, len(words), len(hit), tuple(sorted(found))))
    return sorted(out, key=repr)


def ours(df):
    return sorted(((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["item_ids"])) for r in df.collect()), key=repr)


def test_query_matches_plain_version_on_whole_table(spark, sf_dir):
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet").select(k, "text").collect() for t, k in (("documents", "doc_id"), ("benchmark", "item_id")))
    expected = [
        (i, n, h, len(x), hashlib.sha256(",".join(x).encode()).hexdigest(), h > 0 and 20 * h >= n) for i, n, h, x in plain(docs, items)
    ]
    assert sorted((tuple(r)[:6] for r in QUERIES["op4_decontamination"](spark, sf_dir).collect()), key=repr) == sorted(expected, key=repr)
    assert any(x[5] for x in expected)


@pytest.mark.parametrize("block_words", [50, 500_000])
def test_short_repeated_and_empty_items(spark, awkward, block_words):
    items = [(1, "stone3"), (2, "Stone3"), (3, ""), (4, None), (None, "river1"), (5, "two three four five"), (6, "là ça va"), (7, "x"), (5, "x")]
    table = spark.createDataFrame(items, "item_id long, text string")
    docs = [tuple(r) for r in awkward.select("doc_id", "text").collect()]
    assert ours(search(awkward, table, block_words=block_words)) == plain(docs, items)


def test_empty_tables(spark, awkward, no_rows):
    none = spark.createDataFrame([], "item_id long, text string")
    assert all(r["n_hit"] == 0 for r in search(awkward, none).collect())
    assert search(no_rows, none).count() == 0


def test_proximity(spark):
    items = spark.createDataFrame([(1, "alpha beta gamma delta")], "item_id long, text string")
    rows = [(1, "alpha beta gamma delta"), (2, "alpha very beta gamma delta"), (3, "alpha one two three beta gamma delta")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_hit"], r["n_near_items"]) for r in search(docs, items, slop=1).collect()}
    assert got == {1: (4, 0), 2: (0, 1), 3: (0, 0)}
    with pytest.raises(ValueError):
        search(docs, items, slop=decontaminate.GAP)


def test_a_near_phrase_belongs_to_the_document_of_its_words(spark):
    items = spark.createDataFrame([(1, "alpha beta gamma delta"), (2, "one two")], "item_id long, text string")
    # The rarest word, delta, stands one place early at the beginning of document 2.
    rows = [(1, "alpha one"), (2, "alpha gamma beta delta one two"), (3, "beta delta alpha gamma"), (4, "gamma alpha beta"), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = {r["doc_id"]: (r["n_hit"], r["n_near_items"]) for r in search(docs, items, slop=1).collect()}
    assert got == {1: (0, 0), 2: (2, 1), 3: (0, 0), 4: (0, 0), 5: (0, 0)}
    # Seen from delta, the phrase would begin two places before document 2.
    early = spark.createDataFrame([(1, "alpha beta gamma"), (2, "alpha delta beta gamma"), (3, "y")], "doc_id long, text string").coalesce(1)
    assert {r["doc_id"]: r["n_near_items"] for r in search(early, items, slop=3).collect()} == {1: 0, 2: 1, 3: 0}
    found = [tuple(r) for r in decontaminate.matches(early, items, slop=3).collect()]
    assert found == [(2, "1", 0, 4, False)]


@pytest.mark.parametrize("block_words", [40, 500_000])
def test_matches_are_all_places(spark, block_words):
    items = [(1, "stone3 river1"), (2, "x y"), (3, "stone3 river1 stone3"), (4, "x y")]
    rows = [(1, "stone3 river1 stone3 river1"), (2, "x y x"), (2, "q x y"), (None, "x y"), (5, "")] + [(10 + i, "x") for i in range(30)]
    docs, table = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = sorted(map(tuple, decontaminate.matches(docs, table, block_words=block_words).collect()), key=repr)
    expected = [
        (i, str(k), p, len(t.split()), True) for i, text in rows for k, t in items for p in range(len(text.split())) if text.split()[p : p + len(t.split())] == t.split()
    ]
    assert got == sorted(expected, key=repr)
    assert decontaminate.matches(docs.where("false"), table).count() == 0


def test_lists_meet_at_the_moved_places():
    lists = {"a": np.array([0, 5, 9]), "b": np.array([1, 7, 10]), "c": np.array([2, 3, 11])}
    assert intersect(lists, ["a", "b", "c"]).tolist() == [0, 9]
    assert intersect(lists, ["a", "b", "a"]).tolist() == []
