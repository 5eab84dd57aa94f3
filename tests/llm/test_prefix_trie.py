"""The trie of rebuilt conversations against one built from texts."""

import hashlib
import random
import zlib

import pytest
from auditflow.llm import prefix_trie as trie
from auditflow.llm.queries import QUERIES

SCHEMA = "conv_id long, turn long, role string, text string, ref string, node string, depth string"


def plain(rows):
    talks = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            ref = hashlib.sha256(f"{len(role)} {role}{text}".encode()).hexdigest()
            talks.setdefault(c, []).append((turn is not None, turn or 0, ref, role, text))
    talks = {c: [x[3:] for x in sorted(t)] for c, t in talks.items()}
    rebuilt = {}
    for c, own in talks.items():
        h = zlib.crc32(str(c).encode()) % 4
        rebuilt[c] = tuple(talks.get(c - c % 20, [])[:h] + own[h:])
    members = {}
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    figures = {}
    for p in sorted(members, key=len, reverse=True):
        children = [q for q in members if len(q) == len(p) + 1 and q[: len(p)] == p]
        words = len(p[-1][1].encode().split()) if p else 0
        leaves = sum(figures[q][0] for q in children) or 1
        saved = sum(figures[q][1] for q in children) + (len(members[p]) - 1) * words
        figures[p] = (leaves, saved)
        ends = ",".join(str(c) for c in sorted(members[p]) if len(rebuilt[c]) == len(p))
        row = (min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(children), leaves, saved)
        figures[p] += (row + (hashlib.sha256(ends.encode()).hexdigest(),),)
    return sorted(f[2] for f in figures.values())


def ours(df):
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def talks(seed, n=120, texts=3, longest=7):
    pick = random.Random(seed)
    rows = []
    for _ in range(n):
        c = pick.choice([pick.randrange(60), 20 * pick.randrange(4), pick.randrange(10**12)])
        rows += [(c, t, pick.choice(["user", "bot"]), "say " * pick.randrange(texts)) for t in range(pick.randrange(1, longest))]
    seen = {}
    for r in rows:
        seen.setdefault((r[0], r[1]), r)
    return list(seen.values())


def frame(spark, rows, parts=4):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA).repartition(parts)


@pytest.mark.parametrize("seed", range(3))
def test_random_conversations(spark, seed, monkeypatch):
    rows = talks(seed)
    monkeypatch.setattr(trie, "BLOCK", [1 << 12, 2, 1][seed])  # conversations cut into blocks of depths, too
    assert ours(trie.prefix_trie(frame(spark, rows))) == plain(rows)


def test_ties_nulls_and_repeated_rows(spark):
    rows = [
        (0, None, "user", "a"), (0, None, None, None), (0, 1, "user", "b"), (0, 1, "bot", "b"), (0, 1, "bot", "b"), (1, None, "user", "a"),
        (1, None, None, None), (2, 0, "", ""), (3, 5, "user", " \t\x0b"), (None, 1, "user", "a"), (21, 0, "us", "ercd"), (22, 0, "user", "cd"), (4, 0, "x", "y" * 100_000),
    ]
    assert ours(trie.prefix_trie(frame(spark, rows))) == plain(rows)


def test_one_conversation_of_many_turns_is_cut(spark, monkeypatch):
    monkeypatch.setattr(trie, "BLOCK", 16)
    rows = [(20, t, "user", f"turn {t % 3}") for t in range(300)] + [(20, None, "user", "again")] * 40
    rows += [(21, t, "user", f"turn {t % 3}") for t in range(290)] + [(45, 0, "user", "hi")]
    df = frame(spark, rows, 8)
    assert trie.stored_prefixes(df.select("conv_id", "turn", "role", "text"), 0).where("conv_id = 20").selectExpr("max(pos)", "count(distinct pos)").first()[:] == (340, 340)
    assert ours(trie.prefix_trie(df)) == plain(rows)


def test_turnless_and_absent_bases(spark):
    lone = [(c, 0, "user", "t") for c in range(101, 119)]  # no conversation 100; those with h > 0 lose their only turn
    assert ours(trie.prefix_trie(frame(spark, lone))) == plain(lone)
    none = [(c, 0, "user", "t") for c in range(101, 119) if zlib.crc32(str(c).encode()) % 4]
    assert len(plain(none)) == 1
    assert ours(trie.prefix_trie(frame(spark, none))) == plain(none)


def test_no_rows(spark):
    assert trie.prefix_trie(spark.createDataFrame([], SCHEMA)).count() == 0


def test_colliding_fingerprints_are_found_and_another_base_is_taken(spark, monkeypatch):
    rows = [*talks(7, 40), (200, 0, "user", "a"), (200, 1, "user", "b"), (220, 0, "user", "b"), (220, 1, "user", "a")]
    real, tried = trie._base, []

    def first_is_one(attempt):
        tried.append(attempt)
        return 1 if attempt == 0 else real(attempt)  # with base 1 the order of turns doesn't count

    monkeypatch.setattr(trie, "_base", first_is_one)
    with pytest.raises(ValueError, match="collided"):
        trie.prefix_trie(frame(spark, rows), attempts=1)
    tried.clear()
    assert ours(trie.prefix_trie(frame(spark, rows))) == plain(rows)
    assert set(tried) == {0, 1}


def test_query_on_the_given_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert ours(QUERIES["op11_prefix_trie"](spark, sf_dir)) == plain(rows)
