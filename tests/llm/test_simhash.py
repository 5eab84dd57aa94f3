import itertools
import random

import pytest
import xxhash

from auditflow.llm.queries import QUERIES
from auditflow.llm.simhash import _signed, components, covering_masks, links, near_duplicates


def plain_print(text):
    words = (text or "").encode().lower().split()
    n = min(3, len(words))
    shingles = [b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes)) if hashes else 0


def plain(rows):
    prints = [(i, plain_print(t)) for i, t in rows]
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(prints)), 2):
        if (prints[a][1] ^ prints[b][1]).bit_count() <= 2:
            root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(prints):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return sorted(((i, f"{p:016x}", least.get(find(k))) for k, (i, p) in enumerate(prints)), key=repr)


def ours(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_query_matches_plain_version_on_whole_table(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    assert ours(QUERIES["op7_covering_simhash"](spark, sf_dir)) == plain(rows)


def test_awkward_rows(awkward, no_rows):
    rows = [tuple(r) for r in awkward.select("doc_id", "text").collect()]
    assert ours(near_duplicates(awkward)) == plain(rows)
    assert near_duplicates(no_rows).count() == 0


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_masks_cover_every_pair_within_the_radius(radius):
    masks = covering_masks(radius)
    assert len(masks) == 2 ** (radius + 1) - 1
    for bits in itertools.combinations(range(0, 64, 1 if radius < 3 else 5), radius):
        assert any(all(not m >> b & 1 for b in bits) for m in masks)


def test_links_join_exactly_the_close_prints(spark):
    pick = random.Random(3)
    prints = {0, 2**64 - 1}
    for _ in range(60):
        p = pick.getrandbits(64)
        prints.add(p)
        for _ in range(pick.randrange(4)):  # chains of near prints
            for b in pick.sample(range(64), pick.choice([1, 2, 3])):
                p ^= 1 << b
            prints.add(p)
    base = pick.getrandbits(64)
    prints |= {base ^ (1 << b) for b in range(64)}  # every pair is two bits apart
    prints = sorted(prints)
    nodes = spark.createDataFrame([(_signed(p), i) for i, p in enumerate(prints)], "fp long, node long")
    got = {r["node"]: r["component"] for r in components(links(nodes)).collect()}
    root = {i: i for i in range(len(prints))}
    changed = True
    while changed:
        changed = False
        for a, b in itertools.combinations(range(len(prints)), 2):
            if (prints[a] ^ prints[b]).bit_count() <= 2 and root[a] != root[b]:
                root[a] = root[b] = min(root[a], root[b])
                changed = True
    assert {i: got.get(i, i) for i in root} == root


def test_long_chain_of_links(spark):
    edges = spark.range(300).selectExpr("id * 7 % 300 AS u", "(id + 1) * 7 % 300 AS v").where("u != 0 and v != 0")
    got = {r["node"]: r["component"] for r in components(edges).collect()}
    assert set(got.values()) == {1} and len(got) == 299
