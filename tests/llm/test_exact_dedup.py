import hashlib
import re

import duckdb
import pytest

from auditflow.llm.exact_dedup import deduplicate
from auditflow.llm.oracle import ORACLE
from auditflow.llm.queries import QUERIES
from tests.llm.conftest import stored


def plain(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((i, len(t or "")))
    out = []
    for body, members in groups.items():
        keep = min(members, key=lambda m: (-m[1], m[0] is None, m[0] or 0))[0]
        out += [(i, keep, len(members), hashlib.sha256(body.encode()).hexdigest()) for i, _ in members]
    return sorted(out, key=repr)


def ours(df):
    return sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in df.collect()), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, sf_dir, name):
    duck = duckdb.connect()
    for table in ("documents", "pages", "conversations"):
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    cursor = duck.execute(ORACLE[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    theirs = sorted(repr(tuple(r[names.index(c)] for c in columns)) for r in cursor.fetchall())
    assert sorted(repr(tuple(r[c] for c in columns)) for r in df.collect()) == theirs


@pytest.mark.parametrize("bits,files", [(256, 16), (4, 16), (256, 1)])
def test_awkward_rows_in_small_batches_and_with_colliding_digests(spark, awkward, tmp_path, bits, files):
    rows = [tuple(r) for r in awkward.select("doc_id", "text").collect()]
    got = deduplicate(spark, stored(awkward, tmp_path), digest_bits=bits, files_per_batch=files).collect()
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=repr) == plain(rows)
    kept = [r["text_sha256"] for r in got if r["kept"]]
    assert len(kept) == len(set(kept)) == len({r["text_sha256"] for r in got})
    assert all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])


def test_no_rows(spark, no_rows, tmp_path):
    assert deduplicate(spark, stored(no_rows, tmp_path, 1)).count() == 0
