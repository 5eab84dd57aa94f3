"""Hashes of large files by byte ranges, against hashes of the whole files."""

import hashlib
import random
import shutil

import pytest

from auditflow.plans import queries
from auditflow.sources import manifest, ranges

RANGE, LAST = 1024, 64
# Around whole ranges, and around the tenth by which a last split may be longer.
SIZES = {"a": 1025, "b": 1126, "c": 1127, "d": 2048, "e": 9999, "f": 4096 + 64, "g, {h}[i] *%20+é.x": 5000}


def written(folder, sizes):
    pick = random.Random(1)
    for name, size in sizes.items():
        (folder / name).write_bytes(pick.randbytes(size))
    return {f"file:{folder}/{name}": hashlib.sha256((folder / name).read_bytes()).hexdigest() for name in sizes}


def test_hash_by_ranges_is_that_of_the_file(spark, tmp_path):
    expected = written(tmp_path, SIZES)
    files = [(path, size) for path, size in zip(expected, SIZES.values(), strict=True)]
    assert ranges.sha256_by_ranges(spark, files, range_bytes=RANGE, last_bytes=LAST) == expected
    with pytest.raises(Exception, match="changed while"):
        ranges.sha256_by_ranges(spark, [(path, size + 2 * RANGE) for path, size in files], range_bytes=RANGE, last_bytes=LAST)


def test_fingerprints_read_large_files_by_ranges(spark, tmp_path, monkeypatch):
    expected = written(tmp_path, SIZES | {"small": 10, "small2": RANGE + 1, "packed.gz": 3000, "large_x": 3001})
    given = []
    whole = manifest.fingerprints
    monkeypatch.setattr(manifest, "fingerprints", lambda files: given.append(files) or whole(files))
    got = manifest.file_fingerprints(spark, str(tmp_path), one_row_bytes=RANGE + 1)
    assert got.columns == ["path", "file_name", "length", "sha256", "no_hash_reason"]
    assert {r.path.rsplit("/", 1)[1]: (r.sha256, r.no_hash_reason) for r in got.collect()} == {p.rsplit("/", 1)[1]: (h, None) for p, h in expected.items()}
    one_row = {r.file_name for files in given for r in files.select("file_name").collect()}
    assert one_row == {"small", "small2", "packed.gz", "a"}


def test_files_above_the_largest_row_have_a_hash(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(manifest, "LARGEST_BINARY_FILE", 2000)
    expected = written(tmp_path, {"large": 3000, "large.gz": 3001})
    got = {r.file_name: r for r in manifest.file_fingerprints(spark, str(tmp_path), one_row_bytes=RANGE).collect()}
    assert got["large"].sha256 == expected[f"file:{tmp_path}/large"] and got["large"].no_hash_reason is None
    assert got["large.gz"].sha256 is None and got["large.gz"].no_hash_reason


def test_no_task_reads_more_than_a_range(spark, tmp_path, monkeypatch):
    (tmp_path / "x").write_bytes(b"\n" * 10_000)
    seen = []
    run = type(spark.sparkContext).runJob

    def noted(context, rdd, *args):
        seen.extend((start, end) for _, start, end, _ in due[-1].values())
        return run(context, rdd, *args)

    due = []
    advance = ranges._Advance
    monkeypatch.setattr(ranges, "_Advance", lambda d: due.append(d) or advance(d))
    monkeypatch.setattr(type(spark.sparkContext), "runJob", noted)
    ranges.sha256_by_ranges(spark, [(f"file:{tmp_path}/x", 10_000)], range_bytes=RANGE, last_bytes=LAST)
    assert all(end - start <= RANGE * 1.1 for start, end in seen)
    assert [start for start, _ in seen] == [0] + [end for _, end in seen[:-1]] and seen[-1][1] == 10_000


def test_file_manifest_hashes_large_tables(spark, sf_dir, tmp_path, monkeypatch):
    """With bounds as small as these tables: files above them have a hash, their rows and no reason."""
    for table in queries.TABLES:
        shutil.copy(f"{sf_dir}/{table}.parquet", tmp_path)
    (tmp_path / "note.txt").write_text("no table")
    monkeypatch.setitem(manifest.file_fingerprints.__kwdefaults__, "one_row_bytes", 64 << 10)
    monkeypatch.setattr(manifest, "LARGEST_BINARY_FILE", 100_000)
    got = {r.file_name: r for r in queries.QUERIES["file_manifest"](spark, str(tmp_path)).collect()}
    assert set(got) == {f"{t}.parquet" for t in queries.TABLES} | {"note.txt"}
    assert any(r.length > 100_000 for r in got.values())
    for name, r in got.items():
        assert r.sha256 == hashlib.sha256((tmp_path / name).read_bytes()).hexdigest()
        table = name.removesuffix(".parquet")
        if table != name:
            assert (r.table_name, r.row_count, r.reject_reason) == (table, spark.read.parquet(str(tmp_path / name)).count(), None)
        else:
            assert (r.table_name, r.row_count, r.reject_reason) == (None, None, "Extension not allowed: .txt")


def test_csv_manifest_hashes_large_files(spark, tmp_path, monkeypatch):
    (tmp_path / "orders.csv").write_text("a,b\n" + "1,2\n" * 20_000)
    monkeypatch.setitem(manifest.file_fingerprints.__kwdefaults__, "one_row_bytes", 16 << 10)
    monkeypatch.setattr(manifest, "LARGEST_BINARY_FILE", 32 << 10)
    r = manifest.csv_manifest(spark, str(tmp_path)).first()
    assert (r.sha256, r.row_count, r.column_count) == (hashlib.sha256((tmp_path / "orders.csv").read_bytes()).hexdigest(), 20_000, 2)
