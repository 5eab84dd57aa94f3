"""Digests of files by blocks, against hashes of whole files in memory."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from auditflow.sources import blocks

BLOCK, FAN = 16, 3


def plain(data):
    level = [hashlib.sha256(b"\0" + data[i : i + BLOCK]).digest() for i in range(0, max(len(data), 1), BLOCK)]
    while True:
        level = [hashlib.sha256(b"\1" + b"".join(level[i : i + FAN])).digest() for i in range(0, len(level), FAN)]
        if len(level) == 1:
            return level[0].hex()


def tree_of(spark, folder):
    read = blocks.block_digests(spark, str(folder), block_bytes=BLOCK, partition_bytes=2 * BLOCK)
    return blocks.merkle_tree(read, fan=FAN)


@pytest.fixture
def files(tmp_path):
    pick = random.Random(1)
    sizes = {"empty": 0, "one": 1, "block": BLOCK, "more": BLOCK + 1, "fan": BLOCK * FAN, "deep": BLOCK * FAN**3 + 5, "sub/x": 100}
    (tmp_path / "sub").mkdir()
    for name, size in sizes.items():
        (tmp_path / name).write_bytes(pick.randbytes(size))
    return tmp_path


def test_every_file_has_a_digest(spark, files):
    got = {r["path"]: r["digest"] for r in blocks.file_digests(tree_of(spark, files)).collect()}
    expected = {str(f): plain(f.read_bytes()) for f in files.rglob("*") if f.is_file()}
    assert got == expected
    read = blocks.block_digests(spark, str(files), block_bytes=BLOCK, partition_bytes=2 * BLOCK)
    assert read.rdd.getNumPartitions() > len(expected)  # a file is read by several tasks
    sizes = {r["path"]: (r["a"], r["b"]) for r in read.groupBy("path").agg(F.sum("block_bytes").alias("a"), F.max("file_bytes").alias("b")).collect()}
    assert all(sizes[str(f)] == (f.stat().st_size,) * 2 for f in files.rglob("*") if f.is_file())


def test_changed_blocks(spark, files):
    before = tree_of(spark, files)
    assert blocks.changed_blocks(before, before, fan=FAN).count() == 0
    deep = bytearray((files / "deep").read_bytes())
    deep[BLOCK * 7] ^= 1
    deep[BLOCK * 20 + 3] ^= 1
    (files / "deep").write_bytes(deep + b"longer by more than a block")
    (files / "block").write_bytes(b"")
    (files / "one").unlink()
    (files / "new").write_bytes(b"n" * 40)
    got = {(r["path"].rsplit("/", 1)[1], r["block"], r["change"]) for r in blocks.changed_blocks(before, tree_of(spark, files), fan=FAN).collect()}
    assert got == {
        ("deep", 7, "changed"), ("deep", 20, "changed"), ("deep", 27, "changed"), ("deep", 28, "added"), ("block", 0, "changed"),
        ("one", 0, "removed"), ("new", 0, "added"), ("new", 1, "added"), ("new", 2, "added"),
    }


def test_a_file_that_grows_a_level(spark, tmp_path):
    (tmp_path / "f").write_bytes(b"a" * BLOCK * FAN)
    before = tree_of(spark, tmp_path)
    (tmp_path / "f").write_bytes(b"a" * BLOCK * FAN * FAN + b"b")
    after = tree_of(spark, tmp_path)
    got = {(r["block"], r["change"]) for r in blocks.changed_blocks(before, after, fan=FAN).collect()}
    assert got == {(b, "added") for b in range(FAN, FAN * FAN + 1)}


def test_no_files(spark, tmp_path):
    assert blocks.file_digests(tree_of(spark, tmp_path)).count() == 0
