"""Digests of files of any size: byte ranges read side by side, and a tree over their digests.

A file is cut into blocks of fixed size. ``FileBlocks`` is a data source whose partitions are byte
ranges, so a file of any size is hashed by many tasks, each holding one block at a time. Above the
blocks stands a Merkle tree: a node is the digest of up to ``FAN`` digests below it, and the root
stands for the whole file. Two trees are compared from the roots down, so only the blocks under
unequal nodes are looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from auditflow.session import durable, ship_package

BLOCK_BYTES = 8 << 20
#: Bytes that a task reads, about.
PARTITION_BYTES = 256 << 20
#: Digests below a node of the tree.
FAN = 1024
_SCHEMA = "path string, file_bytes long, block long, block_bytes long, digest string"


@dataclass
class Blocks(InputPartition):
    """Consecutive blocks of one file."""

    path: str
    file_bytes: int
    first: int
    end: int


def _opened(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


class _BlockReader(DataSourceReader):
    def __init__(self, path: str, block_bytes: int, partition_bytes: int):
        self.path, self.block_bytes = path, block_bytes
        self.per_partition = max(1, partition_bytes // block_bytes)

    def partitions(self) -> Sequence[InputPartition]:
        from pyarrow import fs

        system, root = _opened(self.path)
        found = system.get_file_info(root)
        files = [found] if found.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root, recursive=True))
        out: list[InputPartition] = []
        for file in sorted((f for f in files if f.type == fs.FileType.File), key=lambda f: f.path):
            blocks = max(1, -(-file.size // self.block_bytes))  # an empty file has one empty block
            out += [Blocks(file.path, file.size, a, min(a + self.per_partition, blocks)) for a in range(0, blocks, self.per_partition)]
        return out

    def read(self, partition: Blocks | None) -> Iterator[tuple]:
        if partition is None:  # no files
            return
        system, _ = _opened(self.path)
        with system.open_input_file(partition.path) as file:
            for block in range(partition.first, partition.end):
                start = block * self.block_bytes
                n = min(self.block_bytes, partition.file_bytes - start)
                data = file.read_at(n, start)
                if len(data) != n:
                    raise OSError(f"{partition.path} changed while it was read")
                yield partition.path, partition.file_bytes, block, n, hashlib.sha256(b"\0" + data).hexdigest()


class FileBlocks(DataSource):
    """``path``, and optionally ``blockBytes`` and ``partitionBytes``: a digest per block of every file below the path."""

    @classmethod
    def name(cls) -> str:
        return "file_blocks"

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema) -> DataSourceReader:
        options = self.options
        return _BlockReader(options["path"], int(options.get("blockBytes", BLOCK_BYTES)), int(options.get("partitionBytes", PARTITION_BYTES)))


def block_digests(spark: SparkSession, path: str, *, block_bytes: int = BLOCK_BYTES, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """path, file_bytes, block, block_bytes, digest of every block of the files at or below ``path``.

    A digest covers a zero byte and the block's bytes. An empty file has one empty block.
    """
    ship_package(spark)
    spark.dataSource.register(FileBlocks)
    return spark.read.format("file_blocks").options(path=path, blockBytes=str(block_bytes), partitionBytes=str(partition_bytes)).load()


def merkle_tree(blocks: DataFrame, *, fan: int = FAN) -> DataFrame:
    """path, level, node, digest: blocks are level 0, a node covers ``fan`` nodes of the level below, the highest is the root.

    A digest covers a byte of value one and the digests below in order. A file has as many levels as it
    needs, at least two. Blocks are read once; a level is as small as the one below divided by
    ``fan``. One row of the largest block number is fetched to know how many levels there are.
    """
    level = durable(blocks.select("path", F.col("block").alias("node"), "digest"))
    most = level.agg(F.max("node")).first()[0]
    tree, number, width = level.withColumn("level", F.lit(0)), 0, (most or 0) + 1
    sizes = level.groupBy("path").agg((F.max("node") + 1).alias("n"))
    while most is not None and (width > 1 or number == 0):
        number, width = number + 1, -(-width // fan)
        packed = F.array_sort(F.collect_list(F.struct("node", "digest")))  # at most ``fan`` of them
        joined = F.concat(F.lit(b"\x01"), F.unhex(F.array_join(F.transform("below", lambda s: s["digest"]), "")))
        level = level.groupBy("path", F.floor(F.col("node") / fan).alias("node")).agg(packed.alias("below"))
        level = level.select("path", "node", F.sha2(joined, 256).alias("digest"))
        # Files whose root is lower already don't go on.
        if number > 1:
            level = level.join(sizes.where(F.col("n") > fan ** (number - 1)).select("path"), "path", "left_semi")
        tree = tree.unionByName(level.withColumn("level", F.lit(number)))
    return durable(tree.select("path", "level", "node", "digest"))


def file_digests(tree: DataFrame) -> DataFrame:
    """path and digest (that of the root) of every file."""
    return tree.groupBy("path").agg(F.max_by("digest", "level").alias("digest"))


def changed_blocks(before: DataFrame, after: DataFrame, *, fan: int = FAN) -> DataFrame:
    """path, block and change (``added``, ``removed`` or ``changed``) between two trees of the same block size and fan.

    From the highest level down, only nodes below unequal ones are compared, so blocks of unchanged
    files aren't looked at.
    """
    roots = [t.groupBy("path").agg(F.max("level").alias("height")) for t in (before, after)]
    trees = [t.join(r, "path").withColumn("is_root", F.col("level") == F.col("height")) for t, r in zip((before, after), roots)]
    top = max(t.agg(F.max("level")).first()[0] or 0 for t in (before, after))
    old, new = F.col("old.digest"), F.col("new.digest")
    below = before.sparkSession.createDataFrame([], "path string, above long")
    for level in range(top, -1, -1):
        # Roots, and what stands under a node that is not equal.
        sides = [
            t.where(F.col("level") == level).withColumn("above", F.floor(F.col("node") / fan))
            .join(below.withColumn("unequal", F.lit(True)), ["path", "above"], "left")
            .where("is_root or unequal").select("path", "node", "digest")
            for t in trees
        ]
        change = F.when(old.isNull(), "added").when(new.isNull(), "removed").otherwise("changed")
        found = sides[0].alias("old").join(sides[1].alias("new"), ["path", "node"], "full_outer").where(~old.eqNullSafe(new))
        found = durable(found.select("path", "node", change.alias("change")))
        below = found.select("path", F.col("node").alias("above"))
    return found.select("path", F.col("node").alias("block"), "change")
