"""SHA-256 of large files, of which no task reads more than one byte range.

SHA-256 is sequential: a byte can be hashed only when all bytes before it are. So ranges of one file
are hashed one after the other, each by a task that begins with the state (112 bytes) in which the
task before it ended; ranges of different files are hashed side by side. ``hashlib`` does not give
its state away, so the functions of the library that it stands on are called; where it has none,
``available`` is false.

Ranges are splits of Hadoop's ``FixedLengthInputFormat``, so files may lie in any store that Spark
reads. It has no record for the bytes that are left over at the end of a file, so the last split of
a file is cut again by halves of the length, down to a split that is read byte by byte.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterable, Iterator, Sequence
from functools import cache

from pyspark.sql import SparkSession

from auditflow.session import ship_package

#: Bytes that a task reads; the last of a file up to a tenth more.
RANGE_BYTES = 128 << 20
#: Splits of this length are read byte by byte; longer ones where this makes more than ``MOST_SPLITS``.
LAST_BYTES = 256 << 10
MOST_SPLITS = 1 << 17
RECORD_BYTES = 64 << 10
#: Names of files that Hadoop's input formats leave out, or read through their codec as one split.
NOT_BY_RANGES = r"^[_.]|\.(gz|bz2|deflate|snappy|lz4|zst|passthrough)$"
_STATE_BYTES = 112  # SHA256_CTX: eight words, the length, a block not yet full and its length, the digest's length


@cache
def _library():
    """The SHA-256 functions behind ``hashlib``, or null if there are none that it agrees with."""
    try:
        import _hashlib

        found = ctypes.CDLL(_hashlib.__file__)
        found.SHA256_Init.argtypes = [ctypes.c_char_p]
        found.SHA256_Update.argtypes = [ctypes.c_char_p, ctypes.c_char_p, ctypes.c_size_t]
        found.SHA256_Final.argtypes = [ctypes.c_char_p, ctypes.c_char_p]
    except (ImportError, AttributeError, OSError):
        return None
    data = bytes(range(256))
    halves = _updated(found, _updated(found, _begun(found), [data[:100]]), [data[100:]])
    return found if _ended(found, halves) == hashlib.sha256(data).hexdigest() else None


def _begun(library) -> bytes:
    state = ctypes.create_string_buffer(_STATE_BYTES)
    library.SHA256_Init(state)
    return state.raw


def _updated(library, state: bytes, parts: Iterable[bytes]) -> bytes:
    buffer = ctypes.create_string_buffer(state, _STATE_BYTES)
    for part in parts:
        library.SHA256_Update(buffer, part, len(part))
    return buffer.raw


def _ended(library, state: bytes) -> str:
    digest = ctypes.create_string_buffer(32)
    library.SHA256_Final(digest, ctypes.create_string_buffer(state, _STATE_BYTES))
    return digest.raw.hex()


def available() -> bool:
    return _library() is not None


def _splits(length: int, size: int) -> int:
    """How many splits Hadoop makes of a file: the last is up to a tenth longer."""
    whole = max(length // size - 2, 0)
    while (length - whole * size) / size > 1.1:
        whole += 1
    return whole + 1


def _escaped(path: str) -> str:
    """A path among others in Hadoop's setting, with no character of it taken for a pattern."""
    plain = "".join(f"\\{c}" if c in "\\{}[]*?" else c for c in path)
    return plain.replace("\\", "\\\\").replace(",", "\\,")


class _Advance:
    """Hash a split from where the one before it ended; anything but the bytes that are due is an error."""

    def __init__(self, due: dict[int, tuple[str, int, int, bytes]]):
        self.due = due  # partition: path, start, end, state

    def __call__(self, partition: int, records: Iterator[tuple[int, bytes]]) -> Iterator[tuple[str, bytes]]:
        path, start, end, state = self.due[partition]
        library = _library()
        if library is None:
            raise RuntimeError("this worker's hashlib has no SHA-256 whose state can be read")
        at = start

        def parts():
            nonlocal at
            for place, data in records:
                if place != at:
                    raise OSError(f"{path}: read at {place}, not at {at}")
                at += len(data)
                yield bytes(data)

        state = _updated(library, state, parts())
        if at != end:
            raise OSError(f"{path} changed while it was read")
        yield path, state


def sha256_by_ranges(spark: SparkSession, files: Sequence[tuple[str, int]], *, range_bytes: int = RANGE_BYTES, last_bytes: int = LAST_BYTES) -> dict[str, str]:
    """SHA-256 of files given by path and length, each longer than ``range_bytes``, a power of two.

    Runs one job for each range of the longest file, and about one for each halving of its end. The
    driver holds a state for each file, never their bytes.
    """
    library, context = _library(), spark.sparkContext
    if library is None:
        raise RuntimeError("hashlib has no SHA-256 whose state can be read")
    if range_bytes.bit_count() != 1 or any(length <= range_bytes for _, length in files):
        raise ValueError("range_bytes must be a power of two, and files longer")
    ship_package(spark)
    total = sum(length for _, length in files)
    sizes = [range_bytes]
    while sizes[-1] > last_bytes and total // (sizes[-1] // 2) <= MOST_SPLITS:
        sizes.append(sizes[-1] // 2)
    states = {path: _begun(library) for path, _ in files}
    done = dict.fromkeys(states, 0)
    for size, record, last in [(s, min(s, RECORD_BYTES), False) for s in sizes] + [(sizes[-1], 1, True)]:
        first, todo = 0, []
        for path, length in files:
            n = _splits(length, size)
            todo.append([(first + k, path, k * size, length if k + 1 == n else (k + 1) * size) for k in range(done[path] // size, n if last else n - 1)])
            first += n
        if not any(todo):
            continue
        read = context.newAPIHadoopRDD(
            "org.apache.hadoop.mapreduce.lib.input.FixedLengthInputFormat", "org.apache.hadoop.io.LongWritable", "org.apache.hadoop.io.BytesWritable",
            conf={
                "mapreduce.input.fileinputformat.inputdir": ",".join(_escaped(path) for path, _ in files),
                "mapreduce.input.fileinputformat.list-status.num-threads": "1",  # splits in the order of the paths
                "mapreduce.input.fileinputformat.split.minsize": str(size),
                "mapreduce.input.fileinputformat.split.maxsize": str(size),
                "fixedlengthinputformat.record.length": str(record),
            },
        )
        if read.getNumPartitions() != first:
            raise OSError("files changed while they were read")
        for step in range(max(map(len, todo))):
            due = {partition: (path, start, end, states[path]) for partition, path, start, end in (t[step] for t in todo if step < len(t))}
            states |= dict(context.runJob(read.mapPartitionsWithIndex(_Advance(due)), list, sorted(due)))
            done |= {path: end for path, _, end, _ in due.values()}
    return {path: _ended(library, state) for path, state in states.items()}
