"""Content-addressed WARC archive.

Payload bytes are stored once, compressed, under their SHA-256; exact record headers are stored
apart. Reading joins them back to whole records and checks every payload against its digest.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from auditflow.llm._store import keep

#: Shorter payloads are stored with a record of their own.
LEAST_SHARED = 100
CRLF = "\r\n"
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL namespace of RFC 4122


def _packed(pages: DataFrame) -> DataFrame:
    """(page_id, url, digest, bytes, packed) of every page; the payload is compressed where it is read."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for part in range(0, batch.num_rows, 500):
                some = batch.slice(part, 500)
                payloads = [p or b"" for p in some.column(2).cast(pa.binary()).to_pylist()]
                arrays = [
                    some.column(0), some.column(1), pa.array([hashlib.sha256(p).hexdigest() for p in payloads]),
                    pa.array([len(p) for p in payloads], pa.int64()), pa.array([pack.compress(p) for p in payloads], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(arrays, names=["page_id", "url", "digest", "bytes", "packed"])

    return pages.mapInArrow(rows, "page_id long, url string, digest string, bytes long, packed binary")


def _record_id(page_id: int | None, url: str | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{page_id}|{url}|{digest}')}>"


def _headers(members: DataFrame, date: str) -> DataFrame:
    """(digest, page_id, header) with the exact header bytes of every record."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            headers = []
            for page_id, url, digest, size, first, first_url in zip(*(c.to_pylist() for c in batch.columns)):
                shared = size >= LEAST_SHARED and first is not None and page_id != first
                lines = [
                    "WARC/1.1", f"WARC-Type: {'revisit' if shared else 'response'}",
                    f"WARC-Record-ID: {_record_id(page_id, url, digest)}", f"WARC-Date: {date}",
                ]
                if url is not None:
                    lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
                lines.append(f"WARC-Payload-Digest: sha256:{digest}")
                if shared:
                    lines += [
                        "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                        f"WARC-Refers-To: {_record_id(first, first_url, digest)}", f"X-Refers-To-Page: {first}",
                    ]
                if page_id is not None:
                    lines.append(f"X-Page: {page_id}")
                lines.append(f"Content-Length: {size}")
                headers.append((CRLF.join(lines) + CRLF + CRLF).encode())
            yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(0), pa.array(headers, pa.binary())], names=["digest", "page_id", "header"])

    fields = ("page_id", "url", "digest", "bytes", "first", "first_url")
    return members.select(*fields).mapInArrow(rows, "digest string, page_id long, header binary")


def write_archive(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date: str = "2000-01-01T00:00:00Z"):
    """Write all rows of ``pages`` into the shared folder: (headers, payloads) as tables read from there.

    Of the records with equal payloads of at least 100 bytes the one with the least identifier is a
    response and the others revisit it. A null payload is empty. Rows without an identifier never
    serve as response to others; such a row is a revisit if its payload has a response with an
    identifier. Rows that repeat the response's identifier and payload are responses too, and their
    bytes are still stored once. Other columns aren't read; an empty table gives empty tables.
    """
    packed = _packed(pages.select(F.col(id_col).cast("long"), F.col(url_col).cast("string"), F.col(payload_col).cast("string")))
    # The payload goes with one record of its digest; compressed bytes cross the network once.
    payloads = keep(packed.groupBy("digest", "bytes").agg(F.min(F.struct(F.col("page_id").isNull(), "page_id", "url", "packed")).alias("one")), "warc-payloads")
    firsts = payloads.select("digest", F.col("one.page_id").alias("first"), F.col("one.url").alias("first_url"))
    members = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
        F.sha2(F.coalesce(F.col(payload_col).cast("string"), F.lit("")), 256).alias("digest"),
        F.octet_length(F.coalesce(F.col(payload_col).cast("string"), F.lit(""))).cast("long").alias("bytes"),
    )
    headers = keep(_headers(members.join(firsts, "digest"), date), "warc-headers")
    return headers, payloads.select("digest", "bytes", F.col("one.packed").alias("packed"))


def read_records(headers: DataFrame, payloads: DataFrame) -> DataFrame:
    """(header, payload) of every record, joined by digest and checked.

    A payload whose bytes don't have the digest it is stored under fails the read.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for part in range(0, batch.num_rows, 500):
                some = batch.slice(part, 500)
                out = []
                for digest, packed in zip(some.column(0).to_pylist(), some.column(2).to_pylist()):
                    payload = unpack.decompress(packed)
                    if hashlib.sha256(payload).hexdigest() != digest:
                        raise ValueError(f"the stored payload of {digest} has other bytes")
                    out.append(payload)
                yield pa.RecordBatch.from_arrays([some.column(1), pa.array(out, pa.binary())], names=["header", "payload"])

    joined = headers.select("digest", "header").join(payloads.select("digest", "packed"), "digest")
    return joined.select("digest", "header", "packed").mapInArrow(rows, "header binary, payload binary")


def record_bytes(records: DataFrame) -> DataFrame:
    """The whole record of each row, as it stands in a WARC file."""
    return records.select(F.concat("header", "payload", F.lit(b"\r\n\r\n")).alias("record"))


def catalogue(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to from the bytes of each record."""
    header = F.decode("header", "UTF-8")

    def field(name: str):
        value = F.regexp_extract(header, rf"\r\n{name}: ([^\r]*)\r\n", 1)
        return F.when(value != "", value)

    return records.select(
        field("X-Page").cast("long").alias("page_id"), F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_digest"), field("WARC-Type").alias("record_type"),
        field("X-Refers-To-Page").cast("long").alias("refers_to"), field("WARC-Record-ID").alias("record_id"),
        field("WARC-Target-URI").alias("target_uri"),
    )
