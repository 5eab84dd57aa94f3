import hashlib

import pytest
from pyspark.sql import functions as F

from auditflow.llm import warc

BIG, OTHER = "<p>" + "x" * 200, "é" * 60


def test_round_trip_of_awkward_pages(spark):
    pages = [(3, "u3", BIG), (1, "u1", BIG), (2, None, BIG), (4, "u4", "short"), (5, "u5", "short"), (6, "u6", None), (7, "u7", ""),
             (8, "a\r\nb", OTHER), (9, "u9", OTHER), (9, "u9", OTHER), (None, None, BIG), (None, "n", "y" * 150)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("digest", F.lit("clash")).withColumn("bytes", F.lit(1))
    headers, payloads = warc.write_archive(df)
    assert payloads.count() == len({(h or "") for _, _, h in pages})
    rows = sorted((tuple(r)[:5] for r in warc.catalogue(warc.read_records(headers, payloads)).collect()), key=repr)
    expected = []
    for page, _, html in pages:
        data = (html or "").encode()
        first = min((p for p, _, h in pages if (h or "") == (html or "") and p is not None), default=None)
        revisit = len(data) >= 100 and first is not None and page != first
        expected.append((page, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    assert rows == sorted(expected, key=repr)


def test_records_are_exact(spark):
    df = spark.createDataFrame([(1, "http://a", BIG)], "page_id long, url string, html string")
    headers, payloads = warc.write_archive(df)
    record = bytes(warc.record_bytes(warc.read_records(headers, payloads)).first()[0])
    head, _, body = record.partition(b"\r\n\r\n")
    assert head.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and body == BIG.encode() + b"\r\n\r\n"
    assert f"Content-Length: {len(BIG)}".encode() in head


def test_altered_payload_fails(spark):
    df = spark.createDataFrame([(1, "http://a", BIG), (2, "http://b", OTHER)], "page_id long, url string, html string")
    headers, payloads = warc.write_archive(df)
    swapped = payloads.withColumn("packed", F.lit(bytes(payloads.first()["packed"])))
    with pytest.raises(Exception, match="other bytes"):
        warc.read_records(headers, swapped).collect()


def test_no_pages(spark):
    headers, payloads = warc.write_archive(spark.createDataFrame([], "page_id long, url string, html string"))
    assert warc.catalogue(warc.read_records(headers, payloads)).count() == 0
