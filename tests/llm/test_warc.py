import hashlib

import pytest
from pyspark.sql import functions as F

from meterbook.llm import warc

PAGES = "page_id long, url string, html string"
BIG, OTHER = "<html>" + "é" * 80 + "</html>", "<p>" + "x" * 97
ROWS = [(5, "https://a.example/1", BIG), (3, "https://a.example/2", BIG), (9, None, BIG), (4, "u", "tiny"), (1, "u", "tiny"), (7, "x\r\ny: z", OTHER), (8, "", ""), (2, "n", None), (11, "m", "\r\n\r\nWARC/1.1\r\n" * 9), (12, "99", "y" * 99), (13, "99", "y" * 99)]


def want(rows):
    out, first = [], {}
    for i, _, h in rows:
        data = (h or "").encode()
        if len(data) >= 100:
            first[data] = min(first.get(data, i), i)
    for i, _, h in rows:
        data = (h or "").encode()
        holder = first.get(data, i)
        out.append((i, len(data), hashlib.sha256(data).hexdigest(), "response" if holder == i else "revisit", None if holder == i else holder))
    return sorted(out)


def test_archive_round_trip(spark, tmp_path):
    pages = spark.createDataFrame(ROWS, PAGES)
    warc.write(pages, f"file://{tmp_path}/a")
    assert sorted(map(tuple, warc.catalog(spark, f"file://{tmp_path}/a").collect())) == want(ROWS)


def test_payloads_are_stored_once_and_records_are_exact(spark, tmp_path):
    folder = f"{tmp_path}/a"
    warc.write(spark.createDataFrame(ROWS, PAGES), folder)
    stored = spark.read.parquet(f"{folder}/payloads").collect()
    assert sorted(bytes(r.payload).decode() for r in stored) == sorted({h for _, _, h in ROWS if h and len(h.encode()) >= 100})
    assert all(hashlib.sha256(bytes(r.payload)).hexdigest() == r.digest for r in stored)
    records = {bytes(r.header).split(b"\r\n")[2]: bytes(r.record) for r in warc.records(spark, folder).collect()}
    assert len(records) == len(ROWS)
    record = records[b"WARC-Record-ID: <urn:page:3>"]
    assert record.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and record.endswith(b"\r\n\r\n" + BIG.encode() + b"\r\n\r\n")
    revisit = records[b"WARC-Record-ID: <urn:page:5>"]
    assert b"WARC-Refers-To: <urn:page:3>\r\n" in revisit and revisit.endswith(b"Content-Length: 0\r\n\r\n\r\n\r\n")
    assert b"WARC-Target-URI: x%0D%0Ay: z\r\n" in records[b"WARC-Record-ID: <urn:page:7>"]


def test_damage_is_found(spark, tmp_path):
    folder = f"{tmp_path}/a"
    warc.write(spark.createDataFrame(ROWS, PAGES), folder)
    payloads = spark.read.parquet(f"{folder}/payloads").withColumn("payload", F.concat("payload", F.lit(b"!")))
    broken = f"{tmp_path}/b"
    payloads.write.parquet(f"{broken}/payloads")
    spark.read.parquet(f"{folder}/records").write.parquet(f"{broken}/records")
    with pytest.raises(Exception, match="wrong payload"):
        warc.catalog(spark, broken).collect()
    lost = f"{tmp_path}/c"
    payloads.limit(0).write.parquet(f"{lost}/payloads")
    spark.read.parquet(f"{folder}/records").write.parquet(f"{lost}/records")
    with pytest.raises(Exception, match="no payload"):
        warc.catalog(spark, lost).collect()


def test_repeated_and_null_ids(spark):
    rows = [(3, "a", BIG), (3, "b", BIG), (None, "c", BIG), (None, "d", "s"), (4, "e", BIG)]
    got = warc.digests(spark.createDataFrame(rows, PAGES)).collect()
    kinds = sorted(((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in got), key=repr)
    big = len(BIG.encode())
    assert kinds == sorted([(3, "response", None, big)] * 2 + [(None, "revisit", 3, big), (None, "response", None, 1), (4, "revisit", 3, big)], key=repr)


def test_clashing_columns_and_empty_table(spark):
    pages = spark.createDataFrame([(1, "u", BIG, "d", 5)], PAGES + ", digest string, first long")
    assert [tuple(r)[0:2] for r in warc.digests(pages).collect()] == [(1, len(BIG.encode()))]
    assert warc.digests(spark.createDataFrame([], PAGES)).count() == 0
