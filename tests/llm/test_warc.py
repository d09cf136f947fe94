import hashlib
import re

import pytest

from tidemark.llm import warc

SCHEMA = "page_id long, url string, html string, digest int"


def test_round_trip(spark, tmp_path):
    big = "é<p>" * 40
    rows = [(7, "u7", big, 1), (3, "u3", big, 1), (9, None, big, 1), (4, "u\r\n4%0A%250d\u00e9", "small", 1), (11, "", "small", 1), (12, "a%0Ab", "small", 1), (13, "\n\r\n\r\nWARC-Type: revisit\r\n", "small", 1), (5, "u5", "small", 1), (6, "u6", None, 1), (8, "u8", "", 1), (None, "u", "x", 1), (10, "u", "\r\n\r\nWARC/1.1\r\n" * 30, 1)]
    folder = str(tmp_path / "a")
    warc.write(spark.createDataFrame(rows, SCHEMA), folder)
    assert spark.read.parquet(f"{folder}/payloads").count() == 4
    got = {r["page_id"]: r for r in warc.read(spark, folder).collect()}
    first = {}
    for i, u, h, _ in sorted(r for r in rows if r[0] is not None):
        p = (h or "").encode()
        r = got.pop(i)
        revisit = len(p) >= 100 and p in first
        assert (r["payload"] is None if revisit else bytes(r["payload"]) == p) and r["payload_bytes"] == len(p) and r["payload_digest"] == hashlib.sha256(p).hexdigest()
        assert (r["record_type"], r["refers_to"]) == (("revisit", first[p]) if revisit else ("response", None))
        assert r["url"] == u
        first.setdefault(p, i)
    assert not got
    whole = {bytes(r["record"]) for r in warc.records(spark, folder).collect()}
    assert len(whole) == len(rows) - 1
    by = {int(re.search(rb"WARC-Record-ID: <urn:page:(\d+)>", w)[1]): w for w in whole}
    head, _, block = by[3].partition(b"\r\n\r\n")
    http, _, body = block.partition(b"\r\n\r\n")
    assert http.startswith(b"HTTP/1.1 200 OK\r\n") and body == big.encode() + b"\r\n\r\n" and f"\r\nContent-Length: {len(block) - 4}".encode() in head and b"WARC-Date: 1970-01-01T00:00:00Z" in head
    assert by[7].endswith(f"Content-Length: {len(big.encode())}\r\n\r\n\r\n\r\n".encode()) and b"WARC-Refers-To: <urn:page:3>" in by[7] and b"WARC-Profile: " in by[7]


def test_damage_is_found(spark, tmp_path):
    folder = str(tmp_path / "b")
    warc.write(spark.createDataFrame([(1, "u", "abc", 0)], SCHEMA), folder)
    spark.createDataFrame([(hashlib.sha256(b"abc").hexdigest(), bytearray(b"abd"))], "digest string, payload binary").write.mode("overwrite").parquet(f"{folder}/payloads")
    with pytest.raises(Exception, match="differs"):
        warc.read(spark, folder).collect()


def test_empty(spark):
    assert warc.report(spark.createDataFrame([], SCHEMA)).collect() == []


def test_repeated_pages_and_the_sql(spark, tmp_path):
    """Rows of one page twice, clashing columns, and the registered SQL over line breaks and nulls in urls."""
    import duckdb

    from tidemark.llm.queries import OP10_SQL

    rows = [(1, "u\nv", "x" * 200), (1, "u\nv", "x" * 200), (2, None, "x" * 200), (3, "", None), (4, "a%0D\r", "é" * 60)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS digest", "2 AS payload", "3 AS first", "4 AS header")
    got = sorted(tuple(r) for r in warc.report(df).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url").collect())
    df.write.parquet(str(tmp_path / "p"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/p/*.parquet'")
    assert [(*r[:4], r[4] or 0, r[5] or "") for r in got] == sorted((*r[:4], r[4] or 0, r[5] or "") for r in con.execute(f"SELECT page_id, payload_bytes, payload_digest, record_type, refers_to, url FROM ({OP10_SQL})").fetchall())
