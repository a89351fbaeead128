"""Archives that are written and read back, held against hashlib and against records built by hand."""

import base64
import gzip
import hashlib
import random

import pytest
from eventide.llm import warc
from pyspark.sql import functions as F


def b32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def awkward() -> list[tuple]:
    """(page_id, url, payload): nulls, ties, repeats, ends of lines and records inside payloads, bytes of no encoding, one long payload."""
    draw = random.Random(3)
    noise = bytes(draw.randrange(256) for _ in range(5000))
    made = [
        (1, "http://a/1", b"one"), (2, "http://a/2", b"one"), (0, "http://a/0", b"one"), (3, None, b""), (4, "http://a/4", None), (5, "http://a b/\r\n%41<x>", b"\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n"),
        (6, "u", noise), (7, "u", noise), (8, "u", b"\n"), (9, "u", b"\r\n\r\n"), (10, "u", "ü\r".encode() * 7), (11, "u", b"no end" * 4000), (None, "n", b"lost"), (None, "n", b"lost"), (12, "r", b"same row"),
        (12, "r", b"same row"), (12, "r2", b"same row"), (13, "w", b"lost"), (14, "x", b"abc\r"), (15, "x", b"\0"),
    ]
    return made + [(100 + i, "hot", b"hot payload") for i in range(300)]


def expected(rows: list[tuple], least: int) -> list[tuple]:
    first, out = {}, []
    for page, _, data in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or "")):
        data = data or b""
        seen = len(data) >= least and data in first
        out.append((page, len(data), b32(data), "revisit" if seen else "response", first[data] if seen else None, True))
        first.setdefault(data, page)
    return sorted(out, key=str)


@pytest.mark.parametrize(("chunk", "least"), [(1 << 20, 0), (7, 0), (1000, 4), (3, 10_000)])
def test_round_trip(spark, tmp_path, chunk, least):
    rows = awkward()
    pages = spark.createDataFrame(rows, "page_id long, url string, html binary").withColumns({c: F.lit("clash") for c in ("digest", "body", "rank", "ident", "chunk", "salt")}).repartition(5)
    warc.write(warc.warc_records(pages, "page_id", "url", "html", least, chunk), f"{tmp_path}/a")
    got = warc.read_records(spark, f"{tmp_path}/a", max(2, chunk // 2)).select(F.col("key").cast("long"), "bytes", "digest", "type", F.col("refers_to_key").cast("long"), "intact").collect()
    assert sorted(map(tuple, got), key=str) == expected(rows, least)
    chunks = warc.read_chunks(spark, f"{tmp_path}/a", 100).where("type IN ('response', 'continuation')").collect()
    assert all(c.length <= 100 and len(c.data) == c.length for c in chunks)
    whole = {}
    for c in sorted(chunks, key=lambda c: (c.origin_id, c.segment or 1, c.chunk)):
        whole[c.origin_id] = whole.get(c.origin_id, b"") + c.data
        if (c.segment or 1) == 1:  # carried from chunk to chunk
            assert c.digest == b32(whole[c.origin_id])
    merged = {d or b"" for _, _, d in rows if len(d or b"") >= least}
    short = [d or b"" for _, _, d in rows if len(d or b"") < least]
    assert sorted(whole.values()) == sorted([*merged, *short])
    uris = {c.uri for c in chunks}
    assert "http://a b/\r\n%41<x>" in uris


def record(kind: str, ident: str, block: bytes, **more: str) -> bytes:
    lines = [f"WARC-Type: {kind}", f"WARC-Record-ID: <{ident}>", f"Content-Length: {len(block)}", *[f"{k.replace('_', '-')}: {v}" for k, v in more.items()]]
    return b"WARC/1.0\r\n" + "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def test_archives_of_others(spark, tmp_path):
    """One gzip member for each record, segments in several files and out of order, lost segments, a cut file, a revisit without response, wrong digests."""
    http = b"HTTP/1.1 200 OK\r\nX: y\r\n\r\n"
    head = {"Content_Type": "application/http;msgtype=response"}
    body = b"part one|part two|part three"
    total = str(len(http) + len(body))
    first = [
        record("warcinfo", "i", b"software: x\r\n"), record("response", "a", http + b"hello", WARC_Payload_Digest=f"sha1:{b32(b'hello')}", **head), record("response", "bad", http + b"hello", WARC_Payload_Digest="sha1:AAAA", **head),
        record("continuation", "s3", body[18:], WARC_Segment_Origin_ID="<s>", WARC_Segment_Number="3", WARC_Segment_Total_Length=total), record("revisit", "v", http, WARC_Refers_To="<a>", WARC_Payload_Digest=f"sha1:{b32(b'hello')}", **head),
        record("revisit", "w", http, WARC_Refers_To="<gone>", WARC_Payload_Digest="sha1:BBBB", **head), record("resource", "empty", b""),
    ]
    second = [
        record("continuation", "s2", body[9:18], WARC_Segment_Origin_ID="<s>", WARC_Segment_Number="2"), record("response", "s", http + body[:9], WARC_Segment_Number="1", WARC_Payload_Digest=f"sha1:{b32(body)}", **head),
        record("response", "t", http + b"x", WARC_Segment_Number="1", **head), record("continuation", "t3", b"z", WARC_Segment_Origin_ID="<t>", WARC_Segment_Number="3", WARC_Segment_Total_Length=str(len(http) + 2)),
    ]
    (tmp_path / "1.warc.gz").write_bytes(b"".join(map(gzip.compress, first)))
    (tmp_path / "2.warc.gz").write_bytes(gzip.compress(b"".join(second)))
    (tmp_path / "3.warc").write_bytes(record("response", "plain", http + b"x\n", **head) + record("response", "cut", http + b"y" * 100, **head)[:-50])
    got = {r.record_id: (r.bytes, r.digest, r.intact) for r in warc.read_records(spark, str(tmp_path)).collect()}
    good = (5, b32(b"hello"))
    assert got == {
        "<i>": (13, b32(b"software: x\r\n"), True), "<a>": (*good, True), "<bad>": (*good, False), "<v>": (*good, True), "<w>": (None, "BBBB", False), "<empty>": (0, b32(b""), True),
        "<s>": (len(body), b32(body), True), "<t>": (2, b32(b"xz"), False), "<plain>": (2, b32(b"x\n"), True),
    }


def test_split_files_are_refused(spark, tmp_path):
    (tmp_path / "a.warc").write_bytes(record("resource", "a", b"x\n" * 3000))
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        with pytest.raises(Exception, match="was split"):
            warc.read_chunks(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)


def test_no_pages(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write(warc.warc_records(pages, "page_id", "url", "html"), f"{tmp_path}/a")
    assert warc.read_records(spark, f"{tmp_path}/a").collect() == []


def test_query_and_sql(spark, sf):
    import duckdb
    from eventide.llm import queries

    duckdb.sql(f"CREATE OR REPLACE TEMP VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    df = queries.op13_warc(spark, sf)
    want = duckdb.sql(f"SELECT {', '.join(df.columns)} FROM ({warc.ORACLE_SQL})").fetchall()
    assert sorted(map(tuple, df.collect())) == sorted(want)
