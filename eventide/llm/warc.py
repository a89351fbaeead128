"""WARC archives as a chunked record table.

Writing: a payload becomes rows ``(record, chunk number, bytes)``, each of them
one WARC record of bounded size: the first carries the headers of a response,
the others are its continuation segments. Spark's text writer puts them on disk
(any file system, committed by task), the end of a record being its line end.
Reading: archives are streamed line by line through a parser that keeps no more
than a chunk, and every chunk row carries the payload's SHA-1 up to its end.
Segments may lie in any file; a record's are put in order by one shuffle and
digested as they pass. No task holds a whole oversized payload.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed

#: Payload bytes of a segment, and of a chunk row.
CHUNK = 1 << 20
#: Parts that a key's rows are dealt to before they meet what belongs to the key.
SALTS = 16
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
# Digits in base 32 as Spark writes them and as RFC 4648 does.
SPARK_DIGITS, RFC_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1: five hex digits are four of base 32."""
    digest = F.upper(F.sha1(payload))
    parts = [F.lpad(F.conv(F.substring(digest, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), SPARK_DIGITS, RFC_DIGITS)


def _escaped(value: Column) -> Column:
    """A header's value on one line: control characters, blanks, % and angle brackets percent-encoded."""
    out = value
    for c in "%\r\n\t\v\f\0 <>":
        out = F.replace(out, F.lit(c), F.lit(f"%{ord(c):02X}"))
    return out


def _uuid(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", *parts))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def _headers(*named: tuple[str, Column | str]) -> Column:
    """Header lines; a null value leaves its line out."""
    lines = [F.concat(F.lit(f"{name}: "), F.lit(v) if isinstance(v, str) else v.cast("string"), F.lit("\r\n")) for name, v in named]
    return F.concat(F.lit("WARC/1.1\r\n"), *[F.coalesce(x, F.lit("")) for x in lines], F.lit("\r\n"))


def warc_records(pages: DataFrame, ident: str, uri: str, payload: str, least: int = 0, chunk: int = CHUNK, date: str = "2024-01-01T00:00:00Z", kind: str = "text/html; charset=utf-8") -> DataFrame:
    """``(value)``: the WARC records of all rows, without their closing blank lines; one row for each segment.

    Of rows with equal payloads of at least ``least`` bytes (SHA-1 and length)
    that with the smallest ident is a response and carries the payload, the
    others are revisits that refer to it. A null payload is an empty one, a null ident comes
    after all others and has no Record-Key line, a null uri has no target line.
    Repeated rows are records of their own: all but the first revisit it. Equal payloads are
    merged before the shuffle, so a group of copies of any size is one row for each chunk and task.
    """
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(ident).alias("ident"), F.col(uri).cast("string").alias("uri"), body.alias("body"))
    rows = rows.withColumns({"digest": base32_sha1(F.col("body")), "bytes": F.octet_length("body").cast("long")})
    # rows too short to be merged stay apart by their own ident, uri and number
    rank = F.struct(F.col("ident").isNull().alias("none"), "ident", F.col("uri").isNull().alias("bare"), "uri")
    own = F.when(F.col("bytes") < least, rank)
    keys = ["digest", "bytes", "own"]
    copies = checkpointed(rows.groupBy("digest", "bytes", own.alias("own"), rank.alias("rank")).agg(F.count("*").alias("n")))
    groups = copies.groupBy(*keys).agg(F.min("rank").alias("first"), F.sum("n").alias("n"))
    # responses: any payload of the group, chunk by chunk
    last = F.greatest(F.ceil(F.col("bytes") / chunk) - 1, F.lit(0)).cast("int")
    cut = rows.select("digest", "bytes", own.alias("own"), rank.alias("rank"), F.explode(F.sequence(F.lit(0), last)).alias("chunk"), "body")
    cut = cut.withColumn("body", F.expr(f"substring(body, chunk * {chunk} + 1, {chunk})"))
    merged = cut.groupBy(*keys, "chunk").agg(F.min("rank").alias("first"), F.first("body").alias("body"), F.count("*").alias("n"))
    single = merged.withColumn("copy", F.lit(0))
    # rows under the least size have no revisits: their repeats are responses too
    short = merged.where(F.col("own").isNotNull() & (F.col("n") > 1)).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n").cast("int") - 1)))
    responses = single.unionByName(short) if least else single
    # revisits: all but the first; a hot group's rows are dealt to SALTS parts
    shared = groups.where("n > 1 AND own IS NULL").select("digest", "bytes", "first", F.explode(F.array(*map(F.lit, range(SALTS)))).alias("salt"))
    dealt = copies.where("own IS NULL").drop("own").withColumn("salt", F.pmod(F.xxhash64("rank"), F.lit(SALTS)).cast("int"))
    met = dealt.join(shared, ["digest", "bytes", "salt"])
    begin = F.when(F.col("rank").eqNullSafe(F.col("first")), 1).otherwise(0)
    revisits = met.withColumn("begin", begin).where("begin < n").withColumn("copy", F.explode(F.sequence(F.col("begin"), F.col("n").cast("int") - 1)))

    def name(row: str, copy: Column) -> Column:
        r = F.col(row)
        return _uuid(F.coalesce(r["ident"].cast("string"), F.lit("\0")), F.coalesce(r["uri"], F.lit("\0")), F.col("digest"), copy.cast("string"))

    http = F.concat(F.lit(f"HTTP/1.1 200 OK\r\nContent-Type: {kind}\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit("\r\n\r\n"))
    segmented = F.col("bytes") > chunk
    described = lambda row: [("WARC-Target-URI", _escaped(F.col(row)["uri"])), ("Record-Key", _escaped(F.col(row)["ident"].cast("string"))), ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest")))]
    content = F.octet_length("body")
    head = F.concat(
        _headers(
            ("WARC-Type", "response"), ("WARC-Record-ID", name("first", F.col("copy"))), ("WARC-Date", date), *described("first"),
            ("WARC-Segment-Number", F.when(segmented, F.lit("1"))), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", content + F.octet_length(http)),
        ),
        http,
    )
    total = F.when(F.col("chunk") == last, F.col("bytes") + F.octet_length(http))
    more = _headers(
        ("WARC-Type", "continuation"), ("WARC-Record-ID", _uuid(name("first", F.col("copy")), F.col("chunk").cast("string"))), ("WARC-Date", date),
        ("WARC-Segment-Origin-ID", name("first", F.col("copy"))), ("WARC-Segment-Number", F.col("chunk") + 1), ("WARC-Segment-Total-Length", total), ("Content-Length", content),
    )
    written = responses.select(F.concat(F.when(F.col("chunk") == 0, head).otherwise(more).cast("binary"), F.col("body")).alias("value"))
    referred = _headers(
        ("WARC-Type", "revisit"), ("WARC-Record-ID", name("rank", F.col("copy"))), ("WARC-Date", date), *described("rank"), ("WARC-Profile", REVISIT),
        ("WARC-Refers-To", name("first", F.lit(0))), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", F.octet_length(http)),
    )
    return written.unionByName(revisits.select(F.concat(referred, http).cast("binary").alias("value")))


def write(records: DataFrame, folder: str) -> None:
    """Archives of warc_records, one gzipped file for each task. Bytes of any encoding pass through the text writer as they are."""
    records.select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(folder)


CHUNKS = pa.schema(
    [
        ("record_id", pa.string()), ("origin_id", pa.string()), ("type", pa.string()), ("key", pa.string()), ("uri", pa.string()), ("refers_to", pa.string()), ("declared", pa.string()),
        ("segment", pa.int64()), ("chunk", pa.int64()), ("offset", pa.int64()), ("length", pa.int64()), ("last", pa.bool_()), ("total", pa.int64()), ("head", pa.int64()),
        ("digest", pa.string()), ("data", pa.binary()),
    ]
)
CHUNKS_DDL = (
    "record_id string, origin_id string, type string, key string, uri string, refers_to string, declared string, segment long, chunk long, offset long, length long, last boolean,"
    " total long, head long, digest string, data binary"
)


def _number(value: str | None) -> int | None:
    return int(value) if value is not None and value.isdigit() else None


class Parser:
    """Lines of one archive, in order, to chunk rows; it holds a record's headers and at most one chunk."""

    def __init__(self, chunk: int = CHUNK, data: bool = True):
        self.chunk, self.data = chunk, data
        self.fields: dict[str, str] | None = None
        self.left = 0  # bytes of the block that are still to come
        self.block = False

    def feed(self, line: bytes) -> Iterator[tuple]:
        """A line without its closing line feed."""
        if not self.block:
            text = line.rstrip(b"\r")
            if self.fields is None:
                if text[:5] == b"WARC/":
                    self.fields = {}
            elif text:
                name, _, value = text.decode("utf-8", "replace").partition(":")
                self.fields[name.strip().lower()] = value.strip()
            else:
                yield from self._open()
            return
        piece = line + b"\n"
        if len(piece) > self.left:
            piece = piece[: self.left]
        self.left -= len(piece)
        if self.http:  # the block's own headers end with an empty line
            self.head += len(piece)
            if piece.rstrip(b"\r\n") == b"":
                self.http = False
        else:
            yield from self._take(piece)
        if self.left == 0:
            yield from self._close()

    def _open(self) -> Iterator[tuple]:
        f = self.fields
        self.left, self.block = _number(f.get("content-length")) or 0, True
        self.http = f.get("content-type", "").lower().startswith("application/http")
        self.segment = _number(f.get("warc-segment-number"))
        self.kept, self.size, self.offset, self.number, self.head = [], 0, 0, 0, 0
        # a later segment's digest waits for those before it
        self.sha = hashlib.sha1() if (self.segment or 1) == 1 else None
        if self.left == 0:
            yield from self._close()

    def _take(self, piece: bytes) -> Iterator[tuple]:
        while self.size + len(piece) > self.chunk:
            room = self.chunk - self.size
            self._keep(piece[:room])
            yield self._row(False)
            piece = piece[room:]
        self._keep(piece)

    def _keep(self, piece: bytes) -> None:
        if self.sha is not None:
            self.sha.update(piece)
        if self.data or self.segment is not None:
            self.kept.append(piece)
        self.size += len(piece)

    def _row(self, last: bool) -> tuple:
        f = self.fields
        ident = f.get("warc-record-id")
        declared, key, uri = f.get("warc-payload-digest"), f.get("record-key"), f.get("warc-target-uri")
        row = (
            ident, f.get("warc-segment-origin-id", ident), f.get("warc-type"), None if key is None else unquote(key), None if uri is None else unquote(uri), f.get("warc-refers-to"),
            None if declared is None else declared.rpartition(":")[2].upper(), self.segment, self.number, self.offset, self.size, last, _number(f.get("warc-segment-total-length")), self.head,
            base64.b32encode(self.sha.digest()).decode() if self.sha is not None else None, b"".join(self.kept) if self.kept or self.data else None,
        )
        self.offset, self.number, self.kept, self.size = self.offset + self.size, self.number + 1, [], 0
        return row

    def _close(self) -> Iterator[tuple]:
        yield self._row(True)
        self.fields, self.block = None, False


def _tables(rows: Iterator[tuple], schema: pa.Schema, most: int = 4096, size: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Rows as batches that are bounded in rows and in bytes of their last column."""
    held, n = [], 0
    for row in rows:
        held.append(row)
        n += len(row[-1]) if isinstance(row[-1], bytes) else 0
        if len(held) >= most or n >= size:
            yield _batch(held, schema)
            held, n = [], 0
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def read_chunks(spark: SparkSession, folder: str, chunk: int = CHUNK, data: bool = True) -> DataFrame:
    """Chunk rows of all records under a folder: ``record_id, origin_id`` (of a continuation: its first segment's record),
    ``type, key, uri, refers_to, declared`` (digest in the header), ``segment`` (null: unsegmented), ``chunk`` (within the segment), ``offset, length, last,
    digest`` (bare base32 SHA-1 of the record's payload up to this chunk's end; null in continuations), ``data`` (without data: only of segmented records).

    gzipped archives of any size are streamed, one task a file. A file that is not compressed must be read by one task as well: one that the
    session would split is refused. Text that is no record is passed over; a record cut off by the file's end gives the chunks before its last.
    """
    lines = spark.read.option("lineSep", "\n").text(folder)
    lines = lines.select(F.col("value").cast("binary").alias("line"), F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("begin"))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            at, parser = None, None
            for batch in batches:
                for line, file, begin in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                    if file != at:
                        if begin:
                            raise ValueError("an uncompressed archive was split: raise spark.sql.files.maxPartitionBytes above its size, or gzip it")
                        at, parser = file, Parser(chunk, data)
                    yield from parser.feed(line)

        yield from _tables(rows(), CHUNKS)

    return lines.mapInArrow(parse, CHUNKS_DDL)


RECORDS = pa.schema(
    [("record_id", pa.string()), ("type", pa.string()), ("key", pa.string()), ("uri", pa.string()), ("refers_to", pa.string()), ("declared", pa.string()), ("bytes", pa.int64()), ("digest", pa.string()), ("whole", pa.bool_())]
)
RECORDS_DDL = "record_id string, type string, key string, uri string, refers_to string, declared string, bytes long, digest string, whole boolean"


class Assembler:
    """Chunk rows in order of record, segment and chunk, to one row a record; it holds a digest, no payload."""

    def __init__(self):
        self.at = self.row = None

    def feed(self, r: dict) -> Iterator[tuple]:
        if self.row is None or r["origin_id"] != self.at:
            yield from self.close()
            self.at, self.sha, self.row = r["origin_id"], None, {n: r[n] for n in RECORDS.names[:6]} | {"bytes": 0, "block": 0, "next": 1, "done": False, "whole": True}
        row = self.row
        if r["segment"] is None:
            row["digest"] = r["digest"]
            row["bytes"], row["done"] = r["offset"] + r["length"], row["done"] or r["last"]
            return
        if self.sha is None:
            self.sha = hashlib.sha1()
        if r["chunk"] == 0:  # segments must come without a gap, the first one being the record itself
            row["whole"] &= r["segment"] == row["next"]
            row["next"] = r["segment"] + 1
            row["block"] += r["head"]
        self.sha.update(r["data"] or b"")
        row["bytes"], row["block"] = row["bytes"] + r["length"], row["block"] + r["length"]
        if r["last"] and r["total"] is not None:
            row["done"], row["whole"] = True, row["whole"] and r["total"] == row["block"]

    def close(self) -> Iterator[tuple]:
        if self.row is not None:
            row, self.row = self.row, None
            digest = row["digest"] if self.sha is None else base64.b32encode(self.sha.digest()).decode()
            yield (*[row[n] for n in RECORDS.names[:6]], row["bytes"], digest, row["whole"] and row["done"])


def read_records(spark: SparkSession, folder: str, chunk: int = CHUNK) -> DataFrame:
    """One row a record: ``record_id, type, key, uri, refers_to, refers_to_key, declared, bytes, digest, intact``.

    bytes and digest are those of the full payload as read; a revisit has those of the response that it refers to. ``intact``: all segments are there and
    the payload has the digest that the record declares (any, if it declares none). A revisit without its response has null bytes, its declared digest, and isn't intact.
    Record ids are taken to be unique. No archives give no rows.
    """
    chunks = read_chunks(spark, folder, chunk, data=False)
    # an unsegmented record is one row without data after its last chunk; only segments take payload through the shuffle
    chunks = chunks.where("segment IS NOT NULL OR last").repartition("origin_id").sortWithinPartitions("origin_id", "segment", "chunk")

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            made = Assembler()
            for batch in batches:
                for r in batch.to_pylist():
                    yield from made.feed(r)
            yield from made.close()

        yield from _tables(rows(), RECORDS)

    found = checkpointed(chunks.mapInArrow(assemble, RECORDS_DDL))
    intact = F.col("whole") & (F.col("declared").isNull() | (F.col("declared") == F.col("digest")))
    plain = found.where("type <> 'revisit' OR type IS NULL").withColumns({"refers_to_key": F.lit(None).cast("string"), "intact": intact}).drop("whole")
    revisits = found.where("type = 'revisit'").drop("bytes", "digest", "whole").withColumn("salt", F.pmod(F.xxhash64("record_id"), F.lit(SALTS)).cast("int"))
    wanted = plain.join(revisits.select(F.col("refers_to").alias("record_id")).distinct(), "record_id", "left_semi")
    wanted = wanted.select(F.col("record_id").alias("refers_to"), F.col("key").alias("refers_to_key"), "bytes", "digest", "intact", F.explode(F.array(*map(F.lit, range(SALTS)))).alias("salt"))
    met = revisits.join(wanted, ["refers_to", "salt"], "left").drop("salt")
    same = F.coalesce(F.col("intact") & (F.col("declared").isNull() | (F.col("declared") == F.col("digest"))), F.lit(False))
    return plain.unionByName(met.withColumns({"intact": same, "digest": F.coalesce("digest", "declared")}))


#: DuckDB's words for op13_warc.
ORACLE_SQL = f"""
WITH rows AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
digits AS (SELECT *, translate(concat({", ".join(f"lpad(upper(to_base(CAST(concat('0x', substr(hex, {5 * i + 1}, 5)) AS BIGINT), 32)), 4, '0')" for i in range(8))}), '{SPARK_DIGITS}', '{RFC_DIGITS}') AS payload_digest FROM rows),
numbered AS (SELECT *, row_number() OVER (PARTITION BY payload_digest, payload_bytes ORDER BY page_id NULLS LAST) AS k, first_value(page_id) OVER (PARTITION BY payload_digest, payload_bytes ORDER BY page_id NULLS LAST) AS first FROM digits)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest, CASE WHEN k = 1 THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN k > 1 THEN first END AS refers_to, TRUE AS intact FROM numbered"""
