r"""WARC archives: writing, reading and reassembly of segmented records (operator 1).

Writing: a payload goes into an HTTP response in chunked transfer framing; blocks over
`segment_bytes` are split into a first record (WARC-Segment-Number 1) and continuation records
that name it (WARC-Segment-Origin-ID), the last one with WARC-Segment-Total-Length. Of equal
payloads of at least `revisit_bytes` the one with the largest id is the response and the others
are revisits of it; equality is by length, SHA-1 and SHA-256. Files are WARC compressed by gzip, written by
Spark's text writer, which passes bytes through, so any store that Spark writes to will do. That writer makes one
gzip member per file, not one per record. Files are cut by bytes: a row of the writer is about
`row_bytes` of records, a file at most `rows_per_file` rows.

Reading: files (gzip or plain) come through Spark's binary reader, are inflated as a stream and parsed once;
records are cut by Content-Length (never by
searching for markers in payloads). Continuation records are grouped by origin identifier,
ordered by segment number, checked for gaps, contradictions and total length, and the chunked
framing is decoded. What fails a check keeps its row, with null payload and the reason in `error`.

Defined results: null payload is empty; a null id is written but never referred to; rows that
repeat the responding id are responses too, and so are repeated rows below `revisit_bytes`; a segment that
occurs twice with equal bytes counts once; segments may come in any order and from any file. A record's
segments meet in one row, since the payload they make up is one value. Ids are cast to long; other columns,
whatever their names, are not read; an empty table makes archives without records, which read as no rows.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, drop_written, load, scratch_path, written

SEGMENT_BYTES = 8 << 10
ROW_BYTES = 1 << 20
ROWS_PER_FILE = 64
REVISIT_BYTES = 1000
CHUNK_BYTES = 3000
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
RECORD_SCHEMA = "record_id string, record_type string, page_id long, uri string, payload_digest string, refers_to long, segment int, origin string, total long, block binary, error string"


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    out = [b"%x\r\n%b\r\n" % (len(p), p) for p in (payload[a : a + size] for a in range(0, len(payload), size))]
    return b"".join([*out, b"0\r\n\r\n"])


def dechunked(body: bytes) -> bytes:
    """Decodes chunked framing (chunk extensions and trailers are skipped); ValueError if it is broken."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            raise ValueError("chunk size line missing")
        size = int(body[at:end].split(b";")[0].strip(), 16)
        at = end + 2
        if size == 0:
            return b"".join(out)
        if size < 0 or body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("chunk shorter than its size")
        out.append(body[at : at + size])
        at += size + 2


def http_payload(block: bytes) -> bytes:
    head, gap, body = block.partition(b"\r\n\r\n")
    if not gap:
        raise ValueError("HTTP header missing")
    names = dict(line.lower().split(b":", 1) for line in head.split(b"\r\n")[1:] if b":" in line)
    return dechunked(body) if names.get(b"transfer-encoding", b"").strip() == b"chunked" else body


def _record(kind: str, rid: str, block: bytes, **headers: object) -> bytes:
    lines = [f"WARC-Type: {kind}", f"WARC-Record-ID: {rid}", "WARC-Date: 1970-01-01T00:00:00Z"]
    lines += [f"{k.replace('_', '-')}: {v}" for k, v in headers.items() if v is not None]
    head = "\r\n".join(["WARC/1.1", *lines, f"Content-Length: {len(block)}"]).encode()
    return head + b"\r\n\r\n" + block + b"\r\n\r\n"


def _clean(uri: str | None) -> str | None:
    return None if uri is None else uri.replace("\r", "%0D").replace("\n", "%0A")


def _records(segment_bytes: int, row_bytes: int):
    """Pages to rows of about `row_bytes` of records each; the line end that the writer adds is skipped between records."""

    def row(records: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([b"".join(records)], pa.binary())], ["records"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n = TaskContext.get().partitionId(), 0
        out, held = [], 0
        for batch in batches:
            for page, uri, payload, sha1, head in zip(*(batch.column(c) for c in ("id", "uri", "payload", "sha1", "head"))):
                page, uri, head, digest = page.as_py(), _clean(uri.as_py()), head.as_py(), f"sha1:{sha1.as_py()}"
                rid = f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(f'{page}:{task}:{n}'.encode()).digest())}>"
                n += 1
                shared = {"X_Page_Id": page, "WARC_Target_URI": uri, "WARC_Payload_Digest": digest}
                if head is not None:
                    out.append(_record("revisit", rid, b"", **shared, X_Refers_To_Page_Id=head, WARC_Profile="http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
                else:
                    block = _HTTP + chunked(payload.as_py())
                    parts = [block[a : a + segment_bytes] for a in range(0, len(block), segment_bytes)]
                    if len(parts) == 1:
                        out.append(_record("response", rid, block, **shared, Content_Type="application/http; msgtype=response"))
                    else:
                        out.append(_record("response", rid, parts[0], **shared, WARC_Segment_Number=1, Content_Type="application/http; msgtype=response"))
                        for i, part in enumerate(parts[1:], 2):
                            more = f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(f'{rid}:{i}'.encode()).digest())}>"
                            out.append(_record("continuation", more, part, WARC_Target_URI=uri, WARC_Segment_Origin_ID=rid, WARC_Segment_Number=i, WARC_Segment_Total_Length=len(block) if i == len(parts) else None))
                    held += len(block)
                held += 500
                if held > row_bytes:
                    yield row(out)
                    out, held = [], 0
        if out:
            yield row(out)

    return run


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html", segment_bytes: int = SEGMENT_BYTES, revisit_bytes: int = REVISIT_BYTES, row_bytes: int = ROW_BYTES, rows_per_file: int = ROWS_PER_FILE) -> None:
    """Writes one record (with its continuations) per row under `path`."""
    bounded_batches(pages.sparkSession)
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(uri_col).cast("string").alias("uri"), F.coalesce(F.col(payload_col).cast("binary"), F.lit("").cast("binary")).alias("payload"))
    rows = rows.withColumns({"sha1": F.sha1("payload"), "sha2": F.sha2("payload", 256), "size": F.octet_length("payload")})
    keys = ["size", "sha1", "sha2"]
    heads = rows.where(F.col("size") >= revisit_bytes).groupBy(*keys).agg(F.max("id").alias("head"), F.count("*").alias("copies")).where("copies > 1").select(*keys, "head")
    heads = written(heads, "warc-heads")  # a table, so that Spark can split the rows of a hot payload in the join
    rows = rows.join(heads, keys, "left").select("id", "uri", "payload", "sha1", F.when(~F.col("head").eqNullSafe(F.col("id")), F.col("head")).alias("head"))
    records = rows.mapInArrow(_records(segment_bytes, row_bytes), "records binary")
    records.select(F.col("records").cast("string").alias("value")).write.option("lineSep", "\r\n").option("maxRecordsPerFile", rows_per_file).option("compression", "gzip").text(path)
    drop_written(heads)


def _parsed(f: BinaryIO) -> Iterator[tuple]:
    """Records of one archive, read as a stream, in the order of RECORD_SCHEMA."""
    while line := f.readline(1 << 16):
        if line in (b"\r\n", b"\n"):
            continue
        head, at_end = {}, False
        while (more := f.readline(1 << 20)) not in (b"\r\n", b"\n"):
            if not more:
                at_end = True
                break
            k, _, v = more.decode("utf-8", "replace").rstrip("\r\n").partition(":")
            head[k.strip().lower()] = v.strip()
        if not line.startswith(b"WARC/") or at_end:
            yield (None, "malformed", *[None] * 8, "no record header where one is due")
            return
        number = lambda k: int(head[k]) if head.get(k, "").lstrip("-").isdigit() else None  # noqa: B023, E731
        size = number("content-length")
        block = None if size is None or size < 0 else f.read(size)
        if block is None or len(block) < size:
            yield (head.get("warc-record-id"), "malformed", number("x-page-id"), *[None] * 7, "block shorter than Content-Length")
            return
        digest = head.get("warc-payload-digest", "").removeprefix("sha1:") or None
        yield (head.get("warc-record-id"), head.get("warc-type"), number("x-page-id"), head.get("warc-target-uri"), digest, number("x-refers-to-page-id"), number("warc-segment-number"), head.get("warc-segment-origin-id"), number("warc-segment-total-length"), block, None)


def _opened(raw: bytes) -> BinaryIO:
    return gzip.GzipFile(fileobj=io.BytesIO(raw)) if raw[:2] == b"\x1f\x8b" else io.BytesIO(raw)


_ARROW = [("record_id", pa.string()), ("record_type", pa.string()), ("page_id", pa.int64()), ("uri", pa.string()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("segment", pa.int32()), ("origin", pa.string()), ("total", pa.int64()), ("block", pa.binary()), ("error", pa.string())]
#: What a decoded payload adds.
_PAYLOAD = [("payload_bytes", pa.int64()), ("found_digest", pa.string()), ("payload", pa.binary())]
_PAYLOAD_SCHEMA = "payload_bytes long, found_digest string, payload binary"


def _batch(rows: list[tuple], fields: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows) if rows else [[]] * len(fields), fields)], [n for n, _ in fields])


def _decoded(block: bytes, keep: bool) -> tuple:
    payload = http_payload(block)
    return len(payload), hashlib.sha1(payload).hexdigest(), payload if keep else None


def _read(decode: bool, keep: bool):
    """Archives to records; with `decode`, the payload of an unsegmented response takes the place of its block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = _ARROW + (_PAYLOAD if decode else [])
        for batch in batches:
            for content in batch.column("content"):
                out, held = [], 0
                for row in _parsed(_opened(content.as_py())):
                    held += len(row[9] or b"")
                    if decode:
                        made, error = (None, None, None), row[10]
                        if row[1] == "response" and row[6] is None:
                            try:
                                made = _decoded(row[9], keep)
                            except ValueError as e:
                                error = str(e)
                        row = (*row[:9], row[9] if row[6] is not None else None, error, *made)
                    out.append(row)
                    if held > 4 << 20:
                        yield _batch(out, fields)
                        out, held = [], 0
                yield _batch(out, fields)

    return run


def _files(spark: SparkSession, path: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the archives under `path`, segments still apart (RECORD_SCHEMA)."""
    return _files(spark, path).mapInArrow(_read(False, True), RECORD_SCHEMA)


def _joined(keep: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for rid, parts in zip(batch.column("record_id").to_pylist(), batch.column("parts")):
                parts = parts.as_py()
                first = parts[0] if parts[0]["segment"] == 1 else {}
                made, error = (None, None, None), None
                try:
                    numbers = [p["segment"] for p in parts]
                    if numbers != list(range(1, len(parts) + 1)):
                        raise ValueError("segments missing, repeated or out of range: " + ", ".join(map(str, numbers[:20])))
                    block = b"".join(p["block"] for p in parts)
                    totals = {p["total"] for p in parts if p["total"] is not None}
                    if len(parts) > 1 and totals != {len(block)}:
                        raise ValueError(f"total length {sorted(totals)} stated, {len(block)} found")
                    made = _decoded(block, keep)
                except ValueError as e:
                    error = str(e)
                out.append((rid, first.get("page_id"), first.get("uri"), *made, error))
            yield _batch(out, [("record_id", pa.string()), ("page_id", pa.int64()), ("uri", pa.string()), *_PAYLOAD, ("error", pa.string())])

    return run


def reassembled(records: DataFrame, keep_payload: bool = True) -> DataFrame:
    """record_id, page_id, uri, payload_bytes, found_digest, payload, error of every segmented response: segments joined and transfer framing decoded.

    An origin without its first segment keeps its row, with null page_id.
    """
    cut = records.where("segment is not null and record_type in ('response', 'continuation')")
    first = lambda c: F.when(F.col("segment") == 1, F.col(c)).alias(c)
    cut = cut.groupBy(F.coalesce("origin", "record_id").alias("record_id")).agg(F.sort_array(F.array_distinct(F.collect_list(F.struct("segment", "total", "block", first("page_id"), first("uri"))))).alias("parts"))
    return cut.mapInArrow(_joined(keep_payload), f"record_id string, page_id long, uri string, {_PAYLOAD_SCHEMA}, error string")


def read_pages(spark: SparkSession, path: str, keep_payload: bool = True) -> DataFrame:
    """page_id, record_type, uri, payload_bytes, payload_digest, refers_to, payload, error per response or revisit record."""
    parsed = written(_files(spark, path).mapInArrow(_read(True, keep_payload), f"{RECORD_SCHEMA}, {_PAYLOAD_SCHEMA}"), "warc-parsed")
    columns = ["page_id", "uri", "payload_bytes", "found_digest", "payload", "error"]
    responses = parsed.where("record_type = 'response' and segment is null").select(*columns).unionByName(reassembled(parsed, keep_payload).select(*columns))
    if not keep_payload:
        responses = written(responses, "warc-responses")
    known = responses.where("page_id is not null").groupBy("page_id").agg(F.max(F.struct("found_digest", "payload_bytes")).alias("known")).withColumnRenamed("page_id", "refers_to")
    known = written(known, "warc-known")  # a table, so that Spark can split the revisits of a hot payload in the join
    revisits = parsed.where("record_type = 'revisit'").select("page_id", "record_type", "uri", "payload_digest", "refers_to").join(known, "refers_to", "left")
    fits = F.col("known.found_digest") == F.col("payload_digest")
    revisits = revisits.select("page_id", "record_type", "uri", F.when(fits, F.col("known.payload_bytes")).alias("payload_bytes"), "payload_digest", "refers_to", F.lit(None).cast("binary").alias("payload"), F.when(F.coalesce(fits, F.lit(False)), F.lit(None)).otherwise("the record referred to is missing or differs").alias("error"))
    responses = responses.select("page_id", F.lit("response").alias("record_type"), "uri", "payload_bytes", F.col("found_digest").alias("payload_digest"), F.lit(None).cast("long").alias("refers_to"), "payload", "error")
    return responses.unionByName(revisits)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    write_warc(load(spark, sf_dir, "pages"), path)
    return read_pages(spark, path, keep_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS b, octet_length(encode(coalesce(html, ''))) AS n FROM pages
), h AS (
  SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY b) ELSE page_id END AS head FROM p
)
SELECT page_id, n AS payload_bytes, sha1(b) AS payload_digest,
  CASE WHEN head = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN head = page_id THEN NULL ELSE head END AS refers_to
FROM h
"""
