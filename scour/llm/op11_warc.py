"""WARC archives: a writer of deduplicated records, and a reader that salvages damaged files.

Every record is a gzip member of its own.  A file is a few rows of whole members, written by Spark's text writer (so
its commit protocol covers lost executors and repeated tasks, on any file system that Spark writes).  The writer ends
each row with one zero byte, which is the last byte of the row's last member: a member ends with the high byte of its
length, zero below 16 MB, and a longer one is followed by an empty member.

The reader checks each member (gzip's checksum and length), then the record in it (version line, Content-Length, block
and payload digests).  Where a check fails it looks for the next member or version line that passes all of them, goes
on there, and logs the bytes between as a gap.  Plain records outside a member are read the same way.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scour.llm.common import scratch, written

EMPTY_MEMBER = zlib.compressobj(1, zlib.DEFLATED, 31).flush()
GZIP = b"\x1f\x8b\x08"
VERSION = b"WARC/1."
#: What may follow a candidate: a member, or a version line.
NEXT = re.compile(re.escape(GZIP) + rb"[\x00-\x1f]|WARC/1\.[01]\r\n")
#: Bytes of members in one written row; a file has at most ROWS_PER_FILE rows, so only a single longer record makes a longer file.
ROW_BYTES = 4 << 20
PIECE = 16 << 10
ROWS_PER_FILE = 4
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORD_SCHEMA = ("path string, start bigint, length bigint, reason string, record_id string, record_type string, target_uri string, "
                 "refers_to_id string, payload_digest string, payload_bytes bigint, payload binary")


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page: str | None) -> str:
    return f"<urn:page:{'null' if page is None else page}>"


def _uri(url: str | None, page: str | None) -> str:
    """The address with control characters, spaces and angle brackets as percent escapes; a header holds one line."""
    if not url:
        return record_id(page)[1:-1]
    return re.sub(r"[\x00-\x20<>\x7f-\x9f  ]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode("utf-8")), url)


def build_record(page: str | None, url: str | None, payload: bytes, original: str | None, revisit: bool, date: str, digest: str = "") -> bytes:
    """One response or revisit record.  A revisit keeps the HTTP headers, with the payload's length, but no payload."""
    digest = digest or sha1_base32(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page)}", f"WARC-Date: {date}",
             f"WARC-Target-URI: {_uri(url, page)}"]
    if revisit:
        lines += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: {record_id(original)}"]
    lines += [f"WARC-Block-Digest: sha1:{sha1_base32(block)}", f"WARC-Payload-Digest: sha1:{digest}",
              "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode("utf-8") + block + b"\r\n\r\n"


def parse_record(data: bytes, at: int) -> tuple[dict | None, int, str]:
    """The record whose version line is at ``at``: (its fields or None, end, why it fails)."""
    if not NEXT.match(data, at) or data[at:at + 1] != b"W":
        return None, at, "no version line"
    head = data.find(b"\r\n\r\n", at)
    if head < 0:
        return None, at, "headers don't end"
    fields: dict[str, str] = {}
    for line in data[at:head].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            return None, at, "a header without a colon"
        fields.setdefault(name.decode("latin-1").strip().lower(), value.decode("utf-8", "replace").strip())
    size = fields.get("content-length", "")
    if not re.fullmatch(r"[0-9]{1,18}", size):
        return None, at, "no Content-Length"
    start, end = head + 4, head + 4 + int(size)
    if data[end:end + 4] != b"\r\n\r\n" or len(data) < end + 4:
        return None, at, "Content-Length doesn't lead to the record's end"
    block = data[start:end]
    want = fields.get("warc-block-digest", "").removeprefix("sha1:")
    if want and want != sha1_base32(block):
        return None, at, "block digest"
    payload, length = block, len(block)
    if fields.get("content-type", "").startswith("application/http"):
        http, gap, payload = block.partition(b"\r\n\r\n")
        said = re.search(rb"(?im)^content-length:[ \t]*([0-9]{1,18})[ \t]*\r?$", http)
        length = int(said[1]) if said else len(payload)
    if fields.get("warc-type") == "revisit":
        payload = None
    else:
        length = len(payload)
        want = fields.get("warc-payload-digest", "").removeprefix("sha1:")
        if want and want != sha1_base32(payload):
            return None, at, "payload digest"
    return {"record_id": fields.get("warc-record-id"), "record_type": fields.get("warc-type"), "target_uri": fields.get("warc-target-uri"),
            "refers_to_id": fields.get("warc-refers-to"), "payload_digest": fields.get("warc-payload-digest", "").removeprefix("sha1:") or None,
            "payload_bytes": length, "payload": payload}, end + 4, ""


def read_member(data: bytes, at: int) -> tuple[list[dict], int, str]:
    """The records of the gzip member at ``at``: (records, end, why it fails).  All of a member's records pass or none."""
    d, view, parts, end = zlib.decompressobj(31), memoryview(data), [], at
    try:
        while not d.eof and end < len(data):  # in pieces: what follows the member is handed back as a copy
            parts.append(d.decompress(view[end:end + PIECE]))
            end = min(end + PIECE, len(data))
    except zlib.error as e:
        return [], at, f"gzip: {e}"
    if not d.eof:
        return [], at, "gzip: cut off"
    end -= len(d.unused_data)
    plain, found, p = b"".join(parts), [], 0
    while p < len(plain):
        fields, q, why = parse_record(plain, p)
        if fields is None:
            return [], at, why
        found.append(fields)
        p = q
    return found, end, ""


def salvage(data: bytes) -> Iterator[tuple[int, int, dict | None, str]]:
    """(start, length, fields, "") for each record and (start, length, None, first reason) for each gap, in order.
    Together they cover every byte, empty members aside."""
    at, gap, reason = 0, -1, ""
    while at < len(data):
        if data.startswith(GZIP, at):
            found, end, why = read_member(data, at)
        else:
            one, end, why = parse_record(data, at)
            found = [one] if one is not None else []
        if why:
            if gap < 0:
                gap, reason = at, why
            more = NEXT.search(data, at + 1)
            at = more.start() if more else len(data)
            continue
        if gap >= 0:
            yield gap, at - gap, None, reason
            gap = -1
        for fields in found:
            yield at, end - at, fields, ""
        at = end
    if gap >= 0:
        yield gap, len(data) - gap, None, reason


def _plan(pages: DataFrame, least: int) -> DataFrame:
    """page_id, url, body, and the largest page_id among equal payloads where there is more than one of them."""
    rows = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("body"))
    rows = rows.withColumn("key", F.sha2("body", 256))
    # Copies are folded in the map tasks; only payloads that repeat take part in the join back.
    best = rows.where(F.octet_length("body") >= least).groupBy("key").agg(F.max("page_id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
    best = written(best.where("copies > 1").select("key", "first_id"), "warc-copies")
    return rows.join(best, "key", "left").select("page_id", "url", "body", "first_id")


def write_warc(pages: DataFrame, path: str, date: str = "1970-01-01T00:00:00Z", least: int = 0, level: int = 1,
               row_bytes: int = ROW_BYTES) -> None:
    """Write a record for every row of ``pages`` (page_id, url, html) to a new folder.

    Of records with equal payloads of ``least`` bytes or more the one with the largest page_id is a response and the
    others revisit it.  Null html is an empty payload, which counts as any other; a null page_id is smaller than any
    number; rows that repeat the largest id and the payload are all responses.  A null or empty url gives the record's
    id as its address.  An empty table writes a folder without records; other columns are ignored.
    """
    rows = _plan(pages, least).select(F.col("page_id").cast("string").alias("page"), "url", "body", F.col("first_id").cast("string").alias("original"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[bytes] = []
        size = 0

        def row() -> pa.RecordBatch:
            if parts[-1][-1]:
                parts.append(EMPTY_MEMBER)
            return pa.RecordBatch.from_arrays([pa.array([b"".join(parts)[:-1]], pa.binary())], ["value"])

        for batch in batches:
            page, url, body, original = batch.columns
            for i in range(batch.num_rows):
                own, other, payload = page[i].as_py(), original[i].as_py(), body[i].as_py()
                packer = zlib.compressobj(level, zlib.DEFLATED, 31)
                raw = build_record(own, url[i].as_py(), payload, other, other is not None and own != other, date)
                parts.append(packer.compress(raw) + packer.flush())
                size += len(parts[-1])
                if size >= row_bytes:
                    yield row()
                    parts.clear()
                    size = 0
        if parts:
            yield row()

    packed = rows.mapInArrow(pack, "value binary").select(F.col("value").cast("string").alias("value"))
    packed.write.option("lineSep", "\0").option("compression", "none").option("maxRecordsPerFile", ROWS_PER_FILE).text(path)


def read_warc(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """Every record and every gap of the archives under ``path``.

    A record has its place (path, start, length of its member), ids, type, address, digest, payload_bytes (a revisit's
    is that of the payload it stands for) and, with ``payloads``, the bytes.  A gap has path, start, length and the
    reason of the first failed check; all else is null.  A file is read by one task, whole.  Empty files give no rows.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    names = [f.split()[0] for f in RECORD_SCHEMA.split(", ")]
    types = {"start": pa.int64(), "length": pa.int64(), "payload_bytes": pa.int64(), "payload": pa.binary()}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], types.get(n, pa.string())) for n in names], names)

        for batch in batches:
            for i in range(batch.num_rows):
                name, rows, held = batch.column(0)[i].as_py(), [], 0
                for start, length, fields, why in salvage(batch.column(1)[i].as_py()):
                    row = {"path": name, "start": start, "length": length, "reason": why or None} | (fields or {})
                    if payloads:
                        held += len(row.get("payload") or b"")
                    else:
                        row["payload"] = None
                    rows.append(row)
                    if len(rows) >= 5000 or held >= ROW_BYTES:
                        yield batch_of(rows)
                        rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    return files.mapInArrow(read, RECORD_SCHEMA)


def page_of(col: str, kind: str = "bigint") -> Column:
    """The page_id in a record id that ``write_warc`` made (null for the one of a null page_id)."""
    return F.regexp_extract(col, "^<urn:page:(.*)>$", 1).try_cast(kind)


def round_trip(pages: DataFrame, least: int = 0, path: str | None = None) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of every record, as read back from the archives
    that ``write_warc`` has written from ``pages``."""
    spark = pages.sparkSession
    path = path or scratch(spark, "warc")
    write_warc(pages, path, least=least)
    kind = pages.schema["page_id"].dataType.simpleString()
    found = read_warc(spark, path).where("reason is null")
    return found.select(page_of("record_id", kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                        page_of("refers_to_id", kind).alias("refers_to"))
