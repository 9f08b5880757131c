"""Operator 4: WARC archives with revisit records, and a reader that salvages damaged ones.

`plan_records` decides response or revisit, `write_archives` packs records as gzip members into archive blobs, and
`read_archives` reads them back. After a member or record fails a check (gzip checksum, version line, header block,
content length, payload digest, payload length), the reader searches for the next valid member or version line, goes on there, and
returns the skipped bytes as a row of kind `gap` with the reason. Bytes skipped inside a member that is whole have a row for
each stretch, with its place among the unpacked bytes. Members are unpacked in small steps, and only as far as the lengths
that their records declare reach (and UNDECLARED bytes more), so a small member cannot fill a worker's memory.

Defined results: null html is an empty payload; payloads under MIN_REVISIT bytes are never revisited; a row whose id is
null or equal to the response's id is a response; control characters in a url are percent-encoded.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy

MIN_REVISIT = 100
#: Bytes at which an archive is closed.
ARCHIVE_BYTES = 4 << 20
#: Compressed bytes and unpacked bytes of one step; unpacked bytes of a member that no record declares, and of one record.
STEP, UNPACKED = 1 << 16, 1 << 20
UNDECLARED, MOST_RECORD = 1 << 20, 1 << 30


def plan_records(pages: DataFrame) -> DataFrame:
    """page_id, url, html, digest, record_type, refers_to: equal payloads of MIN_REVISIT bytes are stored once.

    Only digests that occur under several ids reach the join, one row each; copies of a page are counted map-side.
    """
    own = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).alias("html")).withColumn("digest", F.sha2(F.col("html").cast("binary"), 256))
    firsts = (
        own.where(F.octet_length("html") >= MIN_REVISIT)
        .groupBy("digest")
        .agg(F.min("page_id").alias("first_id"), F.max("page_id").alias("last_id"))
        .where("first_id < last_id")
        .select("digest", "first_id")
    )
    again = F.col("page_id") > F.col("first_id")
    return own.join(firsts, "digest", "left").select(
        "page_id", "url", "html", "digest",
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.when(again, F.col("first_id")).alias("refers_to"),
    )


def _uri(page_id: int | None) -> str:
    return f"<urn:page:{page_id if page_id is not None else 'null'}>"


def _id(uri: str) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?\d+)>", uri)
    return int(m[1]) if m else None


def record(page_id: int | None, url: str | None, html: bytes, digest: str, kind: str, refers_to: int | None) -> bytes:
    safe = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_uri(page_id)}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {safe}", f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Payload-Length: {len(html)}"]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_uri(refers_to)}"]
    block = html if kind == "response" else b""
    head += ["Content-Type: text/html", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """data as one gzip member."""
    packer = zlib.compressobj(3, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def write_archives(records: DataFrame) -> DataFrame:
    """archive_id and content: plan_records' rows as archives of gzip members, some per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, open_, size = TaskContext.get().partitionId(), 0, [], 0

        def closed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f"{part:06d}-{n:04d}"]), pa.array([b"".join(open_)], pa.binary())], names=["archive_id", "content"])

        for batch in batches:
            for page_id, url, html, digest, kind, refers in zip(*(batch.column(i).to_pylist() for i in range(6))):
                open_.append(member(record(page_id, url, html.encode(), digest, kind, refers)))
                size += len(open_[-1])
                if size >= ARCHIVE_BYTES:
                    yield closed()
                    n, open_, size = n + 1, [], 0
        if open_:
            yield closed()

    cols = ["page_id", "url", "html", "digest", "record_type", "refers_to"]
    return records.select(*cols).mapInArrow(tidy(run), "archive_id string, content binary")


_VERSION = re.compile(rb"WARC/1\.[01]\r\n")


_LENGTH = re.compile(rb"\r\ncontent-length:[ \t]*(\d{1,18})[ \t]*\r\n", re.I)


def _declared(out: bytearray, at: int) -> int | None:
    """Bytes that the record at `at` says it has, or None as long as its headers are not whole."""
    stop = out.find(b"\r\n\r\n", at)
    m = _LENGTH.search(out, at, stop + 2) if stop >= 0 and out.startswith(b"WARC/1.", at) else None
    return stop + 8 - at + int(m[1]) if m else None


def _inflate(data: bytes, at: int) -> tuple[bytes, int] | str:
    """The gzip member at `at` and where it ends, or why it is not whole, its checksum does not hold, or it is too large."""
    unpacker, view, out = zlib.decompressobj(31), memoryview(data), bytearray()
    known = 0  # unpacked bytes that records declare
    while not unpacker.eof:
        piece = unpacker.unconsumed_tail
        if not piece:
            piece, at = view[at : at + STEP], at + STEP
            if not piece:
                return "bad gzip member"
        try:
            out += unpacker.decompress(piece, UNPACKED)
        except zlib.error:
            return "bad gzip member"
        while known < len(out) and (size := _declared(out, known)):
            if size > MOST_RECORD:
                return "record too large"
            known += size
        if len(out) > known + UNDECLARED:
            return "more bytes than records declare"
    return bytes(out), min(at, len(data)) - len(unpacker.unused_data)


def _parse(data: bytes, at: int) -> tuple[dict[str, str], bytes, int] | str:
    """The record at `at`: headers, block and end, or what is wrong with it."""
    m = _VERSION.match(data, at)
    if not m:
        return "no version line"
    stop = data.find(b"\r\n\r\n", m.end() - 2)
    if stop < 0:
        return "header block not closed"
    head = {}
    for line in data[m.end() : stop].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            return "bad header line"
        head[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
    length = head.get("content-length", "")
    if not (length.isascii() and length.isdigit()):
        return "no content length"
    start = stop + 4
    end = start + int(length)
    if data[end : end + 4] != b"\r\n\r\n":
        return "content length does not meet the record's end"
    block = data[start:end]
    if head.get("warc-type") == "response" and head.get("warc-payload-digest") != f"sha256:{hashlib.sha256(block).hexdigest()}":
        return "payload digest differs"
    payload = head.get("warc-payload-length", length)
    if not (payload.isascii() and payload.isdigit()) or head.get("warc-type") == "response" and int(payload) != len(block):
        return "payload length differs"
    return head, block, end + 4


def salvage(data: bytes) -> Iterator[tuple[str, int, int, str, dict[str, str], bytes]]:
    """Rows of an archive: kind (`record` or `gap`), place, length, reason, headers, block. Plain and gzip records mix.

    A gap inside a member has the member's place and length, and its own among the unpacked bytes in inner-start and
    inner-length of its headers.
    """
    at = 0
    while at < len(data):
        one: str | tuple = "bad gzip member"
        if data.startswith(b"\x1f\x8b", at):
            got = _inflate(data, at)
            if not isinstance(got, str):
                inner, end = got
                p = 0
                while p < len(inner):
                    found = _parse(inner, p)
                    if not isinstance(found, str):
                        yield "record", at, end - at, "", found[0], found[1]
                        p = found[2]
                        continue
                    m = _VERSION.search(inner, p + 1)
                    stop = m.start() if m else len(inner)
                    yield "gap", at, end - at, found, {"inner-start": str(p), "inner-length": str(stop - p)}, b""
                    p = stop
                at = end
                continue
            one = got
        else:
            one = _parse(data, at)
        if not isinstance(one, str):
            yield "record", at, one[2] - at, "", one[0], one[1]
            at = one[2]
            continue
        nxt = _next_start(data, at + 1)
        yield "gap", at, nxt - at, one, {}, b""
        at = nxt


def _next_start(data: bytes, at: int) -> int:
    """The next version line, or member that begins with one; each is looked for once, however many bytes look like a member."""
    m = _VERSION.search(data, at)
    line = m.start() if m else len(data)
    while 0 <= (member_ := data.find(b"\x1f\x8b\x08", at, line + 2)) < line:
        if _starts_record(data, member_):
            return member_
        at = member_ + 1
    return line


def _starts_record(data: bytes, at: int) -> bool:
    """Whether the gzip member at `at` unpacks to a version line; a look at its first bytes."""
    try:
        return bool(_VERSION.match(zlib.decompressobj(31).decompress(memoryview(data)[at : at + 4096], 16)))
    except zlib.error:
        return False


def read_archives(archives: DataFrame) -> DataFrame:
    """kind, archive_id, start, length, reason, of records page_id, record_type, refers_to, digest, payload_bytes, block; of
    gaps inside a member inner_start and inner_length."""
    names = ["kind", "archive_id", "start", "length", "reason", "inner_start", "inner_length", "page_id", "record_type", "refers_to", "payload_digest", "payload_bytes", "block"]
    types = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = []
                for kind, at, n, reason, head, block in salvage(content or b""):
                    size = head.get("warc-payload-length", str(len(block)))
                    inner = [int(head[k]) if k in head and kind == "gap" else None for k in ("inner-start", "inner-length")]
                    rows.append((kind, archive, at, n, reason, *inner, _id(head.get("warc-record-id", "")), head.get("warc-type"), _id(head.get("warc-refers-to", "")), head.get("warc-payload-digest", "").removeprefix("sha256:") or None, int(size), block))
                    if len(rows) >= 1000:
                        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), types)], names=names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), types)], names=names)

    return archives.select("archive_id", "content").mapInArrow(tidy(run), "kind string, archive_id string, start long, length long, reason string, inner_start long, inner_length long, page_id long, record_type string, refers_to long, payload_digest string, payload_bytes long, block binary")


ORACLE_SQL = """
with own as (select page_id, coalesce(html, '') as html, sha256(coalesce(html, '')) as d, strlen(coalesce(html, '')) as n from pages),
firsts as (select d, min(page_id) as first_id from own where n >= 100 group by d)
select page_id, n::bigint as payload_bytes, d as payload_digest,
  case when page_id > first_id then 'revisit' else 'response' end as record_type,
  case when page_id > first_id then first_id end as refers_to
from own left join firsts using (d)
"""
