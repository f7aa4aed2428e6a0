"""WARC archives of web pages and a salvage reader (operator 13).

``write_warc`` writes one record per page, each a gzip member of its own: a ``response`` with the
page as HTTP payload or, if an equal payload of at least ``min_bytes`` bytes belongs to a smaller
page_id, a ``revisit`` that names that page's record and carries the HTTP headers only. Spark's
text writer puts the members down, so files appear with the job's commit on any file system; its
line separator is an empty gzip member, and the files stay valid gzip throughout.

``read_warc`` walks archives, also foreign ones, whose records are gzip members or plain. Every
record must hold its checks: member checksum, version line, header lines, Content-Length, the two
line ends behind the block, and the payload's length and digest where they are stated. After a
failed check the reader searches for the next gzip magic or version line at which a whole valid
record starts, goes on there, and logs the bytes between as one gap with the first check that
failed. A file is read whole by one task: ``records_per_file`` bounds the files written here.

Defined results: null html is the empty payload; a null url has no WARC-Target-URI; control
characters in a url are percent-encoded. A null page_id is no one's smallest: such a row revisits
a page with an id if there is one, else it is a response. Of rows that repeat the smallest page_id
with one payload all are responses. An empty table gives files without records. Other columns
are not read. A member that is cut out by damage to its own bytes is lost (and logged); if the
payload of a damaged plain record itself holds a whole WARC record, that one is reported.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agora.llm.common import map_batches, stage
from agora.session import application_scratch

CRLF = b"\r\n"
#: Names and values that the WARC format fixes.
VERSION = b"WARC/1.1"
REVISIT_PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MAGIC = b"\x1f\x8b\x08"
_VERSION_LINE = re.compile(rb"WARC/1\.[01]\r\n")
#: Where a record may start: a gzip member, or a version line at the start of a line.
_START = re.compile(rb"\x1f\x8b\x08|(?<=\n)WARC/1\.[01]\r\n")
#: Longest header part that is looked for, and bytes given to the inflater at a time.
MAX_HEADER, STEP = 1 << 16, 1 << 14


def member(data: bytes, level: int = 6) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


SEPARATOR = member(b"")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# -------------------------------------------------------------------- writing

def _record_id(page_id: int | None) -> bytes:
    return b"<urn:page:%s>" % (b"none" if page_id is None else b"%d" % page_id)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One record, a revisit if ``refers_to`` is given, with the two line ends behind it."""
    block = CRLF.join([b"HTTP/1.1 200 OK", b"Content-Type: text/html; charset=utf-8", b"Content-Length: %d" % len(payload), CRLF])
    head = [VERSION, b"WARC-Type: " + (b"response" if refers_to is None else b"revisit"), b"WARC-Record-ID: " + _record_id(page_id),
            b"WARC-Date: " + date.encode(), b"WARC-Payload-Digest: sha1:" + digest(payload).encode(),
            b"Content-Type: application/http; msgtype=response"]
    if url is not None:
        head.append(b"WARC-Target-URI: " + re.sub(rb"[\x00-\x20\x7f]", lambda m: b"%%%02X" % m[0][0], url.encode()))
    if refers_to is None:
        block += payload
    else:
        head += [b"WARC-Refers-To: " + _record_id(refers_to), b"WARC-Profile: " + REVISIT_PROFILE]
    return CRLF.join([*head, b"Content-Length: %d" % len(block), b"", block, b"", b""])


def write_warc(pages: DataFrame, folder: str, min_bytes: int = 0, records_per_file: int = 20_000,
               date: str = "1970-01-01T00:00:00Z", level: int = 6) -> None:
    """Write ``pages`` (page_id, url, html) as archives below ``folder``, which must not exist."""
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.coalesce("html", F.lit("")).alias("html"))
    same = F.sha2("html", 256)
    large = rows.where(F.octet_length("html") >= min_bytes) if min_bytes else rows
    # written, so that its join with the pages is one that AQE can split at a very common payload
    first = stage(large.groupBy(same.alias("same")).agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
                  .where("n > 1 and first is not null").select("same", "first"))
    known = rows.withColumn("same", same).join(first, "same", "left").select(
        "page_id", "url", "html", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [member(record(p, u, h.as_buffer().to_pybytes(), r, date), level)
                 for p, u, h, r in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist())]
        return pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], ["member"])

    members = map_batches(known, run, "member binary")
    (members.select(F.col("member").cast("string")).write.option("lineSep", SEPARATOR.decode("latin-1")).option("encoding", "ISO-8859-1")
     .option("compression", "none").option("maxRecordsPerFile", records_per_file).text(folder))


# -------------------------------------------------------------------- reading

class Damaged(Exception):
    """A check that failed."""


@dataclass
class Record:
    kind: str
    page_id: int | None = None
    url: str | None = None
    payload_bytes: int = 0
    payload_digest: str | None = None
    refers_to: int | None = None
    payload: bytes | None = None


def _page(value: bytes | None) -> int | None:
    found = re.fullmatch(rb"<urn:page:(-?\d+)>", value or b"")
    return int(found[1]) if found else None


def _fields(lines: bytes) -> dict[bytes, bytes]:
    fields = {}
    for line in lines.split(CRLF):
        name, colon, value = line.partition(b":")
        if not colon or not name:
            raise Damaged("header line")
        fields[name.strip().lower()] = value.strip()
    return fields


def _number(value: bytes | None, what: str) -> int:
    if value is None or not value.isdigit():
        raise Damaged(what)
    return int(value)


def parse_record(data: bytes | memoryview, start: int) -> tuple[Record, int]:
    """The plain record at ``start`` of ``data`` and its end; raises if a check fails."""
    top = bytes(data[start:start + MAX_HEADER])
    version = _VERSION_LINE.match(top)
    if not version:
        raise Damaged("version line")
    stop = top.find(CRLF + CRLF, version.end())
    if stop < 0:
        raise Damaged("header end")
    fields = _fields(top[version.end():stop])
    begin = start + stop + 4
    end = begin + _number(fields.get(b"content-length"), "content length")
    if bytes(data[end:end + 4]) != CRLF + CRLF:
        raise Damaged("record end")
    got = Record(fields.get(b"warc-type", b"").decode("latin-1"), _page(fields.get(b"warc-record-id")),
                 fields.get(b"warc-target-uri", b"").decode("utf-8", "replace") or None)
    block = bytes(data[begin:end])
    if got.kind in ("response", "revisit"):
        http, blank, payload = block.partition(CRLF + CRLF)
        if not blank:
            raise Damaged("http header end")
        lines = _fields(http.partition(CRLF)[2])
        got.payload_bytes = _number(lines.get(b"content-length", b"%d" % len(payload)), "payload length")
        stated = fields.get(b"warc-payload-digest", b"").decode("latin-1")
        got.payload_digest = stated.removeprefix("sha1:") or None
        got.refers_to = _page(fields.get(b"warc-refers-to"))
        if got.kind == "response":
            if got.payload_bytes != len(payload):
                raise Damaged("payload length")
            found = digest(payload)
            if stated.startswith("sha1:") and stated != f"sha1:{found}":
                raise Damaged("payload digest")
            got.payload, got.payload_digest = payload, found
    return got, end + 4


def inflate(data: memoryview, start: int) -> tuple[bytes, int]:
    """Content of the gzip member at ``start`` and its end; raises if it is damaged or cut."""
    unpacker, out, at = zlib.decompressobj(31), [], start
    try:
        while not unpacker.eof and at < len(data):
            out.append(unpacker.decompress(data[at:at + STEP]))
            at += STEP
    except zlib.error as error:
        raise Damaged("gzip member") from error
    if not unpacker.eof:
        raise Damaged("gzip member end")
    return b"".join(out), min(at, len(data)) - len(unpacker.unused_data)


def _entry(data: memoryview, start: int) -> tuple[Record | None, int]:
    """The record, member or plain, at ``start``; None for an empty member."""
    if data[start:start + 3] != MAGIC:
        return parse_record(data, start)
    content, end = inflate(data, start)
    if not content:
        return None, end
    got, used = parse_record(content, 0)
    if used != len(content):
        raise Damaged("member of more than a record")
    return got, end


def salvage(content: bytes) -> Iterator[tuple[int, int, Record | str]]:
    """Start, end and either the record or, for a gap, the check that failed first."""
    data, at, gap = memoryview(content), 0, None
    while at < len(data):
        try:
            got, end = _entry(data, at)
        except Damaged as reason:
            gap = gap or (at, str(reason))
            found = _START.search(content, at + 1)
            at = found.start() if found else len(data)
            continue
        if got is not None:
            if gap:
                yield gap[0], at, gap[1]
                gap = None
            yield at, end, got
        elif gap and content.startswith(SEPARATOR, at):
            yield gap[0], at, gap[1]
            gap = None
        at = end
    if gap:
        yield gap[0], len(data), gap[1]


ENTRY = ("file string, start bigint, end bigint, gap string, page_id bigint, url string, payload_bytes bigint, "
         "payload_digest string, record_type string, refers_to bigint")


def read_warc(spark: SparkSession, folder: str, payload: bool = True) -> DataFrame:
    """One row per record and per gap of the archives below ``folder``: place (``file, start,
    end``), ``gap`` (the failed check; null for records), ``page_id, url, payload_bytes,
    payload_digest`` (base32 SHA-1), ``record_type, refers_to`` and, if asked for, the ``payload``
    of responses. Lengths and digests of a revisit are those its record states."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows: list[tuple] = []
                size = 0
                for start, end, got in salvage(content.as_buffer().to_pybytes()):
                    if isinstance(got, str):
                        rows.append((name, start, end, got, None, None, None, None, None, None, None))
                    else:
                        rows.append((name, start, end, None, got.page_id, got.url, got.payload_bytes, got.payload_digest,
                                     got.kind, got.refers_to, got.payload if payload else None))
                        size += len(got.payload or b"") if payload else 0
                    if len(rows) >= 4096 or size > 1 << 24:
                        yield _batch(rows)
                        rows, size = [], 0
                if rows:
                    yield _batch(rows)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(),
                 pa.int64(), pa.binary()][:10 + payload]
        names = [c.split()[0] for c in ENTRY.split(", ")] + ["payload"]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names[:len(kinds)])

    files = spark.read.format("binaryFile").load(folder).select("path", "content")
    return files.mapInArrow(run, ENTRY + (", payload binary" if payload else ""))


def new_folder(spark: SparkSession) -> str:
    """A folder of this application's own for archives that only it needs."""
    return application_scratch(spark).new_path("warc")
