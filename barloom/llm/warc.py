"""WARC archives of pages: one gzip stream per archive, normalised to one member per record with a sidecar index.

Archives are rows (archive, content) of a table, so they live wherever Spark's tables do; archives that exist as files
come from ``spark.read.format("binaryFile")``.
"""

from __future__ import annotations

import base64
import hashlib
import json
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.shingles import rows, small_batches, utf8
from barloom.llm.text import small_side, written

GZIP = 31  # zlib's window bits for a gzip member
#: Bytes of records after which a task begins another archive, and of input handed to the inflater at once.
ARCHIVE_BYTES, STEP = 16 << 20, 1 << 20
#: Streams that are only read once are packed fast; members stay.
STREAM_LEVEL, MEMBER_LEVEL = 1, 6
DATE = "1970-01-01T00:00:00Z"  # the pages carry no fetch time
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_END = b"\r\n\r\n"


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _field(value: str) -> str:
    """A header value cannot break its line."""
    return "".join(f"%{ord(c):02X}" if ord(c) < 32 or c == "\x7f" else c for c in value)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record. A revisit keeps the HTTP header, with the full payload's length, and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_field(url)}")
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += [f"WARC-Payload-Digest: sha1:{sha1_base32(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + _END + block + _END


def header(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    return {name.strip().lower(): value.strip() for name, _, value in (x.partition(":") for x in lines[1:])}


def inflated(content: bytes) -> Iterator[bytes]:
    """The bytes of a gzip file of any number of members, each byte inflated once, at most a step at a time."""
    unpack = zlib.decompressobj(GZIP)
    for i in range(0, len(content), STEP):
        data = content[i : i + STEP]
        while data:
            yield unpack.decompress(data, STEP)
            data = unpack.unused_data if unpack.eof else unpack.unconsumed_tail
            if unpack.eof:
                unpack = zlib.decompressobj(GZIP)
    yield unpack.flush()


def split_records(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and raw bytes of each record of a stream; a record may span any number of pieces."""
    held = bytearray()
    need = 0  # bytes before which nothing new can be cut
    for piece in pieces:
        held += piece
        while len(held) >= max(need, 1):
            at = held.find(_END)
            if at < 0:
                need = len(held) + 1
                break
            fields = header(bytes(held[:at]))
            whole = at + 4 + int(fields.get("content-length", 0)) + 4
            if len(held) < whole:
                need = whole
                break
            yield fields, bytes(held[:whole])
            del held[:whole]
            need = 0
    if held.strip():
        raise ValueError(f"{len(held)} bytes after the last record")


def member(data: bytes) -> bytes:
    pack = zlib.compressobj(MEMBER_LEVEL, zlib.DEFLATED, GZIP)
    return pack.compress(data) + pack.flush()


def marked(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, refers_to, revisit: pages whose equal payload has a page with a larger id revisit that.

    Only payloads that occur more than once are looked up; a common one costs a row per task in the sums, and no
    payload moves while those fit a broadcast.
    """
    small_batches(pages.sparkSession)
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), utf8("html").alias("payload"))
    base = base.withColumn("sha", F.sha1("payload"))
    many = (
        base.filter(F.octet_length("payload") >= least_bytes).groupBy("sha")
        .agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("n")).filter("n > 1 and keeper is not null").select("sha", "keeper")
    )
    many = written(many, "payloads")
    out = base.join(small_side(many), "sha", "left")
    revisit = F.col("keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper"))
    return out.select("page_id", "url", "payload", F.when(revisit, F.col("keeper")).alias("refers_to"), revisit.alias("revisit"))


def _stream(archive_bytes: int):
    schema = pa.schema([("archive", pa.string()), ("content", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, size, out, pack = TaskContext.get().partitionId(), 0, 0, [], None

        def closed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f"part-{part:07d}-{n:05d}"]), pa.array([b"".join([*out, pack.flush()])], pa.binary())], schema=schema)

        for page_id, url, payload, refers_to, revisit in rows(batches):
            if pack is None:
                pack, out, size = zlib.compressobj(STREAM_LEVEL, zlib.DEFLATED, GZIP), [], 0
            data = record(page_id, url, payload, refers_to, revisit)
            out.append(pack.compress(data))
            size += len(data)
            if size >= archive_bytes:
                yield closed()
                pack, n = None, n + 1
        if pack is not None:
            yield closed()

    return run, "archive string, content binary"


def write_streams(records: DataFrame, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """archive, content: the records of ``marked`` as archives of one gzip stream each, written."""
    run, schema = _stream(archive_bytes)
    return written(records.mapInArrow(run, schema), "warc-streams")


def _normalise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for archive, content in rows(batches):
        out, index, offset = [], [], 0
        for fields, data in split_records(inflated(content)):
            packed = member(data)
            index.append(json.dumps({
                "offset": offset, "length": len(packed), "type": fields.get("warc-type"), "id": fields.get("warc-record-id"),
                "digest": fields.get("warc-payload-digest"), "url": fields.get("warc-target-uri"),
            }))
            out.append(packed)
            offset += len(packed)
        yield pa.RecordBatch.from_arrays([pa.array([archive]), pa.array([b"".join(out)], pa.binary()), pa.array(["\n".join(index)])], names=["archive", "content", "index"])


def normalise(archives: DataFrame) -> DataFrame:
    """archive, content, index: every record its own gzip member, and a line of JSON per record with its offset and
    length, in order. The input may have one member, one per record or anything between; an empty one gives no lines."""
    return written(archives.select("archive", "content").mapInArrow(_normalise, "archive string, content binary, index string"), "warc-members")


def offsets(members: DataFrame) -> DataFrame:
    """The sidecar as a table: archive and the fields of each line."""
    lines = members.select("archive", F.explode(F.filter(F.split("index", "\n"), lambda x: x != "")).alias("line"))
    fields = F.from_json("line", "offset long, length long, type string, id string, digest string, url string")
    return lines.select("archive", fields.alias("r")).select("archive", "r.*")


def _number(urn: str | None) -> int | None:
    tail = (urn or "").rstrip(">").rpartition(":")[2]
    return int(tail) if tail else None


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
    for content, index in rows(batches):
        found = []
        for line in filter(None, index.split("\n")):
            at = json.loads(line)
            data = zlib.decompress(content[at["offset"] : at["offset"] + at["length"]], GZIP)
            head, _, block = data[:-4].partition(_END)
            fields = header(head)
            http, _, payload = block.partition(_END)
            digest, kind = fields["warc-payload-digest"].removeprefix("sha1:"), fields["warc-type"]
            if kind == "response" and sha1_base32(payload) != digest:
                raise ValueError(f"payload of {fields['warc-record-id']} does not have its digest")
            found.append((
                _number(fields["warc-record-id"]), int(header(http)["content-length"]), digest, kind,
                _number(fields.get("warc-refers-to")), fields.get("warc-target-uri"), payload if kind == "response" else None,
            ))
            if len(found) >= 500:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)], names=names)
                found = []
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)], names=names)


def read_members(members: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, url, payload (null for a revisit) of every
    record, each member found by the index and inflated alone; the digest of a stored payload is proved."""
    return members.select("content", "index").mapInArrow(
        _read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"
    )


def archived(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Pages (page_id, url, html, any others) written as archives, normalised and read back, a row per page.

    Null html is an empty payload; null urls are left out. Of equal payloads the page with the largest id keeps it
    (rows that repeat that id keep it too), all others revisit it, rows without an id among them; payloads below
    ``least_bytes`` are always kept. An empty table gives no archives.
    """
    return read_members(normalise(write_streams(marked(pages, least_bytes))))
