"""WARC archives: writing one gzip member per record, and a splittable reader.

Writing. Pages with equal payloads are found by digest, with a combined maximum before
the shuffle; the one with the largest page_id becomes a response record, the others
revisit records that refer to it and carry no payload. Members are built on the
executors and written by Spark's own text writer and committer, so a lost task leaves
nothing behind and any store that Spark writes to will do. Between lines that writer
puts a separator: here an empty gzip member, so that every file is a valid sequence of
members.

Reading. Files are cut into byte ranges. A task scans its range for the gzip magic and
validates a candidate by decoding its start: it must unpack to a WARC header. Records
that start inside the range are its own, wherever they end; from the end of a member
the scan goes on. Other matches of the magic are passed over. A range needs memory for
itself and one record. Ranges are read through pyarrow's file systems (local or shared
folders, HDFS, S3, GCS).

Null html counts as an empty payload; a null url leaves its header out; a null page_id
has a record id of its own kind and sorts below all others. Rows that repeat the largest
page_id of a payload are all responses. An empty table gives an archive without records
and an empty result. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stage, columns, ready

# The gzip magic with the only compression method, and a member without content.
MAGIC = b"\x1f\x8b\x08"
EMPTY = MAGIC + bytes(6) + b"\xff\x03\x00" + bytes(8)
RANGE = 4 << 20
DATE = "2024-01-01T00:00:00Z"
LEVEL = 4
# The upper halves of record ids of pages, and of pages without id.
OWNER, NOBODY = 0x7A61_6C6C_7962_4F6B, 0x7A61_6C6C_7962_4E6F


def record_id(page_id: int | None) -> str:
    high, low = (NOBODY, 0) if page_id is None else (OWNER, page_id & (2**64 - 1))
    return f"<urn:uuid:{uuid.UUID(int=high << 64 | low)}>"


def page_of(record: str | None) -> int | None:
    """The page_id in a record id; None for one without."""
    if not record:
        return None
    number = uuid.UUID(record.strip("<>").rpartition(":")[2]).int
    low = number & (2**64 - 1)
    return None if number >> 64 != OWNER else low - 2**64 if low >> 63 else low


def digest32(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def member(page_id: int | None, url: str | None, payload: bytes, sha1: bytes, size: int, refers_to: int | None, revisit: bool, date: str) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + quote(url, safe="%/:=&?~#+!$,;'@()*[]"))
    if revisit:
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        lines.append(f"WARC-Refers-To: {record_id(refers_to)}")
    lines += [f"WARC-Payload-Digest: sha1:{digest32(sha1)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    pack = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()


def write_archive(pages: DataFrame, path: str, revisit_from: int = 0, date: str = DATE) -> None:
    """Write ``pages`` (page_id, url, html) as an archive below ``path``.

    Payloads of fewer than ``revisit_from`` bytes are written as responses every time.
    """
    ready(pages.sparkSession)
    rows = columns(pages, ("page_id", "url", "html")).select(
        F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload")
    )
    rows = rows.withColumns({"sha1": F.sha1("payload"), "size": F.octet_length("payload")})
    repeated = (
        rows.where(F.col("size") >= revisit_from).groupBy("sha1").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    )
    rows = rows.join(repeated, "sha1", "left").withColumn(
        "revisit", (F.col("size") >= revisit_from) & F.col("refers_to").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("refers_to"))
    )
    rows = rows.withColumn("payload", F.when(~F.col("revisit"), F.col("payload")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [
                member(r["page_id"], r["url"], r["payload"], bytes.fromhex(r["sha1"]), r["size"], r["refers_to"], r["revisit"], date)
                for r in b.to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    # The text writer puts out the bytes of a string as they are.
    lines = rows.mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))
    lines.write.option("lineSep", EMPTY.decode("latin-1")).option("encoding", "ISO-8859-1").text(path)


def opened(path: str) -> pa.NativeFile:
    if path.startswith("file:"):
        return pafs.LocalFileSystem().open_input_file("/" + path[5:].lstrip("/"))
    system, name = pafs.FileSystem.from_uri(path)
    return system.open_input_file(name)


def unpacked(data: bytes, at: int, more) -> tuple[bytes, int] | None:
    """The content of the member at ``data[at:]`` and its size; None if there is no record.

    ``more()`` gives the bytes that follow ``data``, block by block, b"" at the end.
    """
    unpack = zlib.decompressobj(31)
    view = memoryview(data)[at:]
    try:
        # A look at the start is enough to turn false magic away.
        first = unpack.decompress(view[:4096], 64)
        if not unpack.eof and not first.startswith(b"WARC/1."[: len(first)]):
            return None
        parts, fed = [first], len(view[:4096])
        parts.append(unpack.decompress(unpack.unconsumed_tail))
        if not unpack.eof:
            parts.append(unpack.decompress(view[fed:]))
            fed = len(view)
        while not unpack.eof:
            block = more()
            if not block:
                return None
            parts.append(unpack.decompress(block))
            fed += len(block)
    except zlib.error:
        return None
    content = b"".join(parts)
    if content and not content.startswith(b"WARC/1."):
        return None
    return content, fed - len(unpack.unused_data)


def owned(file: pa.NativeFile, size: int, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(place, content) of the records whose member starts in ``[start, end)``."""
    data = file.read_at(min(end + len(MAGIC) - 1, size) - start, start)
    at = 0
    while (at := data.find(MAGIC, at)) >= 0 and start + at < end:
        reach = start + len(data)

        def more() -> bytes:
            nonlocal reach
            block = file.read_at(min(1 << 20, size - reach), reach) if reach < size else b""
            reach += len(block)
            return block

        found = unpacked(data, at, more)
        if found is None:
            at += 1
            continue
        content, length = found
        if content:
            yield start + at, content
        at += length
        if at >= len(data):
            return


def parsed(content: bytes) -> dict | None:
    """The fields of a record; None if its header or block is cut short."""
    head, _, rest = content.partition(b"\r\n\r\n")
    fields = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    length = int(fields.get("content-length", -1))
    if not 0 <= length <= len(rest):
        return None
    http, _, payload = rest[:length].partition(b"\r\n\r\n")
    told = [line.partition(b":")[2] for line in http.split(b"\r\n") if line.lower().startswith(b"content-length:")]
    kind = fields.get("warc-type")
    return {
        "record_id": fields.get("warc-record-id"), "record_type": kind, "url": fields.get("warc-target-uri"),
        "refers_to": fields.get("warc-refers-to"), "digest": fields.get("warc-payload-digest"),
        "payload_bytes": int(told[0]) if told else None, "payload": payload if kind == "response" else None,
    }


RECORDS = pa.schema([
    ("path", pa.string()), ("offset", pa.int64()), ("record_id", pa.string()), ("record_type", pa.string()), ("url", pa.string()),
    ("refers_to", pa.string()), ("digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary()),
])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for r in b.to_pylist():
            rows, held = [], 0
            with opened(r["path"]) as file:
                for at, content in owned(file, r["length"], r["start"], r["end"]):
                    if (fields := parsed(content)) is not None:
                        rows.append({"path": r["path"], "offset": at} | fields)
                        held += len(content)
                    if held > 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, RECORDS)
                        rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, RECORDS)


def read_archive(spark: SparkSession, path: str, range_bytes: int = RANGE) -> DataFrame:
    """One row per record of the gzip members of all files below ``path``."""
    ready(spark)
    files = spark.read.format("binaryFile").load(path).where("length > 0").select("path", "length")
    start = F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(range_bytes).cast("long"))).alias("start")
    ranges = files.select("path", "length", start).withColumn("end", F.least(F.col("start") + range_bytes, "length"))
    # Listing gives few partitions; the ranges are dealt evenly.
    ranges = ranges.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    return ranges.mapInArrow(
        _read,
        "path string, offset long, record_id string, record_type string, url string, refers_to string, digest string, payload_bytes long, payload binary",
    )


def page_records(records: DataFrame) -> DataFrame:
    """Per page record: page_id, payload size and digest, type, and the page it refers to.

    Size and digest of a response are measured on the payload that was read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[dict] = []
            for r in b.to_pylist():
                response = r["record_type"] == "response"
                out.append({
                    "page_id": page_of(r["record_id"]),
                    "payload_bytes": len(r["payload"]) if response else r["payload_bytes"],
                    "payload_digest": digest32(hashlib.sha1(r["payload"]).digest()) if response else r["digest"].partition(":")[2],
                    "record_type": r["record_type"], "refers_to": None if response else page_of(r["refers_to"]),
                })
            yield pa.RecordBatch.from_pylist(out, schema)

    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
    return records.select("record_id", "record_type", "refers_to", "digest", "payload_bytes", "payload").mapInArrow(
        run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    )


def round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` as an archive in the shared folder and report what is read back."""
    stage = Stage(pages.sparkSession, "warc")
    write_archive(pages, stage.path("archive"))
    return page_records(read_archive(pages.sparkSession, stage.path("archive")))
