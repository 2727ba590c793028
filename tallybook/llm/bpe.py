"""Byte-level BPE: encoding in overlapping chunks, and decoding.

A text of up to ``CHUNK`` characters is encoded on its row. A longer one is cut into
chunks that overlap by ``OVERLAP`` characters; tasks split chunks into pre-tokens in
parallel. A match of the pattern depends only on the text from its start, so where two
neighbouring chunks both start a pre-token in their overlap, all later boundaries agree:
there they are stitched, and each chunk encodes the pieces between its two seams. A text
with a seam that never resynchronises (for example white space longer than an overlap)
is encoded whole. Decoding concatenates the bytes of the ids.

Ids of frequent pre-tokens are kept in a bounded memory of each worker; rare ones are
merged by the tokenizer library. Null text counts as empty: no ids, no bytes. Repeated
rows give repeated results, an empty table an empty one; null ids of documents are
kept. Other columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import columns, ready

# A task splits a chunk in some 20 ms; below that, dealing it out costs more than it saves.
CHUNK = 65_536
OVERLAP = 1024
MEMORY = 200_000  # pre-tokens kept by a worker
LONGEST = 64  # characters of a pre-token worth keeping


class Ids(dict):
    """Little-endian 32-bit ids of a pre-token, merged on first use."""

    def __init__(self, encoding: tiktoken.Encoding):
        self.encoding = encoding

    def __missing__(self, piece: str) -> bytes:
        ids = np.array(self.encoding.encode_ordinary(piece), "<u4").tobytes()
        if len(piece) <= LONGEST:
            if len(self) >= MEMORY:
                self.clear()
            self[piece] = ids
        return ids


class Coder:
    def __init__(self, ranks: str, pattern: str):
        with open(ranks, "rb") as lines:
            table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines)}
        self.pattern = regex.compile(pattern)
        self.ids = Ids(tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={}))
        self.pieces = [b""] * (max(table.values(), default=-1) + 1)
        for piece, rank in table.items():
            self.pieces[rank] = piece

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.ids.__getitem__, self.pattern.findall(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.pieces.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def starts(self, text: str, low: int, high: int) -> list[int]:
        """Places in ``low <= place < high`` where a pre-token starts, from a scan that begins at 0."""
        found = []
        for m in self.pattern.finditer(text):
            if m.start() >= high:
                break
            if m.start() >= low:
                found.append(m.start())
        return found


@lru_cache(2)
def coder(ranks: str, pattern: str) -> Coder:
    """One per worker process, made from the vocabulary file every machine has."""
    return Coder(ranks, pattern)


def _encoder(ranks: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(ranks, pattern)
        for b in batches:
            ids = pa.array([c.encode(t or "") for t in b.column("text").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in b.schema.names if n != "text"], ids], [n for n in b.schema.names if n != "text"] + ["ids"])

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for doc, digest, text in zip(b.column("doc_id").to_pylist(), b.column("digest").to_pylist(), b.column("text").to_pylist(), strict=True):
            n = -(-len(text) // CHUNK)
            for k in range(0, n, 64):
                part = range(k, min(n, k + 64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([doc] * len(part), pa.int64()), pa.array([digest] * len(part), pa.string()), pa.array(list(part), pa.int32()),
                     pa.array([n] * len(part), pa.int32()), pa.array([text[i * CHUNK : (i + 1) * CHUNK + OVERLAP] for i in part], pa.string())],
                    ["doc_id", "digest", "k", "n", "text"],
                )


def _boundaries(ranks: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(ranks, pattern)
        places = pa.list_(pa.int32())
        for b in batches:
            head, tail = [], []
            for k, n, text in zip(b.column("k").to_pylist(), b.column("n").to_pylist(), b.column("text").to_pylist(), strict=True):
                head.append(c.starts(text, 0, OVERLAP) if k else [])
                tail.append([p - CHUNK for p in c.starts(text, CHUNK, CHUNK + OVERLAP)] if k + 1 < n else [])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(head, places), pa.array(tail, places)], [*b.schema.names, "head", "tail"])

    return run


def _between(ranks: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(ranks, pattern)
        for b in batches:
            ids = []
            for low, high, text in zip(b.column("low").to_pylist(), b.column("high").to_pylist(), b.column("text").to_pylist(), strict=True):
                ids.append(c.encode(text[low:] if high is None else text[low : CHUNK + high]))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("digest"), b.column("k"), pa.array(ids, pa.binary())], ["doc_id", "digest", "k", "ids"])

    return run


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids = [b"".join(x["ids"] for x in sorted(parts, key=lambda x: x["k"])) for parts in b.column("parts").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("copies"), pa.array(ids, pa.binary())], ["doc_id", "copies", "ids"])


def encode(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """(doc_id, ids): the ids of every text as little-endian unsigned 32-bit integers."""
    ready(docs.sparkSession)
    rows = columns(docs, ("doc_id", "text")).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # The size in bytes is at hand without counting; it only decides who is cut.
    long = F.coalesce(F.octet_length("text"), F.lit(0)) > CHUNK
    short = rows.where(~long).mapInArrow(_encoder(ranks, pattern), "doc_id long, ids binary")

    marked = rows.where(long).withColumn("digest", F.sha2("text", 256))
    copies = marked.groupBy("doc_id", "digest").agg(F.count("*").alias("copies"))
    chunks = marked.mapInArrow(_cut, "doc_id long, digest string, k int, n int, text string")
    # Equal rows are cut alike; one of them is enough, and the count brings the others back.
    scanned = chunks.dropDuplicates(["doc_id", "digest", "k"]).mapInArrow(
        _boundaries(ranks, pattern), "doc_id long, digest string, k int, n int, text string, head array<int>, tail array<int>"
    )
    text = Window.partitionBy("doc_id", "digest")
    order = text.orderBy("k")
    seam = lambda a, b: F.array_min(F.array_intersect(a, b))
    seams = (
        scanned.withColumn("low", seam(F.lag("tail").over(order), F.col("head")))
        .withColumn("high", seam(F.col("tail"), F.lead("head").over(order)))
        .withColumn("synced", F.min((F.col("k") == 0) | F.col("low").isNotNull()).over(text))
        .select("doc_id", "digest", "k", F.when(F.col("k") == 0, 0).otherwise(F.col("low")).alias("low"), "high", "text", "synced")
    )
    pieces = seams.where("synced").drop("synced").mapInArrow(_between(ranks, pattern), "doc_id long, digest string, k int, ids binary")
    stitched = (
        pieces.groupBy("doc_id", "digest").agg(F.collect_list(F.struct("k", "ids")).alias("parts"))
        .join(copies.withColumnsRenamed({"doc_id": "d", "digest": "g"}), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("digest") == F.col("g")))
        .select("doc_id", "copies", "parts")
        .mapInArrow(_joined, "doc_id long, copies long, ids binary")
        .select("doc_id", F.explode(F.expr("sequence(1L, copies)")), "ids").select("doc_id", "ids")
    )
    loose = seams.where("NOT synced AND k = 0").select(F.col("doc_id").alias("d"), F.col("digest").alias("g"))
    whole = (
        marked.join(loose, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("digest") == F.col("g")), "left_semi")
        .select("doc_id", "text")
        .mapInArrow(_encoder(ranks, pattern), "doc_id long, ids binary")
    )
    return short.union(stitched).union(whole)


def decode(encoded: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """``encoded`` (doc_id, ids) with ``bytes``: what the ids stand for, concatenated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(ranks, pattern)
        for b in batches:
            out = pa.array([c.decode(ids or b"") for ids in b.column("ids").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("ids"), out], ["doc_id", "ids", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, bytes binary")


def bpe_report(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """Number of ids and digests of the ids and of the decoded bytes, per document."""
    return decode(encode(docs, ranks, pattern), ranks, pattern).select(
        "doc_id", F.expr("cast(octet_length(ids) / 4 AS bigint)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"),
    )
