"""Removal of repeated byte strings by sorted suffixes.

A byte goes if a string of ``LEAST`` bytes that covers it also starts earlier: in a
document of smaller doc_id, or earlier in the same one.

Candidates. Every window of ``LEAST`` bytes picks the smallest hash of the 32-byte
strings inside it, its anchor; equal windows pick the same anchor. Neighbouring windows
with one anchor form a segment, about one for 35 bytes. Segments whose anchor string
occurs once in the corpus cannot repeat. Each task sends an anchor once and reports
further copies itself, so a frequent line is no hot group.

Sorting. Tasks sort the bytes of candidate segments into runs, keep the earliest of
equal ones and report the rest, and exchange the runs front-coded (common prefix with
the entry before, and the tail) by ranges. A range merges its runs with a loser tree
that keeps the common prefix with the last output: entries that differ in it need no
comparison, others are compared from there on, and an entry equal to the last output
shows by its prefix alone. All but the earliest of equal segments go as a whole. Where
segments differ but share 66 bytes on a side of their anchors, the match ends inside
them: the single windows on that side are told apart by 96 bits of hash, and all but the
earliest of equal ones go; they are dealt like the anchors. A text equal to that of a smaller doc_id goes
whole (if long enough) without being sorted.

Sizes: ranges and anchor parts grow in number with the candidates, runs are bounded.
Splitters come from a bounded sample of texts and only steer the balance.

Null text counts as empty. Rows that repeat a doc_id with the same text get the same
result. Rows without doc_id, and rows whose doc_id stands for different texts, match
nothing and stay as they are. An empty table gives an empty result. Other columns are
ignored, or kept by ``cut_repeats``.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stage, columns, ready, tidy

LEAST = 100
GRAM = 32
SPAN = LEAST - GRAM + 1  # anchors that a window chooses from
SIDE = (LEAST - GRAM) // 2  # equal windows share this many bytes before or after their anchor's string
RUN_BYTES = 24 << 20
PART_SEGMENTS = 1 << 19
PART_STRINGS = 1 << 17
SAMPLE = 2000

_BYTES = np.random.default_rng(11).integers(2**63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)


class Powers:
    """Powers of the hash base and of its inverse, as far as a text needs them."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def need(self, n: int) -> None:
        if n > len(self.up):
            n = max(n, 2 * len(self.up))
            ones = np.ones(1, np.uint64)
            self.up, self.down = (np.cumprod(np.concatenate([ones, np.full(n, b, np.uint64)])) for b in (_BASE, _INVERSE))


POWERS = Powers()


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def segments(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first window, last window, anchor, hash of the anchor's string) of every segment."""
    n = len(text)
    if n < LEAST:
        none = np.empty(0, np.int64)
        return none, none, none, none.astype(np.uint64)
    POWERS.need(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTES[np.frombuffer(text, np.uint8)] * POWERS.up[:n], out=total[1:])
    grams = mixed((total[GRAM:] - total[:-GRAM]) * POWERS.down[: n - GRAM + 1])
    # The place below the hash: the smallest value tells the leftmost smallest place.
    low = (grams >> np.uint64(32) << np.uint64(32)) | np.arange(len(grams), dtype=np.uint64)
    width = 1
    while 2 * width <= SPAN:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    rest = SPAN - width
    if rest:
        low = np.minimum(low[:-rest], low[rest:])
    anchor = (low & np.uint64(2**32 - 1)).astype(np.int64)
    cuts = np.flatnonzero(np.diff(anchor)) + 1
    first = np.concatenate([[0], cuts])
    last = np.concatenate([cuts, [len(anchor)]]) - 1
    return first, last, anchor[first], grams[anchor[first]]


def packed(*arrays: np.ndarray) -> bytes:
    return zlib.compress(b"".join([len(arrays[0]).to_bytes(4, "little"), *(a.tobytes() for a in arrays)]), 1)


def unpacked(blob: bytes, *kinds: str) -> tuple[list[np.ndarray], bytes]:
    data = zlib.decompress(blob)
    n, at, out = int.from_bytes(data[:4], "little"), 4, []
    for kind in kinds:
        out.append(np.frombuffer(data, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return out, data[at:]


BLOBS = "part long, kind int, run long, blob binary"
_BLOBS = pa.schema([("part", pa.int64()), ("kind", pa.int32()), ("run", pa.int64()), ("blob", pa.binary())])


def run_number(counter: int) -> int:
    return (TaskContext.get().partitionId() << 24) | counter


def dealt(parts: int, keys: np.ndarray, docs: np.ndarray, at: np.ndarray, counter: int, settle: bool) -> pa.RecordBatch:
    """Blobs of a task's keys, sorted: kind 0 one place of each key, to the key's part; kind 1 the other places.

    ``keys`` has a second column that only tells keys of one hash apart. The place sent
    is the earliest. To ``settle`` is to need no more of the others than that there is
    an earlier one; else the place sent says whether it has others, which makes it
    repeated whatever its part finds.
    """
    order = np.lexsort((at, docs, keys[:, 1], keys[:, 0]))
    keys, docs, at = keys[order], docs[order], at[order]
    first = np.concatenate([[True], (keys[1:] != keys[:-1]).any(1)])
    often = np.append(~first[1:], False)[first] & (not settle)
    one = np.flatnonzero(first)
    owner = (keys[one, 0] % np.uint64(parts)).astype(np.int64)
    deal = np.argsort(owner, kind="stable")
    one, often, owner = one[deal], often[deal], owner[deal]
    rows = []
    for p, (a, b) in slices(owner):
        i = one[a:b]
        rows.append({"part": p, "kind": 0, "run": run_number(counter), "blob": packed(keys[i, 0], keys[i, 1].astype("<u4"), docs[i], at[i], often[a:b])})
    same = np.zeros(len(at), bool)
    same[1:] = ~first[1:] & (docs[1:] == docs[:-1]) & (at[1:] == at[:-1])  # a row that is repeated as it is
    more = np.flatnonzero(~first & ~same)
    for i in range(0, len(more), PART_SEGMENTS):
        some = more[i : i + PART_SEGMENTS]
        rows.append({"part": (run_number(counter) + i) % parts, "kind": 1, "run": run_number(counter), "blob": packed(docs[some], at[some])})
    return pa.RecordBatch.from_pylist(rows, _BLOBS)


def _dealt(parts: int, settle: bool, places: Callable[[pa.RecordBatch], Iterator[tuple[np.ndarray, int, np.ndarray]]]):
    """Keys of all places of the batches, dealt in runs of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = counter = 0
        for b in batches:
            for keys, doc, at in places(b):
                held.append((keys, np.full(len(keys), doc), at.astype("<i4")))
                size += len(keys)
            if size > 2 * PART_SEGMENTS:
                yield dealt(parts, *map(np.concatenate, zip(*held, strict=True)), counter, settle)
                held, size, counter = [], 0, counter + 1
        if size:
            yield dealt(parts, *map(np.concatenate, zip(*held, strict=True)), counter, settle)

    return run


def anchor_places(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
    for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
        keys = segments(text.encode("utf-8", "surrogatepass"))[3]
        yield np.column_stack([keys, np.zeros_like(keys)]), doc, np.arange(len(keys))


def window_places(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
    """Windows on the shared sides of a segment: after its anchor those that reach ``SIDE`` bytes before it at most."""
    for doc, start, off, string, behind, before in zip(*(b.column(n).to_pylist() for n in ("doc", "start", "anchor", "string", "after", "ahead")), strict=True):
        low = 0 if before else max(0, off - SIDE)
        high = len(string) - LEAST + 1 if behind else min(len(string) - LEAST, off - SIDE) + 1
        hashes = [xxhash.xxh3_128_intdigest(string[j : j + LEAST]) for j in range(low, high)]
        keys = np.array([(h >> 64, h & 0xFFFFFFFF) for h in hashes], np.uint64).reshape(-1, 2)
        yield keys, doc, np.arange(start + low, start + low + len(keys))


def slices(sorted_: np.ndarray) -> Iterator[tuple[int, tuple[int, int]]]:
    """Runs of equal values: (value, (from, to))."""
    cuts = [0, *(np.flatnonzero(np.diff(sorted_)) + 1).tolist(), len(sorted_)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield int(sorted_[a]), (a, b)


def by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[dict]]]:
    """The rows of each part, which come one part after the other."""
    held: list[dict] = []
    for b in batches:
        for r in b.to_pylist():
            if held and held[0]["part"] != r["part"]:
                yield held[0]["part"], held
                held = []
            held.append(r)
    if held:
        yield held[0]["part"], held


def _repeated(settle: bool):
    """Places of keys that occur again; to ``settle``, of those that occur earlier."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in by_part(batches):
            docs, at = [], []
            once = [unpacked(r["blob"], "<u8", "<u4", "<i8", "<i4", "?")[0] for r in rows if r["kind"] == 0]
            for r in rows:
                if r["kind"] == 1:
                    d, a = unpacked(r["blob"], "<i8", "<i4")[0]
                    docs.append(d)
                    at.append(a)
            if once:
                keys, check, d, a, often = map(np.concatenate, zip(*once, strict=True))
                order = np.lexsort((a, d, check, keys))
                keys, check, d, a, often = keys[order], check[order], d[order], a[order], often[order]
                same = (keys[1:] == keys[:-1]) & (check[1:] == check[:-1])
                if settle:
                    keep = np.append(False, same)
                    # The earliest place may have come from two tasks, as a row that is repeated as it is.
                    first = np.maximum.accumulate(np.where(keep, 0, np.arange(len(keep))))
                    keep &= (d != d[first]) | (a != a[first])
                else:
                    keep = often | np.append(same, False) | np.append(False, same)
                docs.append(d[keep])
                at.append(a[keep])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(docs), pa.int64()), pa.array(np.concatenate(at), pa.int32())], ["doc", "at"])

    return run


Entry = tuple[bytes, int, int, int]  # string, doc, start, offset of the anchor


def front_coded(strings: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
    """Common prefix of each string with the one before, and the tails."""
    n, width = len(strings), max(map(len, strings))
    sizes = np.fromiter(map(len, strings), np.int64, n)
    table = np.frombuffer(b"".join(s.ljust(width, b"\0") for s in strings), np.uint8).reshape(n, width)
    shared = np.zeros(n, np.uint8)
    for i in range(1, n, 1 << 16):
        j = min(n, i + (1 << 16))
        differ = table[i:j] != table[i - 1 : j - 1]
        at = np.where(differ.any(1), differ.argmax(1), width)
        shared[i:j] = np.minimum(at, np.minimum(sizes[i:j], sizes[i - 1 : j - 1]))
    return shared, [s[k:] for s, k in zip(strings, shared.tolist(), strict=True)]


def sorted_run(entries: list[Entry], splitters: list[bytes], number: int) -> list[dict]:
    """Blobs of a run: kind 0 its distinct strings, dealt to ranges; kind 1 the places of later copies."""
    entries.sort()
    kept: list[Entry] = []
    gone: list[tuple[int, int, int]] = []
    for e in entries:
        if kept and kept[-1][0] == e[0]:
            if kept[-1][1:3] != e[1:3]:
                gone.append((e[1], e[2], len(e[0])))
        else:
            kept.append(e)
    strings = [e[0] for e in kept]
    cuts = [0, *(bisect_left(strings, s) for s in splitters), len(strings)]
    rows = []
    for part, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        if b > a:
            shared, tails = front_coded(strings[a:b])
            doc, start, off = (np.array([e[k] for e in kept[a:b]], t) for k, t in ((1, "<i8"), (2, "<i8"), (3, "u1")))
            sizes = np.fromiter(map(len, tails), np.uint8, b - a)
            body = b"".join([(b - a).to_bytes(4, "little"), *(x.tobytes() for x in (shared, sizes, doc, start, off)), *tails])
            rows.append({"part": part, "kind": 0, "run": number, "blob": zlib.compress(body, 1)})
    if gone:
        rows.append({"part": number % (len(splitters) + 1), "kind": 1, "run": number, "blob": packed(*(np.array(x, "<i8") for x in zip(*gone, strict=True)))})
    return rows


def decoded(blob: bytes) -> Iterator[tuple[int, Entry]]:
    """(common prefix with the entry before, entry) of a front-coded run."""
    (shared, sizes, doc, start, off), tails = unpacked(blob, "u1", "u1", "<i8", "<i8", "u1")
    last, at = b"", 0
    for k, n, d, s, o in zip(shared.tolist(), sizes.tolist(), doc.tolist(), start.tolist(), off.tolist(), strict=True):
        last = last[:k] + tails[at : at + n]
        at += n
        yield k, (last, d, s, o)


def common(a: bytes, b: bytes, low: int) -> int:
    """Size of the common prefix, known to be at least ``low``: compared from there on, by halves."""
    high = min(len(a), len(b))
    if a[low:high] == b[low:high]:
        return high
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


def merged(runs: list[Iterator[tuple[int, Entry]]]) -> Iterator[tuple[int, Entry]]:
    """All entries in order, each with its common prefix with the one put out before.

    A loser tree: a node holds the loser of its match and the loser's common prefix with
    what beat it. The longer prefix with the last output wins without a look at the
    strings; equal prefixes are compared behind them.
    """
    leaves = 1
    while leaves < len(runs):
        leaves *= 2
    entry: list[Entry | None] = [None] * leaves
    prefix = [-1] * leaves  # of a leaf's entry with the last output; -1: the run has ended

    def advance(r: int) -> None:
        found = next(runs[r], None) if r < len(runs) else None
        prefix[r], entry[r] = (-1, None) if found is None else found

    def match(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser's prefix becomes the one with the winner."""
        if prefix[a] != prefix[b]:
            return (a, b) if prefix[a] > prefix[b] else (b, a)
        if prefix[a] < 0:
            return a, b
        x, y = entry[a][0], entry[b][0]
        k = common(x, y, prefix[a])
        winner, loser = (a, b) if x[k : k + 1] <= y[k : k + 1] else (b, a)
        prefix[loser] = k
        return winner, loser

    losers = [0] * leaves
    level = list(range(leaves))
    for r in range(leaves):
        advance(r)
    node = leaves
    while len(level) > 1:
        node //= 2
        after = []
        for i in range(0, len(level), 2):
            w, losers[node + i // 2] = match(level[i], level[i + 1])
            after.append(w)
        level = after
    winner = level[0]
    while entry[winner] is not None:
        yield prefix[winner], entry[winner]
        advance(winner)
        at = (winner + leaves) // 2
        while at:
            winner, losers[at] = match(winner, losers[at])
            at //= 2


FOUND = "kind int, doc long, start long, size int, anchor int, behind long, before long, string binary"
_FOUND = pa.schema([("kind", pa.int32()), ("doc", pa.int64()), ("start", pa.int64()), ("size", pa.int32()), ("anchor", pa.int32()),
                    ("behind", pa.int64()), ("before", pa.int64()), ("string", pa.binary())])


def _merge(with_classes: bool):
    """kind 1: a string that also starts earlier. kind 0: the earliest of a class, with hashes around its anchor."""

    def signed(data: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(data)
        return value - 2**64 if value >> 63 else value

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in by_part(batches):
            out: list[tuple] = []

            def close(members: list[Entry]) -> None:
                first = min(members, key=lambda e: e[1:3]) if len(members) > 1 else members[0]
                for e in members:
                    if e[1:3] != first[1:3]:
                        out.append((1, e[1], e[2], len(e[0]), None, None, None, None))
                if with_classes:
                    s, doc, start, off = first
                    behind = signed(s[off : off + GRAM + SIDE]) if len(s) >= off + GRAM + SIDE else None
                    before = signed(s[off - SIDE : off + GRAM]) if off >= SIDE else None
                    out.append((0, doc, start, len(s), off, behind, before, s))

            for r in rows:
                if r["kind"] == 1:
                    out += [(1, d, s, n, None, None, None, None) for d, s, n in zip(*(x.tolist() for x in unpacked(r["blob"], "<i8", "<i8", "<i8")[0]), strict=True)]
            runs = [decoded(r["blob"]) for r in rows if r["kind"] == 0]
            members: list[Entry] = []
            for k, e in merged(runs):
                if members and k == len(e[0]) == len(members[0][0]):
                    members.append(e)
                    continue
                if members:
                    close(members)
                members = [e]
                if len(out) > 20_000:
                    yield rows_of(out)
                    out.clear()
            if members:
                close(members)
            if out:
                yield rows_of(out)

    return run


def rows_of(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _FOUND, strict=True)], schema=_FOUND)


def _runs(splitters: list[bytes], strings: Callable[[pa.RecordBatch], Iterator[list[Entry]]]):
    """Sorted front-coded runs of the strings of each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Entry] = []
        size = counter = 0
        for b in batches:
            for some in strings(b):
                held += some
                size += sum(len(e[0]) for e in some)
                if size > RUN_BYTES:
                    yield pa.RecordBatch.from_pylist(sorted_run(held, splitters, run_number(counter)), _BLOBS)
                    held, size, counter = [], 0, counter + 1
        if held:
            yield pa.RecordBatch.from_pylist(sorted_run(held, splitters, run_number(counter)), _BLOBS)

    return run


def segment_strings(b: pa.RecordBatch) -> Iterator[list[Entry]]:
    for doc, text, at in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), b.column("at").to_pylist(), strict=True):
        data = text.encode("utf-8", "surrogatepass")
        first, last, anchor, _ = segments(data)
        at = np.array(at, np.int64)
        yield [(data[a : z + LEAST], doc, a, p - a) for a, z, p in zip(first[at].tolist(), last[at].tolist(), anchor[at].tolist(), strict=True)]


class Repeats:
    """One run; keeps its tables in the shared folder."""

    def __init__(self, docs: DataFrame):
        self.spark = ready(docs.sparkSession)
        self.stage = Stage(self.spark, "repeats")
        self.tasks = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.docs = columns(docs, ("doc_id", "text")).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
        known = self.docs.where("doc_id IS NOT NULL").select("doc_id", F.sha2("text", 256).alias("digest"), F.octet_length("text").alias("size"))
        known = self.stage.store(known, "known")
        several = known.groupBy("doc_id").agg(F.min("digest").alias("low"), F.max("digest").alias("high")).where("low < high").select("doc_id")
        first = known.join(several, "doc_id", "left_anti").groupBy("digest").agg(F.min("doc_id").alias("first"))
        copies = known.join(several, "doc_id", "left_anti").join(first, "digest").where("doc_id > first").select("doc_id", "size").distinct()
        self.copies = self.stage.store(copies, "copies")
        self.left_out = several.union(copies.select("doc_id"))

    def splitters(self, parts: int) -> list[bytes]:
        """Cuts between ranges, from windows of a bounded sample of texts; they only steer the balance."""
        # A place of each sampled text by its hash; the sample has a fixed size.
        luck = F.xxhash64("doc_id")
        place = (F.pmod(luck, F.greatest(F.lit(1), F.length("text") - 40)) + 1).cast("int")
        found = self.docs.where(f"octet_length(text) >= {LEAST}").select(F.substring("text", place, F.lit(24)).alias("piece"), luck.alias("luck"))
        sample = sorted(r.piece.encode() for r in found.orderBy("luck", "piece").limit(SAMPLE).collect())
        return sorted({sample[len(sample) * i // parts] for i in range(1, parts)}) if sample else []

    def repeated(self, places: DataFrame, parts: int, settle: bool, of: Callable) -> DataFrame:
        sent = places.mapInArrow(tidy(_dealt(parts, settle, of)), BLOBS).repartition(self.tasks, "part").sortWithinPartitions("part")
        return sent.mapInArrow(tidy(_repeated(settle)), "doc long, at int")

    def sort(self, runs: DataFrame, with_classes: bool, name: str) -> DataFrame:
        dealt = runs.repartition(self.tasks, "part").sortWithinPartitions("part")
        return self.stage.store(dealt.mapInArrow(tidy(_merge(with_classes)), FOUND), name)

    def spans(self) -> DataFrame:
        """(doc, start, size) of strings that also start earlier; whole copies are not among them."""
        texts = self.docs.where(f"doc_id IS NOT NULL AND octet_length(text) >= {LEAST}")
        total = self.stage.spark.read.parquet(self.stage.path("known")).agg(F.sum("size")).first()[0] or 0
        parts = max(self.tasks, total // (SPAN // 2 * PART_SEGMENTS) + 1)
        anchors = self.repeated(texts, parts, False, anchor_places)
        candidates = self.stage.store(anchors.join(self.left_out.withColumnRenamed("doc_id", "doc"), "doc", "left_anti").distinct(), "candidates")
        self.stage.release()

        splitters = self.splitters(max(self.tasks, candidates.count() // PART_STRINGS + 1))
        wanted = candidates.groupBy("doc").agg(F.collect_list("at").alias("at"))
        found = self.sort(texts.join(wanted, F.col("doc_id") == F.col("doc")).select("doc_id", "text", "at").mapInArrow(tidy(_runs(splitters, segment_strings)), BLOBS), True, "segments")
        self.stage.release()

        classes = found.where("kind = 0")
        around = classes.select(F.explode(F.array("behind", "before")).alias("key")).where("key IS NOT NULL").groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
        side = F.posexplode(F.array("behind", "before")).alias("side", "key")
        near = classes.select("doc", "start", side).join(around, "key").groupBy("doc", "start").agg((F.min("side") == 0).alias("after"), (F.max("side") == 1).alias("ahead"))
        loose = self.stage.store(classes.join(near, ["doc", "start"]).select("doc", "start", "anchor", "string", "after", "ahead"), "loose")
        self.stage.release()
        windows = loose.agg(F.sum(F.octet_length("string") - LEAST + 1)).first()[0] or 0
        single = self.repeated(loose, max(self.tasks, windows // PART_SEGMENTS + 1), True, window_places)
        # Neighbouring windows come from many parts; they are merged per document below.
        single = self.stage.store(single.select("doc", F.col("at").cast("long").alias("start"), F.lit(LEAST).alias("size")), "single")
        self.stage.drop("loose")
        self.stage.release()
        return found.where("kind = 1").select("doc", "start", "size").union(single)

    def cuts(self) -> DataFrame:
        """(doc, cuts): the merged spans of every document that loses bytes, in order."""
        merged_spans = """aggregate(array_sort(collect_list(struct(start, start + size AS end))),
          cast(array() AS array<struct<start:bigint,end:bigint>>),
          (s, x) -> CASE WHEN size(s) > 0 AND element_at(s, -1).end >= x.start
            THEN concat(slice(s, 1, size(s) - 1), array(named_struct('start', element_at(s, -1).start, 'end', greatest(element_at(s, -1).end, x.end))))
            ELSE concat(s, array(named_struct('start', x.start, 'end', x.end))) END)"""
        partial = self.spans().groupBy("doc").agg(F.expr(merged_spans).alias("cuts"))
        whole = self.copies.where(f"size >= {LEAST}").select(F.col("doc_id").alias("doc"), F.expr("array(named_struct('start', 0L, 'end', cast(size AS bigint)))").alias("cuts"))
        return self.stage.store(partial.union(whole), "cuts")


def _kept(data: bytes, cuts: list[dict] | None) -> bytes:
    if cuts is None or not len(cuts):
        return data
    parts, at = [], 0
    for c in cuts:
        parts.append(data[at : c["start"]])
        at = c["end"]
    return b"".join([*parts, data[at:]])


def repeat_report(docs: DataFrame) -> DataFrame:
    """Per row: bytes, removed bytes, maximal removed runs, and the digest of what stays."""
    run = Repeats(docs)

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc, text, cuts in zip(*(b.column(n).to_pylist() for n in ("doc_id", "text", "cuts")), strict=True):
                data = text.encode("utf-8", "surrogatepass")
                kept = _kept(data, cuts)
                out.append({"doc_id": doc, "n_bytes": len(data), "n_removed": len(data) - len(kept), "n_spans": len(cuts or ()), "kept_sha256": hashlib.sha256(kept).hexdigest()})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]))

    joined = run.docs.join(run.cuts(), F.col("doc_id") == F.col("doc"), "left").select("doc_id", "text", "cuts")
    return joined.mapInArrow(report, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def cut_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` without the repeated bytes; bytes of a character that is cut in part go with it.

    Rows and other columns stay, ``n_chars`` (where there is one) follows the text, and
    a null text stays null.
    """
    run = Repeats(docs)
    cuts = run.cuts()

    @F.pandas_udf("string")
    def shortened(texts, spans):  # noqa: ANN001, ANN202
        return texts.combine(spans, lambda t, c: t if t is None or c is None else _kept(t.encode("utf-8", "surrogatepass"), c).decode("utf-8", "ignore"))

    names = docs.columns
    joined = docs.select(F.struct(*[F.col(f"`{n}`") for n in names]).alias("row"), F.col("doc_id").cast("long").alias("doc_key"))
    joined = joined.join(cuts.withColumnRenamed("doc", "cut_key"), F.col("doc_key") == F.col("cut_key"), "left")
    text = F.when(F.col("cuts").isNull(), F.col("row.text")).otherwise(shortened("row.text", "cuts"))
    out = joined.select("row", text.alias("shorter")).select("row.*", "shorter")
    replaced = {"text": F.col("shorter")} | ({"n_chars": F.length("shorter").cast(dict(docs.dtypes)["n_chars"])} if "n_chars" in names else {})
    return out.select(*[replaced.get(n, F.col(f"`{n}`")).alias(n) for n in names])
