"""Near-duplicate texts by HyperMinHash.

Sets. A text's set holds the 64-bit hashes of its distinct shingles of five words (a
shorter text: its whole word sequence). Texts with equal sets form a class, and only
the smallest doc_id of a class, its representative, is compared with others.

Sketch. Each of 128 buckets keeps the smallest hash that falls into it, stored as the
number of leading zeros and ten bits of mantissa. Bands of compressed registers give
the candidate groups, as wide as the threshold allows: at 0.85 bands of five, texts at
the threshold share no band with a chance of 4e-7; at 0.8 bands of four, 5e-8. Within a group the share of equal registers, corrected for the collisions
that the compression causes, estimates the Jaccard similarity; pairs more than five
standard errors below the threshold are not verified. All others are compared on
their full sets.

Many alike. A group of near copies is not taken apart into all its pairs: in two rounds,
blocks of bounded size propose only the edges of a spanning forest of best estimates, and
verified links join components. What is left to settle are candidate pairs between
different components. In groups of more than ``FEW`` members those are compared inside
the task on 32 bits of each hash, and only pairs that may be links come out; those are
all verified, so no link between components is missed. Hot groups are dealt in blocks
over tasks.

Null and empty texts have empty sets and link with nothing. Rows with a null doc_id link
with nothing. Repeated rows and equal texts share a class; rows that share a doc_id count
as one node. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stage, columns, components, ready, tidy

WORDS = 5
BUCKETS = 128
BAND = 5  # registers of a band at most
MISS = 1e-6  # chance that texts at the threshold share no band
MANTISSA = 10
BLOCK = 1024
ROUNDS = 2
ERRORS = 5.0
FEW = 32
SHORT = 4096  # hashes of a text that travel with it into a large group
SHARED = 1 << 16  # distinct hashes that a block compares at once; a sample of them beyond
MEMORY = 200_000  # words kept by a worker

_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
_SEEDS = np.random.default_rng(5).integers(2**63, size=BUCKETS, dtype=np.uint64)


def band_width(threshold: float) -> int:
    """Registers of a band: the most at which texts at the threshold hardly ever share none."""
    return next((w for w in range(BAND, 1, -1) if (1 - threshold**w) ** (BUCKETS // w) <= MISS), 1)


class Hashes(dict):
    """64-bit hashes of words; the memory of a worker is bounded by ``forget``."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def forget(self) -> None:
        if len(self) > MEMORY:
            self.clear()


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, known: Hashes) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles. Bytes lower-case and split at ASCII letters and blanks only."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    known.forget()
    h = np.fromiter(map(known.__getitem__, words), np.uint64, n)
    width = min(n, WORDS)
    total = np.full(n - width + 1, width, np.uint64)
    for k in range(width):
        total += h[k : n - width + 1 + k] * _FACTORS[k]
    return np.unique(mixed(total))


def registers(hashes: np.ndarray) -> np.ndarray:
    """Per bucket: 0 if empty, else 1 + leading zeros and mantissa of its smallest hash."""
    out = np.zeros(BUCKETS, np.uint16)
    bucket = (hashes >> np.uint64(57)).astype(np.int64)
    used, first = np.unique(bucket, return_index=True)  # sorted hashes: the first of a bucket is its smallest
    rest = hashes[first] & np.uint64(2**57 - 1)
    zeros = 57 - np.ceil(np.log2(rest.astype(np.float64) + 1)).astype(np.int64)
    zeros = np.minimum(zeros, 62)
    shift = 57 - zeros - MANTISSA - 1
    mantissa = np.where(shift >= 0, rest >> np.maximum(shift, 0).astype(np.uint64), rest << np.maximum(-shift, 0).astype(np.uint64)) & np.uint64(2**MANTISSA - 1)
    out[used] = (1 + (zeros.astype(np.int64) << MANTISSA) + mantissa.astype(np.int64)).astype(np.uint16)
    return out


@lru_cache(4096)
def collision(log_a: int, log_b: int) -> float:
    """Chance that registers of independent sets of 2**log_a and 2**log_b members in a bucket agree."""
    zeros = np.arange(40)[:, None]
    low = 2.0 ** -(zeros + 1) * (1 + np.arange(2**MANTISSA)[None, :] / 2**MANTISSA)
    high = low + 2.0 ** -(zeros + 1) / 2**MANTISSA
    inside = [(1 - low) ** 2.0**k - (1 - np.minimum(high, 1)) ** 2.0**k for k in (max(log_a, 0), max(log_b, 0))]
    return float((inside[0] * inside[1]).sum())


def estimates(a: np.ndarray, b: np.ndarray, sizes_a: np.ndarray, sizes_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Collision-corrected Jaccard estimates of all rows of ``a`` with all rows of ``b``, and the registers they rest on."""
    rate, seen = np.empty((len(a), len(b)), np.float32), np.empty((len(a), len(b)), np.float32)
    step = max(1, (1 << 22) // (BUCKETS * max(1, len(b))))
    for i in range(0, len(a), step):
        x = a[i : i + step, None, :]
        used = (x | b[None]) != 0
        seen[i : i + step] = used.sum(2)
        rate[i : i + step] = ((x == b[None]) & used).sum(2)
    rate /= np.maximum(seen, 1)
    logs = [np.round(np.log2(np.maximum(s, 1) / BUCKETS)).astype(int) for s in (sizes_a, sizes_b)]
    chance = np.array([[collision(x, y) for y in np.unique(logs[1])] for x in np.unique(logs[0])])
    chance = chance[np.searchsorted(np.unique(logs[0]), logs[0])][:, np.searchsorted(np.unique(logs[1]), logs[1])]
    return (rate - chance) / (1 - chance), seen


def possible(similarity: np.ndarray, seen: np.ndarray, threshold: float) -> np.ndarray:
    """Whether an estimate leaves a similarity of ``threshold`` possible."""
    return similarity >= threshold - ERRORS * np.sqrt(threshold * (1 - threshold) / np.maximum(seen, 1))


def overlaps(hashes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Jaccard similarities of all sets, and the size of the samples they rest on (infinite where exact).

    Hashes of one set alone only count towards its size; the others make a table of
    sets by hashes whose product with itself has the sizes of the intersections.
    """
    owner = np.repeat(np.arange(len(hashes)), [len(h) for h in hashes])
    values = np.concatenate(hashes)
    size = np.bincount(owner, minlength=len(hashes)).astype(np.float32)
    found, place, count = np.unique(values, return_inverse=True, return_counts=True)
    shared = int((count > 1).sum())
    exact = shared <= SHARED
    if not exact:
        bits = int(np.ceil(np.log2(shared / SHARED)))
        keep = (values & np.uint32(2**bits - 1)) == 0
        owner, values = owner[keep], values[keep]
        size = np.bincount(owner, minlength=len(hashes)).astype(np.float32)
        found, place, count = np.unique(values, return_inverse=True, return_counts=True)
    column = np.cumsum(count > 1) - 1
    twice = count[place] > 1
    owner, column = owner[twice], column[place][twice]
    common = np.zeros((len(hashes), len(hashes)), np.float32)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        a, b = np.searchsorted(column, (low, low + 4096))
        part = np.zeros((len(hashes), 4096), np.float32)
        part[owner[a:b], column[a:b] - low] = 1
        common += part @ part.T
    union = np.maximum(size[:, None] + size[None] - common, 1)
    return common / union, np.full_like(union, np.inf) if exact else union


def forest(similarity: np.ndarray, allowed: np.ndarray, component: np.ndarray) -> list[tuple[int, int]]:
    """Edges that join the components by their best allowed estimates (a maximum spanning forest)."""
    label = np.unique(component, return_inverse=True)[1]
    edges = []
    while True:
        open_ = np.where(allowed & (label[:, None] != label[None]), similarity, -1.0)
        best = open_.argmax(1)
        value = open_[np.arange(len(label)), best]
        order = np.lexsort((np.arange(len(label)), -value))
        changed, picked = False, set()
        for i in order:
            if value[i] < 0:
                break
            a, b = label[i], label[best[i]]
            if a in picked or a == b:
                continue
            picked.add(a)
            edges.append((int(i), int(best[i])))
            label[label == a] = b
            changed = True
        if not changed:
            return edges


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = Hashes()
    for b in batches:
        size, digest, regs = [], [], []
        for text in b.column("text").to_pylist():
            s = shingles(text, known)
            size.append(len(s))
            digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).hexdigest() if len(s) else None)
            regs.append(registers(s).tobytes() if len(s) else None)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(size, pa.int64()), pa.array(digest, pa.string()), pa.array(regs, pa.binary())],
                                         ["doc_id", "n_shingles", "digest", "registers"])


def _bands(width: int):
    n = BUCKETS // width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            regs = matrix(b.column("registers"))
            keys, used = np.empty((len(regs), n), np.int64), np.empty((len(regs), n), bool)
            for k in range(n):
                part = regs[:, k * width : (k + 1) * width].astype(np.uint64)
                keys[:, k] = mixed(part @ _FACTORS[:width] + _SEEDS[k]).view(np.int64)
                used[:, k] = part.any(1)
            ids = np.repeat(b.column("rep").to_numpy(zero_copy_only=False), n)[used.ravel()]
            yield pa.RecordBatch.from_arrays([pa.array(keys[used], pa.int64()), pa.array(ids, pa.int64())], ["band", "rep"])

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = Hashes()
    for b in batches:
        sets = pa.array([shingles(t, known).tobytes() for t in b.column("text").to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([b.column("rep"), sets], ["rep", "hashes"])


def _halved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """32 bits of every hash."""
    for b in batches:
        half = [np.unique(np.frombuffer(h, np.uint64).astype(np.uint32)).tobytes() for h in b.column("hashes").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("rep"), pa.array(half, pa.binary())], ["rep", "hashes"])


def matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), BUCKETS)


def _proposals(threshold: float, whole: bool):
    """Candidate pairs of each task's rows, which come ordered by (band, part).

    Not ``whole``: a spanning forest over the components of a group. ``whole``: every
    pair of different components; of a group in two halves, pairs across the halves.
    """

    def pairs(rows: dict[str, np.ndarray]) -> np.ndarray:
        regs, reps, comp, size, side = (rows[k] for k in ("registers", "rep", "component", "n_shingles", "side"))
        if len(np.unique(comp)) < 2:
            return np.empty((0, 2), np.int64)
        if not whole:
            estimate, seen = estimates(regs, regs, size, size)
            found = forest(estimate, possible(estimate, seen, threshold), comp)
            return np.array([(reps[i], reps[j]) for i, j in found], np.int64).reshape(-1, 2)
        left = np.flatnonzero(side == 0)
        right = np.flatnonzero(side != 0) if (side != 0).any() else left
        estimate, seen = estimates(regs[left], regs[right], size[left], size[right])
        likely = possible(estimate, seen, threshold) & (comp[left][:, None] != comp[right][None])
        told = np.array([h is not None for h in rows["hashes"]])
        if told.any() and likely.any():
            known = np.flatnonzero(told)
            exact, seen = overlaps([np.frombuffer(h, np.uint32) for h in rows["hashes"][known]])
            at = np.cumsum(told) - 1
            both = told[left][:, None] & told[right][None]
            # Hashes of 32 bits may agree by chance, which only raises a similarity.
            sure = possible(exact, seen, threshold - 1e-4)[np.ix_(at[left], at[right])]
            likely &= ~both | sure
        i, j = np.nonzero(likely)
        return np.column_stack([reps[left][i], reps[right][j]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[str, np.ndarray]] = []
        key = None

        def flush() -> np.ndarray:
            rows = {k: np.concatenate([h[k] for h in held]) for k in held[0]}
            return pairs(rows)

        for b in batches:
            cols = {k: b.column(k).to_numpy(zero_copy_only=False) for k in ("rep", "component", "n_shingles", "side")}
            cols["registers"] = matrix(b.column("registers"))
            cols["hashes"] = np.array([*b.column("hashes").to_pylist(), None], object)[:-1]
            band, part = b.column("band").to_numpy(), b.column("part").to_numpy()
            cuts = np.flatnonzero((np.diff(band) != 0) | (np.diff(part) != 0)) + 1
            out = []
            for low, high in zip([0, *cuts], [*cuts, len(band)], strict=True):
                if high == low:
                    continue
                if held and key != (band[low], part[low]):
                    out.append(flush())
                    held.clear()
                key = (band[low], part[low])
                held.append({k: v[low:high] for k, v in cols.items()})
            if out:
                yield batch(np.concatenate(out))
        if held:
            yield batch(flush())

    def batch(found: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(found.min(1), pa.int64()), pa.array(found.max(1), pa.int64())], ["a", "b"])

    return run


def _verified(numerator: int, denominator: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column("hashes_a").to_pylist(), b.column("hashes_b").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                if denominator * min(len(x), len(y)) < numerator * max(len(x), len(y)):
                    keep.append(False)
                    continue
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(denominator * common >= numerator * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(keep, pa.bool_())], ["a", "b", "linked"])

    return run


class Grouping:
    """One run over a table of texts; keeps its tables in the shared folder."""

    def __init__(self, docs: DataFrame, numerator: int, denominator: int):
        self.spark = ready(docs.sparkSession)
        self.stage = Stage(self.spark, "neartext")
        self.numerator, self.denominator = numerator, denominator
        self.threshold = numerator / denominator
        self.docs = columns(docs, ("doc_id", "text")).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        self.rows = self.stage.store(
            self.docs.mapInArrow(tidy(_sketch), "doc_id long, n_shingles long, digest string, registers binary"), "sketches"
        )
        self.classes = self.stage.store(self.rows.where("digest IS NOT NULL AND doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("rep")), "classes")
        self.reps = self.stage.store(
            self.rows.join(self.classes, "digest").where("doc_id = rep").dropDuplicates(["rep", "digest"]).select("rep", "n_shingles", "registers"), "reps"
        )

    def groups(self) -> DataFrame:
        """(band, rep) of the bands that more than one representative has."""
        bands = self.reps.mapInArrow(tidy(_bands(band_width(self.threshold))), "band long, rep long")
        often = bands.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
        found = self.stage.store(bands.join(often.select("band"), "band"), "groups")
        self.stage.release()
        return found

    def members(self, groups: DataFrame, label: DataFrame | None) -> DataFrame:
        """Group members with component, size and registers, of the groups that span components."""
        rows = groups.join(self.reps, "rep")
        if label is None:
            return rows.withColumn("component", F.col("rep"))
        rows = rows.join(label.withColumnRenamed("id", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
        mixed_groups = (
            rows.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("band")
        )
        return rows.join(mixed_groups, "band")

    def blocks(self, members: DataFrame) -> DataFrame:
        """Members dealt into blocks of about ``BLOCK``, as (band, part)."""
        size = members.groupBy("band").agg(F.count("*").alias("n")).where(f"n > {BLOCK}")
        return members.join(size, "band", "left").select(
            "band", F.expr(f"cast(pmod(xxhash64(rep), ceil(coalesce(n, 1) / {BLOCK})) AS bigint)").alias("part"), "rep", "component", "n_shingles", F.lit(0).alias("side"), "registers",
            F.lit(None).cast("binary").alias("hashes"),
        )

    def halves(self, members: DataFrame) -> DataFrame:
        """Members dealt so that any two of different components meet in some (band, part).

        A small group is one part. In a large one, blocks of the members outside its
        largest component meet each other and the blocks of that component, whose own
        members need not meet.
        """
        many = members.groupBy("band").agg(F.count("*").alias("n")).where(f"n > {FEW}").select("band")
        short = self.sets.where(f"octet_length(hashes) <= {8 * SHORT}").mapInArrow(tidy(_halved), "rep long, hashes binary")
        told = members.select("band", "rep").join(many, "band").join(short, "rep")
        members = members.join(told, ["band", "rep"], "left")
        by_component = members.groupBy("band", "component").agg(F.count("*").alias("n"))
        size = by_component.groupBy("band").agg(F.sum("n").alias("n"), F.max(F.struct("n", "component")).alias("top")).where(f"n > {BLOCK}")
        size = size.select("band", F.col("top.component").alias("major"), F.expr(f"ceil(top.n / {BLOCK})").alias("of_major"), F.expr(f"ceil((n - top.n) / {BLOCK})").alias("of_others"))
        rows = members.join(size, "band", "left")
        small = rows.where("major IS NULL").select("band", F.lit(0).cast("long").alias("part"), "rep", "component", "n_shingles", F.lit(0).alias("side"), "registers", "hashes")
        # Parts are numbered by (block of others, 0 or 1 + the block it meets); the side tells the two apart.
        large = rows.where("major IS NOT NULL").selectExpr(
            "band", "rep", "component", "n_shingles", "registers", "hashes", "of_major", "of_others", "component = major AS major",
            "pmod(xxhash64(rep), CASE WHEN component = major THEN of_major ELSE of_others END) AS block",
        )
        met = large.selectExpr(
            "band", "rep", "component", "n_shingles", "registers", "hashes",
            """explode(CASE WHEN major THEN transform(sequence(0L, of_others - 1), o -> named_struct('part', o * (of_major + of_others) + block, 'side', 1))
            ELSE concat(
              transform(sequence(0L, of_major - 1), m -> named_struct('part', block * (of_major + of_others) + m, 'side', 0)),
              transform(sequence(block, of_others - 1), o -> named_struct('part', block * (of_major + of_others) + of_major + o, 'side', 0)),
              transform(filter(sequence(0L, of_others - 1), o -> o < block), o -> named_struct('part', o * (of_major + of_others) + of_major + block, 'side', 1)))
            END) AS at""",
        )
        return small.union(met.select("band", "at.part", "rep", "component", "n_shingles", "at.side", "registers", "hashes"))

    def proposed(self, dealt: DataFrame, whole: bool) -> DataFrame:
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        sorted_ = dealt.repartition(n, "band", "part").sortWithinPartitions("band", "part")
        return sorted_.mapInArrow(tidy(_proposals(self.threshold, whole)), "a long, b long").where("a < b").distinct()

    def verify(self, pairs: DataFrame) -> DataFrame:
        sets = self.sets
        both = pairs.join(sets.select(F.col("rep").alias("a"), F.col("hashes").alias("hashes_a")), "a").join(
            sets.select(F.col("rep").alias("b"), F.col("hashes").alias("hashes_b")), "b"
        )
        return both.mapInArrow(tidy(_verified(self.numerator, self.denominator)), "a long, b long, linked boolean")

    def links(self) -> DataFrame:
        """Verified links (a, b) that connect representatives as all links would."""
        groups = self.groups()
        wanted = groups.select("rep").distinct()
        texts = self.docs.join(wanted, F.col("doc_id") == F.col("rep")).select("rep", "text")
        self.sets = self.stage.store(texts.mapInArrow(tidy(_sets), "rep long, hashes binary").dropDuplicates(["rep"]), "sets")
        self.stage.release()
        label, paths = None, []
        for k in range(ROUNDS + 1):
            whole = k == ROUNDS
            members = self.members(groups, label)
            pairs = self.proposed(self.halves(members) if whole else self.blocks(members), whole)
            if paths:
                # Linked pairs are within a component by now and are not proposed again.
                pairs = pairs.join(tested.where("NOT linked").select("a", "b"), ["a", "b"], "left_anti")
            name = f"tested-{k}"
            schema = self.stage.store(self.verify(pairs), name).schema
            paths.append(self.stage.path(name))
            # One scan of all rounds' tables, so that plans do not grow with the rounds.
            tested = self.spark.read.schema(schema).parquet(*paths)
            self.stage.release()
            # Between rounds any labels that links bear out will do; only the last must be the roots.
            label = components(self.stage, tested.where("linked").select("a", "b"), f"components-{k}", None if whole else 2)
        self.label = label
        return tested.where("linked").select("a", "b")


def group_texts(docs: DataFrame, numerator: int = 85, denominator: int = 100) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id and kept.

    Texts are linked where intersection / union of their sets is at least ``numerator``
    / ``denominator``. ``component_id`` is the smallest doc_id that links reach.
    """
    run = Grouping(docs, numerator, denominator)
    run.links()
    roots = run.classes.join(run.label.withColumnRenamed("id", "rep"), "rep", "left").select("digest", F.coalesce("component", "rep").alias("root"))
    out = run.rows.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("digest")).alias("digest")).join(roots, "digest", "left")
    component = F.coalesce("root", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def drop_near_copies(docs: DataFrame, numerator: int = 85, denominator: int = 100) -> DataFrame:
    """``docs`` with one row of each group of texts: one of the smallest doc_id.

    Rows without a doc_id and rows without words link with nothing and stay. Where doc_ids
    repeat, texts are grouped by (doc_id, text), so that none goes for another's doc_id.
    """
    doc_id = F.col("`doc_id`").cast("long")
    ids = docs.where(doc_id.isNotNull()).groupBy(doc_id.alias("doc_id"))
    if ids.count().where("count > 1").isEmpty():
        found = group_texts(docs, numerator, denominator).where("NOT kept").select(F.col("doc_id").alias("__gone")).distinct()
        return docs.join(found, doc_id == F.col("__gone"), "left_anti")
    keyed = docs.withColumn("__row", F.when(doc_id.isNotNull(), F.xxhash64(doc_id, F.col("`text`"))))
    grouped = group_texts(keyed.select(F.col("__row").alias("doc_id"), "text"), numerator, denominator)
    grouped = grouped.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("__row"), "component_id").agg(F.count("*").alias("n"))
    owner = keyed.select("__row", doc_id.alias("owner")).where("__row IS NOT NULL").distinct()
    first = F.min(F.struct("owner", "__row", "n")).alias("first")
    stays = grouped.join(owner, "__row").groupBy("component_id").agg(first).select("first.__row", "first.n")
    gone = grouped.join(stays.where("n = 1"), "__row", "left_anti").select("__row")
    once = keyed.join(stays.where("n > 1"), "__row", "left_semi").dropDuplicates(["__row"])
    return keyed.join(gone, "__row", "left_anti").unionByName(once).select(*[F.col(f"`{c}`") for c in docs.columns])


ORACLE = """
with recursive words as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w from documents),
sets as (select distinct doc_id, s from (select doc_id, unnest(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
  else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) as s from words)),
size as (select doc_id, count(*) as n from sets group by doc_id),
pair as (select a.doc_id as a, b.doc_id as b, count(*) as common from sets a join sets b on a.s = b.s and a.doc_id < b.doc_id group by all),
link as (select a, b from pair join size x on x.doc_id = a join size y on y.doc_id = b where 100 * common >= 85 * (x.n + y.n - common)),
ends as (select a, b from link union all select b, a from link),
reach(id, root) as (select doc_id, doc_id from documents union select ends.b, reach.root from reach join ends on ends.a = reach.id where reach.root < ends.b),
low as (select id, min(root) as component_id from reach group by id)
select d.doc_id, coalesce(n, 0) as n_shingles, component_id, d.doc_id = component_id as kept
from documents d left join size using (doc_id) join low on low.id = d.doc_id
"""
