"""Best-fit packing of documents into sequences of a fixed number of tokens.

Tokens. A text is split at ASCII blanks, which the tokenizer drops and which no token
spans, so the ids of a text are those of its words. The added tokens of the vocabulary
(<|endoftext|> and its like) are cut out of the words first and get their own ids, unless
``encode_special_tokens`` asks for them as plain text. A worker keeps the ids of the words
that it has met in a bounded memory; those it has not met are split many at a time. Every document ends with an end id; only documents
longer than a sequence are cut.

Packing. Pieces are dealt evenly over shards of bounded size. A shard places its pieces
best fit, longest first, then improves by local search: while bins are more than the
tokens need, it moves one piece, or exchanges one for one, two for one or one for two,
between underfull bins, whenever that increases the sum of squared fills. Full bins
become sequences; the pieces of underfull ones are dealt anew over fewer shards, until
one shard is left or another round would not help.

Null text counts as empty: one piece with the end id alone. Repeated rows and null ids
are packed as rows of their own, ties in length in any order; an empty table gives an
empty result. Other columns are ignored.
"""

from __future__ import annotations

import json
import struct
import zlib
from bisect import insort
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import Stage, columns, ready

LENGTH = 4096
END = 1
MEMORY = 400_000  # words, and parts of words, kept by a worker; as many older ones stay at hand
LONGEST = 64  # characters of a word worth keeping
TOGETHER = 1024  # new words of at most that length that are split in one call
BREAK, KEPT = "\n", "\0"  # stand between words: never within one; kept by the normaliser
MARK = b"\xff" * 4  # stands for a break among ids, all of which are smaller and end with a zero byte
SHARD = 20_000  # pieces that one task packs
# The blanks of Unicode, as a part of a character class.
BLANKS = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PASSES = 50  # passes of local search over a shard's underfull bins


class Parts(dict):
    """Little-endian 32-bit ids of a part of a word, merged by the model when it is not at hand."""

    def __init__(self, model):
        self.model, self.older = model, {}
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; the others follow
        self.letters = {b: b for b in shown} | {b: 256 + i for i, b in enumerate(sorted(set(range(256)) - set(shown)))}
        self[BREAK] = MARK

    def __missing__(self, part: str) -> bytes:
        ids = self.older.get(part)
        if ids is None:
            # Printable ASCII stands for itself.
            plain = part.isascii() and part.isprintable()
            tokens = self.model.tokenize(part if plain else part.encode().decode("latin-1").translate(self.letters))
            ids = struct.pack(f"<{len(tokens)}I", *[t.id for t in tokens])
            if len(part) > LONGEST:
                return ids
        self[part] = ids
        return ids

    def turn(self) -> None:
        """A full memory becomes the older one, from which what is still met moves on."""
        if len(self) > MEMORY:
            self.older = dict(self)
            self.clear()
            self[BREAK] = MARK


class Words:
    """Ids of texts as little-endian 32-bit integers, by way of their words.

    A word met before costs one look-up. New ones are normalised and split by the rules that
    the vocabulary file names, many in one call with breaks between them, and their parts
    are looked up or merged by its model.
    """

    def __init__(self, vocabulary: str, encode_special_tokens: bool = True):
        self.tokenizer = Tokenizer.from_file(vocabulary)
        with open(vocabulary, encoding="utf-8") as file:
            rules = json.load(file)
        rule = rules["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        added = [] if encode_special_tokens else rules["added_tokens"]
        for t in added:
            if len(t["content"].split()) != 1 or t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"]:
                raise ValueError(f"added token {t['content']!r} is more than a fixed part of a word")
        self.added = {t["content"]: np.array([t["id"]], "<u4").tobytes() for t in added}
        # The leftmost match, of several the longest, as the library has it.
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")")
        self.split = regex.compile(f"{rule}|{BREAK}".replace(r"\s", BLANKS))
        self.parts = Parts(self.tokenizer.model)
        # A full memory becomes the older one, from which what is still met moves on.
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def ids(self, plain: str) -> bytes:
        return b"".join(map(self.parts.__getitem__, self.split.findall(plain)))

    def word(self, word: str) -> bytes:
        if any(t in word for t in self.added):
            return b"".join(self.added[p] if p in self.added else self.plain(p) for p in self.cut.split(word))
        return self.plain(word)

    def plain(self, word: str) -> bytes:
        return self.ids(word.lower() if word.isascii() else self.tokenizer.normalizer.normalize_str(word))

    def several(self, words: list[str]) -> list[bytes]:
        """The ids of each word; words hold no break. Two words never touch, so one does not change another."""
        text = BREAK.join(words)
        if any(t in text for t in self.added):
            return [*map(self.word, words)]
        if text.isascii():
            return self.ids(text.lower()).split(MARK)
        # The normaliser turns breaks into blanks, so it gets a character that it keeps.
        if KEPT in text:
            return [*map(self.word, words)]
        plain = self.tokenizer.normalizer.normalize_str(text.replace(BREAK, KEPT))
        return self.ids(plain.replace(KEPT, BREAK)).split(MARK)

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [t.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") for t in texts]
        if len(self.known) > MEMORY:
            self.older, self.known = self.known, {}
        self.parts.turn()
        new = set().union(*split).difference(self.known)
        known, older = self.known, self.older
        long, kinds = [], ([], [])
        for word in new:
            if word in older:
                known[word] = older[word]
            elif len(word) > LONGEST:
                long.append(word)
            else:
                kinds[word.isascii()].append(word)
        known.update((word, self.word(word)) for word in long)
        for kind in kinds:
            for at in range(0, len(kind), TOGETHER):
                some = kind[at : at + TOGETHER]
                known.update(zip(some, self.several(some), strict=True))
        out = [b"".join(map(known.__getitem__, words)) for words in split]
        for word in long:
            del known[word]
        return out


@lru_cache(1)
def words(vocabulary: str, encode_special_tokens: bool) -> Words:
    return Words(vocabulary, encode_special_tokens)


def tokenize(docs: DataFrame, vocabulary: str, length: int = LENGTH, with_ids: bool = True, encode_special_tokens: bool = True) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32 [, ids]): the pieces of every document, in their order.

    ``encode_special_tokens`` is the library's setting, which it has off unless told otherwise.
    """
    ready(docs.sparkSession)
    end = np.array([END], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = words(vocabulary, encode_special_tokens)
        for b in batches:
            out: dict[str, list] = defaultdict(list)
            for doc, ids in zip(b.column("doc_id").to_pylist(), w.encode([t or "" for t in b.column("text").to_pylist()]), strict=True):
                ids += end
                for piece, at in enumerate(range(0, len(ids), 4 * length)):
                    part = ids[at : at + 4 * length]
                    for name, value in (("doc_id", doc), ("piece", piece), ("start", at // 4), ("length", len(part) // 4), ("ids_crc32", zlib.crc32(part))):
                        out[name].append(value)
                    if with_ids:
                        out["ids"].append(part)
            yield pa.RecordBatch.from_arrays([pa.array(out[n], t) for n, t in schema.items()], list(schema))

    schema = {"doc_id": pa.int64(), "piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64()} | ({"ids": pa.binary()} if with_ids else {})
    rows = columns(docs, ("doc_id", "text")).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids binary" if with_ids else ""))


class Bins:
    """Bins of one shard: best fit first, then exchanges that increase the sum of squared fills."""

    def __init__(self, sizes: list[int], capacity: int):
        self.capacity, self.least = capacity, -(-sum(sizes) // capacity)
        self.items: list[list[tuple[int, int]]] = []  # (size, piece) of a bin, ascending
        self.fill: list[int] = []
        by_gap: dict[int, list[int]] = defaultdict(list)
        gaps = 0  # bit g is set while a bin has g tokens left
        for size, piece in sorted(((s, i) for i, s in enumerate(sizes)), key=lambda x: -x[0]):
            room = gaps >> size
            if room:
                gap = size + (room & -room).bit_length() - 1
                b = by_gap[gap].pop()
                if not by_gap[gap]:
                    gaps ^= 1 << gap
            else:
                gap, b = capacity, len(self.items)
                self.items.append([])
                self.fill.append(0)
            self.items[b].append((size, piece))
            self.fill[b] += size
            if gap > size:
                by_gap[gap - size].append(b)
                gaps |= 1 << (gap - size)
        for held in self.items:
            held.sort()

    def used(self) -> int:
        return sum(f > 0 for f in self.fill)

    def improve(self) -> None:
        for _ in range(PASSES):
            if self.used() <= self.least or not self._pass():
                return

    def _pass(self) -> bool:
        """Try to fill each underfull bin, fullest first, from emptier ones; whether anything changed."""
        under = sorted((b for b, f in enumerate(self.fill) if 0 < f < self.capacity), key=lambda b: -self.fill[b])
        holders: dict[int, set[int]] = defaultdict(set)
        sums: dict[int, set[int]] = defaultdict(set)
        self._singles, self._doubles = holders, sums
        self._ones = self._twos = 0
        for b in under:
            self._index(b, True)
        changed = False
        for a in under:
            while 0 < self.fill[a] < self.capacity and self._fill(a):
                changed = True
        return changed

    def _index(self, b: int, add: bool) -> None:
        """Enter or remove the sizes, and the sums of two sizes, that bin ``b`` can give."""
        if not 0 < self.fill[b] < self.capacity and add:
            return
        sizes = sorted({s for s, _ in self.items[b]})
        held = [s for s, _ in self.items[b]][:24]  # small pieces make the useful pairs
        pairs = {held[i] + held[j] for i in range(len(held)) for j in range(i)}
        for sizes_of, table, name in ((sizes, self._singles, "_ones"), (pairs, self._doubles, "_twos")):
            bits = getattr(self, name)
            for s in sizes_of:
                if add:
                    table[s].add(b)
                    bits |= 1 << s
                else:
                    table[s].discard(b)
                    if not table[s]:
                        bits &= ~(1 << s)
            setattr(self, name, bits)

    def _giver(self, a: int, bits: int, table: dict[int, set[int]], give: int) -> tuple[int, int] | None:
        """The largest size over ``give`` that fits, from a bin that ends emptier than ``a`` ends full."""
        limit = give + self.capacity - self.fill[a]
        while True:
            size = (bits & ((1 << (limit + 1)) - 1)).bit_length() - 1
            if size <= give:
                return None
            after = self.fill[a] + size - give
            found = min((b for b in table[size] if b != a and self.fill[b] < after), key=self.fill.__getitem__, default=None)
            if found is not None:
                return size - give, found
            limit = size - 1

    def _fill(self, a: int) -> bool:
        """The exchange that brings most into bin ``a``; whether there was one."""
        held = self.items[a]
        best: tuple[int, int, tuple[int, ...], bool] | None = None
        gap = self.capacity - self.fill[a]
        few = range(min(len(held), 24))
        gives = [()] + [(i,) for i in range(len(held))] + [(j, i) for i in few for j in range(i)]
        for give in gives:
            out = sum(held[i][0] for i in give)
            kinds = [(self._ones, self._singles, False)] + ([(self._twos, self._doubles, True)] if len(give) < 2 else [])
            for bits, table, double in kinds:
                if (found := self._giver(a, bits, table, out)) and (best is None or found[0] > best[0]):
                    best = (*found, give, double)
            if best and best[0] == gap:
                break
        if best is None:
            return False
        gain, b, give, double = best
        want = gain + sum(held[i][0] for i in give)
        self._index(a, False)
        self._index(b, False)
        moved = [held.pop(i) for i in sorted(give, reverse=True)]
        taken = self._take(b, want, double)
        for x in taken:
            insort(held, x)
        for x in moved:
            insort(self.items[b], x)
        self.fill[a] += gain
        self.fill[b] -= gain
        self._index(a, True)
        self._index(b, True)
        return True

    def _take(self, b: int, want: int, double: bool) -> list[tuple[int, int]]:
        held = self.items[b]
        if not double:
            return [held.pop(next(i for i, x in enumerate(held) if x[0] == want))]
        i, j = next((i, j) for i in range(min(len(held), 24)) for j in range(i) if held[i][0] + held[j][0] == want)
        return [held.pop(i), held.pop(j)]


def _pack(capacity: int, round_: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames), ignore_index=True) if frames is not None else None
        if rows is None or rows.empty:
            return
        bins = Bins(rows["length"].tolist(), capacity)
        bins.improve()
        sequence, offset = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        full = np.zeros(len(rows), bool)
        first = (round_ << 56) | (TaskContext.get().partitionId() << 28)
        for b, held in enumerate(bins.items):
            at = 0
            for size, i in held:
                sequence[i], offset[i], full[i] = first | b, at, bins.fill[b] == capacity
                at += size
        yield rows.assign(sequence_id=sequence, offset=offset, full=full)

    return run


def pack(pieces: DataFrame, capacity: int = LENGTH) -> DataFrame:
    """``pieces`` (any columns, ``length`` of 1 to ``capacity``) with ``sequence_id`` and ``offset``."""
    stage = Stage(pieces.sparkSession, "packing")
    # Partitions are dealt as they are, without coalescing: each is a shard.
    names = pieces.columns
    open_, done, round_ = stage.store(pieces, "open-0"), [], 0
    left = open_.count()
    while left:
        shards = -(-left // SHARD)
        schema = open_.schema.simpleString()[7:-1] + ",sequence_id:bigint,offset:bigint,full:boolean"
        packed = stage.store(open_.repartition(shards).mapInPandas(_pack(capacity, round_), schema), f"round-{round_}")
        after = packed.where("NOT full").count()
        # A last round has all underfull bins in one shard, or finds nearly as many pieces as it was given.
        if shards == 1 or after > 0.9 * left:
            done.append(packed)
            break
        done.append(packed.where("full"))
        open_, left, round_ = packed.where("NOT full").select(*names), after, round_ + 1
    if not done:
        return pieces.select("*", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    return out.drop("full")


def packed(docs: DataFrame, vocabulary: str, length: int = LENGTH, encode_special_tokens: bool = True) -> DataFrame:
    """Per piece: its document, place, checksum of ids, sequence and offset."""
    return pack(tokenize(docs, vocabulary, length, with_ids=False, encode_special_tokens=encode_special_tokens), length)
