"""SentencePiece encoding with a table of prefixes, and decoding.

The model merges symbols: while two neighbours join to a piece, the pair of the best
score is joined, the leftmost of equal ones. Whether a boundary between two tokens
survives is a matter of these two tokens alone, so every prefix of a text has exactly
one last token, and it can be found from left to right: of the pieces that end at a
place (an automaton over all pieces names them, the longest first) it is the one that
is compatible with the last token of the prefix before it. ``Coder.table`` stores this
one token per prefix; ids are then recovered from the end backwards. Two tokens are
compatible if merging the symbols of both never joins across their boundary; the
answers are kept.

Text is normalised by the library. Between two characters that are neighbours in no
piece nothing can be joined, so a text is cut at word starts where the vocabulary
allows it, and the tables of frequent words are kept in a bounded memory of each
worker. Characters without a piece become the pieces of their UTF-8 bytes.

Models: type BPE with byte pieces and without unused pieces; others are refused with a
``ValueError``. Null text counts as empty: no ids, an empty decoded text. A text of any
length takes time and memory in proportion to it. Repeated rows give repeated results, an
empty table an empty one; null ids of documents are kept. Other columns are ignored.
"""

from __future__ import annotations

import heapq
import re
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns, ready

MARK = "▁"  # stands for a blank in pieces
WORDS = 400_000  # words whose ids a worker keeps
LONGEST = 48  # characters of a word worth keeping
PAIRS = 1_000_000  # answers about two tokens that a worker keeps
ALONE = -1  # a character without a piece
DENSE = 4096  # characters from which on a table is packed


def merges(text: str, score: Callable[[str], float | None]) -> list[tuple[float, int, str, str, str]]:
    """Every joining of ``text`` in its order: (minus score, place, joint, first symbol, last symbol afterwards).

    This is the definition that the table rests on; only single pieces come here.
    """
    symbols: list[str] = list(text)
    after = list(range(1, len(symbols) + 1))
    before = list(range(-1, len(symbols) - 1))
    heap: list[tuple[float, int, str]] = []
    done = []
    last = len(symbols) - 1

    def offer(left: int) -> None:
        right = after[left]
        if right < len(symbols):
            joint = symbols[left] + symbols[right]
            value = score(joint)
            if value is not None:
                heapq.heappush(heap, (-value, left, joint))

    for i in range(len(symbols)):
        offer(i)
    while heap:
        key, left, joint = heapq.heappop(heap)
        right = after[left]
        if not symbols[left] or right >= len(symbols) or symbols[left] + symbols[right] != joint:
            continue
        symbols[left], symbols[right] = joint, ""
        after[left] = after[right]
        if after[left] < len(symbols):
            before[after[left]] = left
        if right == last:
            last = left
        offer(left)
        if before[left] >= 0:
            offer(before[left])
        done.append((key, left, joint, symbols[0], symbols[last]))
    return done


def packed(ids: list[int]) -> bytes:
    return np.array(ids, "<u4").tobytes()


class Coder:
    """One model: tokens, the automaton over them, and what is known about pairs and words."""

    def __init__(self, model: str):
        self.library = sentencepiece.SentencePieceProcessor(model_file=model)
        p = self.library
        plain = []
        self.bytes = {}
        for i in range(p.vocab_size()):
            if p.is_unused(i):
                raise ValueError("models with unused pieces are not supported")
            if p.is_byte(i):
                self.bytes[int(p.id_to_piece(i)[3:-1], 16)] = i
            elif not (p.is_control(i) or p.is_unknown(i)):
                plain.append(i)
        if len(self.bytes) != 256:
            raise ValueError("the model has no byte pieces")
        self.score = {p.id_to_piece(i): p.get_score(i) for i in plain}
        # A piece that merging does not leave whole never comes out. Characters that occur
        # in pieces only are tokens too, so that every prefix of known characters has one.
        steps = {p.id_to_piece(i): merges(p.id_to_piece(i), self.score.get) for i in plain}
        ids = {p.id_to_piece(i): i for i in plain if len(p.id_to_piece(i)) == 1 or (steps[p.id_to_piece(i)] or [(0, 0, "")])[-1][2] == p.id_to_piece(i)}
        self.piece = list(ids)
        self.ids = [packed([i]) for i in ids.values()]
        for c in sorted(set("".join(self.score)) - set(ids)):
            self.piece.append(c)
            self.ids.append(self.spell(c))
        self.size = len(self.piece)
        self.length = [len(x) for x in self.piece]
        self.steps = [steps.get(x, []) for x in self.piece]
        self.automaton = ahocorasick.Automaton()
        for token, x in enumerate(self.piece):
            self.automaton.add_word(x, (token, len(x)))
        self.automaton.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.words: dict[str, bytes] = {}
        self.split = self.cutter()

    def cutter(self) -> Callable[[str], list[str]]:
        """Cuts a text into words such that no piece has the characters on both sides of a cut as neighbours.

        Characters that are neighbours in some piece are of one class, and so are those
        they lead to; a word is a run of one class with the blanks before it.
        """
        if any(MARK in x.lstrip(MARK) for x in self.score):
            return lambda text: [text]
        leader = {c: c for x in self.score for c in x}
        joined = set()

        def find(c: str) -> str:
            while leader[c] != c:
                leader[c] = c = leader[leader[c]]
            return c

        for x in self.score:
            x = x.lstrip(MARK)
            for a, b in zip(x, x[1:]):
                leader[find(a)] = find(b)
                joined.add(a)
        classes: dict[str, list[str]] = {}
        for c in leader:
            classes.setdefault(find(c), []).append(c)
        several = [c for c in classes.values() if not joined.isdisjoint(c)]
        runs = ["[" + "".join(map(re.escape, sorted(c))) + "]+" for c in sorted(several, key=len, reverse=True)]
        return re.compile(f"{MARK}*(?:{'|'.join([*runs, f'[^{MARK}]'])})|{MARK}+", re.DOTALL).findall

    def spell(self, character: str) -> bytes:
        return packed([self.bytes[b] for b in character.encode()])

    def apart(self, left: int, right: int) -> bool:
        """Whether merging the symbols of both tokens never joins across the boundary between them.

        Each side's own joinings come in the order they have alone; of the next ones of both
        sides and the one across, the best is done.
        """
        score, middle = self.score.get, self.length[left]
        mine, theirs = self.steps[left], self.steps[right]
        a, b = self.piece[left][-1], self.piece[right][0]
        across = score(a + b)
        i = j = 0
        while i < len(mine) or j < len(theirs):
            is_mine = j == len(theirs) or (i < len(mine) and mine[i][0] <= theirs[j][0])
            key, place = mine[i][:2] if is_mine else theirs[j][:2]
            if across is not None and (-across, middle - len(a)) < (key, place if is_mine else middle + place):
                return False
            if is_mine:
                edge, i = mine[i][4], i + 1
                changed, a = edge is not a, edge
            else:
                edge, j = theirs[j][3], j + 1
                changed, b = edge is not b, edge
            if changed:
                across = score(a + b)
        return across is None

    def compatible(self, left: int, right: int) -> bool:
        """``apart``, kept for the next time."""
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        known = self.pairs[left * self.size + right] = self.apart(left, right)
        return known

    def table(self, text: str) -> list[int] | array:
        """The last token of every prefix of ``text`` that is not empty."""
        last = [ALONE] * len(text) if len(text) < DENSE else array("i", [ALONE]) * len(text)
        size, known = self.size, self.pairs.get
        for end, (token, length) in self.automaton.iter(text):
            if last[end] >= 0:
                continue
            if end >= length:
                before = last[end - length]
                if before >= 0:
                    fits = known(before * size + token)
                    if fits is None:
                        fits = self.compatible(before, token)
                    if not fits:
                        continue
            last[end] = token
        return last

    def recovered(self, text: str, last: list[int] | array) -> bytes:
        """Ids of ``text`` read from its table, from the end backwards."""
        parts, end = [], len(text) - 1
        while end >= 0:
            token = last[end]
            if token < 0:
                parts.append(self.spell(text[end]))
                end -= 1
            else:
                parts.append(self.ids[token])
                end -= self.length[token]
        parts.reverse()
        return b"".join(parts)

    def word(self, word: str) -> bytes:
        found = self.recovered(word, self.table(word))
        if len(word) <= LONGEST:
            if len(self.words) >= WORDS:
                self.words.clear()
            self.words[word] = found
        return found

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids of ``text``."""
        known, word = self.words.get, self.word
        return b"".join([known(w) or word(w) for w in self.split(self.library.normalize(text))]) if text else b""


@lru_cache(2)
def coder(model: str) -> Coder:
    """One per worker process, made from the model file every machine has."""
    return Coder(model)


def encode(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, ids): the ids of every text as little-endian unsigned 32-bit integers."""
    ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(model)
        for b in batches:
            ids = [c.encode(t or "") for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    rows = columns(docs, ("doc_id", "text")).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, ids binary")


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """``encoded`` (doc_id, ids) with ``listed``, the ids as decimal numbers joined by commas, and the decoded ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = coder(model).library
        names = [str(i) for i in range(library.vocab_size())]
        for b in batches:
            lists = [np.frombuffer(ids or b"", "<u4").tolist() for ids in b.column("ids").to_pylist()]
            listed = pa.array([",".join(map(names.__getitem__, x)) for x in lists], pa.string())
            text = pa.array([library.decode(x) if x else "" for x in lists], pa.string())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("ids"), listed, text], ["doc_id", "ids", "listed", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, listed string, text string")


def piece_report(docs: DataFrame, model: str) -> DataFrame:
    """Number of ids and digests of the ids and of the decoded text, per document."""
    return decode(encode(docs, model), model).select(
        "doc_id", F.expr("cast(octet_length(ids) / 4 AS bigint)").alias("n_tokens"),
        F.sha2(F.col("listed").cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )
