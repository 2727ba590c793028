"""Language identification: family first, then one-versus-one linear support vector machines.

Features: a whole text is lower-cased, everything but letters becomes a blank, and its
byte trigrams are counted in ``SIZE`` hashed cells; a text's vector is the square root
of the cells' shares, which has length one. Machines between families (every family
against every other) choose the family; machines between the languages of that family
choose the language. The share of votes, weighted by logistic margins, is the score.

Training learns from ``text`` and ``lang`` of rows that are not held out, on a bounded
sample: at most about ``SAMPLE`` rows, spread over the languages, picked by a hash of
doc_id. Families of known codes are fixed; any other language is a family of its own.
Prediction uses the whole text and nothing else.

Null texts and texts without a letter get ``und`` with score 0, as does everything
where no language could be learned. Rows without doc_id are never learned from and count
as held out. Repeated rows get equal results; an empty table gives an empty result.
Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns, learns_from, ready, spread_join

SIZE = 4096
SAMPLE = 6000
# A language with one of so many rows is common: at most that many are.
HOT = 1000
EPOCHS = 12
COST = 4.0
PIECE = 1 << 20  # bytes of a text that are counted at once

# Families of language codes.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "is", "af"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl"),
    "slavic": ("ru", "uk", "be", "bg", "sr", "hr", "sl", "cs", "sk", "pl"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz"),
    "semitic": ("ar", "he"),
    "indic": ("hi", "bn", "mr", "ur", "pa", "gu"),
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes}
_LETTERS = bytes(b if b > 127 or 97 <= b <= 122 else 32 for b in range(256))
_LETTER = regex.compile(r"\p{L}")


def family_of(code: str) -> str:
    return _FAMILY.get(code, code)


def vector(text: str) -> np.ndarray:
    data = b" " + text.lower().encode("utf-8", "surrogatepass").translate(_LETTERS) + b" "
    total = np.zeros(SIZE)
    for at in range(0, len(data) - 2, PIECE):
        b = np.frombuffer(data[at : at + PIECE + 2], np.uint8).astype(np.uint32)
        key = (b[:-2] << 16) | (b[1:-1] << 8) | b[2:]
        key = key[b[1:-1] != 32]
        total += np.bincount(((key * np.uint32(2654435761)) >> np.uint32(20)).astype(np.int64), minlength=SIZE)
    n = total.sum()
    return np.sqrt(total / n).astype(np.float32) if n else total.astype(np.float32)


def machine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights (the last one for a constant) of a linear support vector machine, by dual coordinate descent.

    Classes weigh the same whatever their sizes.
    """
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    cap = np.where(y > 0, COST * len(y) / max(1, 2 * (y > 0).sum()), COST * len(y) / max(1, 2 * (y < 0).sum()))
    w, alpha, norm = np.zeros(x.shape[1]), np.zeros(len(x)), (x * x).sum(1)
    order = np.random.default_rng(1)
    for _ in range(EPOCHS):
        for i in order.permutation(len(x)):
            gradient = y[i] * (x[i] @ w) - 1
            after = min(max(alpha[i] - gradient / norm[i], 0.0), cap[i])
            if after != alpha[i]:
                w += (after - alpha[i]) * y[i] * x[i]
                alpha[i] = after
    return w


@dataclass
class Model:
    """Names of families and their languages, and a machine for each pair of names at a level."""

    families: dict[str, list[str]]
    levels: dict[str, tuple[list[str], list[tuple[int, int]], np.ndarray]]

    @classmethod
    def fit(cls, x: np.ndarray, langs: list[str]) -> Model:
        families: dict[str, list[str]] = {}
        for code in sorted(set(langs)):
            families.setdefault(family_of(code), []).append(code)
        lang = np.array(langs, object)
        family = np.array([family_of(c) for c in langs], object)
        levels = {}
        for level, names, labels in [("", sorted(families), family), *((f, codes, lang) for f, codes in families.items())]:
            pairs = [(i, j) for i in range(len(names)) for j in range(i)]
            weights = np.zeros((SIZE + 1, len(pairs)))
            for k, (i, j) in enumerate(pairs):
                rows = (labels == names[i]) | (labels == names[j])
                weights[:, k] = machine(x[rows], np.where(labels[rows] == names[i], 1.0, -1.0))
            levels[level] = (names, pairs, weights)
        return cls(families, levels)

    def choose(self, level: str, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the name with most votes for each row, and its mean vote."""
        names, pairs, weights = self.levels[level]
        if len(names) == 1:
            return np.zeros(len(x), int), np.ones(len(x))
        margin = x @ weights[:-1] + weights[-1]
        sure = 1 / (1 + np.exp(-2 * np.clip(margin, -30, 30)))
        votes, total = np.zeros((len(x), len(names))), np.zeros((len(x), len(names)))
        for k, (i, j) in enumerate(pairs):
            votes[:, i] += margin[:, k] > 0
            votes[:, j] += margin[:, k] <= 0
            total[:, i] += sure[:, k]
            total[:, j] += 1 - sure[:, k]
        best = (votes + total / (len(names) + 1)).argmax(1)  # votes decide, margins break ties
        return best, total[np.arange(len(x)), best] / (len(names) - 1)

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        which, score = self.choose("", x)
        names = self.levels[""][0]
        out = np.empty(len(x), object)
        for k, family in enumerate(names):
            rows = np.flatnonzero(which == k)
            if len(rows):
                inside, sure = self.choose(family, x[rows])
                out[rows] = np.array(self.families[family], object)[inside]
                score[rows] *= sure
        return out.tolist(), np.clip(score, 0.0, 1.0)


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        cells = pa.array([vector(t).astype(np.float16).tobytes() for t in b.column("text").to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([b.column("lang"), cells], ["lang", "cells"])


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model | None:
    """A model learned from a bounded sample of the rows that are not held out."""
    ready(docs.sparkSession)
    known = columns(docs, ("doc_id", "lang", "text")).where(learns_from(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    share = known.groupBy("lang").agg(F.count("*").alias("n"))
    every = _everything()
    share = share.select(
        "lang", (F.lit(float(sample)) / F.count("*").over(every) / F.col("n")).alias("share"),
        (F.col("n") * HOT >= F.sum("n").over(every)).alias("hot"),
    )
    luck = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    # Texts of common languages stay where they are.
    picked = spread_join(known, share, ["lang"], F.col("hot")).where(luck < F.col("share")).where("text RLIKE '\\\\p{L}'").select("lang", "text")
    rows = picked.mapInArrow(_vectors, "lang string, cells binary").collect()
    if not rows:
        return None
    rows.sort(key=lambda r: (r.lang, r.cells))
    x = np.frombuffer(b"".join(r.cells for r in rows), np.float16).reshape(len(rows), SIZE).astype(np.float32)
    return Model.fit(x, [r.lang for r in rows])


def _everything():
    from pyspark.sql import Window

    return Window.partitionBy(F.lit(1))  # one row per language


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred and score of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang, score = ["und"] * len(b), np.zeros(len(b))
            texts = b.column("text").to_pylist()
            rows = [i for i, t in enumerate(texts) if model and t and _LETTER.search(t)]
            if rows:
                found, score[rows] = model.predict(np.stack([vector(texts[i]) for i in rows]))
                for i, name in zip(rows, found, strict=True):
                    lang[i] = name
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    rows = columns(docs, ("doc_id", "text")).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Learn from ``docs`` and predict the language of each of its rows."""
    held_out = F.coalesce(~learns_from(F.col("doc_id")), F.lit(True))
    return predict(docs, fit(docs, sample)).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
