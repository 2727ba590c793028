"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

Lexicon: words that occur in far more toxic than clean documents of the training sample,
weighted by their log odds. Features of a whole text: densities of lexicon words (as
written, and after undoing letter substitutions), their number of kinds and weight, how
many stand near a second-person word, shares of capitals and of words in capitals,
punctuation, and obfuscated words. Shallow trees are boosted on the logistic loss over
two thirds of the sample; a monotone calibration is fitted on the last third.

Training learns from rows that are not held out, on a bounded sample of about ``SAMPLE``
labelled documents picked by a hash of doc_id. Scoring uses the text alone.

Null texts count as empty and are scored like any text. Labels that are null are left
out; a document with several labels counts once for each. Rows without doc_id are never
learned from and count as held out. Without labels of both kinds every score is the
share of toxic labels (0 without any). Repeated rows get equal scores; an empty table
gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns, learns_from, ready, tidy

SAMPLE = 15_000
LEXICON = 300
LEAST_ODDS = 1.5
TREES, DEPTH, RATE, LEAST_LEAF, CUTS = 80, 3, 0.15, 10, 32
NEAR = 5
TOXIC_FROM = 0.7
# Second-person words of some languages; characters that stand for letters.
YOU = frozenset(
    "you your yours yourself u ur du dich dir dein deine deiner ihr euch tu te toi ton ta tes vous votre vos ti usted ustedes vosotros su sus".split()
)
LETTER_FOR = str.maketrans("0134578@$!|", "oieastbasil")
_WORD = re.compile(r"[^\W_]+(?:[@$!*|][^\W_]+)*")
_ODD = re.compile(r"[A-Za-z][0-9@$!*|]+[A-Za-z]")
_LONG = re.compile(r"([A-Za-z])\1\1")


def kinds() -> np.ndarray:
    """Class of each byte: 1 capital, 2 small letter, 3 exclamation or question, 4 other punctuation, 5 part of a wider letter."""
    out = np.zeros(256, np.uint8)
    out[65:91], out[97:123], out[128:] = 1, 2, 5
    for c in b"\"#$%&'()*+,-./:;<=>@[\\]^_`{|}~":
        out[c] = 4
    out[[33, 63]] = 3
    return out


_KIND = kinds()


def tokens(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def features(text: str, weight: dict[str, float]) -> list[float]:
    words = tokens(text)
    n = max(1, len(words))
    hits = [i for i, w in enumerate(words) if w in weight]
    odd = _ODD.findall(text)
    hidden = sum(w not in weight and w.translate(LETTER_FOR) in weight for w in words if not w.isalpha()) if odd else 0
    near = 0
    if hits:
        near = sum(any(w in YOU for w in words[max(0, i - NEAR) : i + NEAR + 1]) for i in hits)
    odds = [weight[words[i]] for i in hits]
    size = np.bincount(_KIND[np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)], minlength=6)
    letters = max(1, size[1] + size[2] + size[5])
    chars = max(1, len(text))
    return [
        len(hits) / n, sum(odds) / n, max(odds, default=0.0), float(len({words[i] for i in hits})), np.log1p(len(hits)), np.log1p(sum(odds)),
        hidden / n, near / n, near / max(1, len(hits)), size[1] / letters, sum(map(str.isupper, text.split())) / n,
        size[3] / chars, size[4] / chars, len(odd) / n, len(_LONG.findall(text)) / n, np.log1p(len(words)),
    ]


@dataclass
class Trees:
    """Boosted trees of a fixed depth: per inner node a feature and a limit, per leaf a value."""

    base: float = 0.0
    feature: list[np.ndarray] = field(default_factory=list)
    limit: list[np.ndarray] = field(default_factory=list)
    value: list[np.ndarray] = field(default_factory=list)

    @staticmethod
    def leaf(x: np.ndarray, feature: np.ndarray, limit: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), int)
        for _ in range(DEPTH):
            at = 2 * at + 1 + (x[np.arange(len(x)), feature[at]] > limit[at])
        return at - (2**DEPTH - 1)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for f, t, v in zip(self.feature, self.limit, self.value, strict=True):
            out += v[self.leaf(x, f, t)]
        return out

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray) -> Trees:
        out = cls(base=float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))))
        cuts = [np.unique(np.quantile(column, np.linspace(0, 1, CUTS + 1)[1:-1])) for column in x.T]
        bins = np.column_stack([np.searchsorted(c, column, side="left") for c, column in zip(cuts, x.T, strict=True)])
        margin = np.full(len(y), out.base)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-margin))
            slope, curve = y - p, p * (1 - p)
            feature, limit = np.zeros(2**DEPTH - 1, int), np.full(2**DEPTH - 1, np.inf)
            at = np.zeros(len(y), int)
            for node in range(2**DEPTH - 1):
                rows = np.flatnonzero(at == node)
                best = 1e-9
                g, h = slope[rows].sum(), curve[rows].sum()
                for k, c in enumerate(cuts):
                    if not len(c) or not len(rows):
                        continue
                    b = bins[rows, k]
                    gl, hl, nl = (np.cumsum(np.bincount(b, w, len(c) + 1))[:-1] for w in (slope[rows], curve[rows], None))
                    ok = (nl >= LEAST_LEAF) & (len(rows) - nl >= LEAST_LEAF)
                    gain = np.where(ok, gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g**2 / (h + 1), -1.0)
                    i = int(gain.argmax())
                    if gain[i] > best:
                        best, feature[node], limit[node] = gain[i], k, c[i]
                at[rows] = 2 * node + 1 + (x[rows, feature[node]] > limit[node])
            leaf = at - (2**DEPTH - 1)
            value = RATE * np.bincount(leaf, slope, 2**DEPTH) / (np.bincount(leaf, curve, 2**DEPTH) + 1)
            margin += value[leaf]
            out.feature.append(feature)
            out.limit.append(limit)
            out.value.append(value)
        return out


def isotonic(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots (margin, share of toxic) of the best non-decreasing fit, by pooling neighbours that violate the order."""
    order = np.argsort(margin, kind="stable")
    pools: list[list[float]] = []  # sum of labels, count, sum of margins
    for m, v in zip(margin[order], y[order], strict=True):
        pools.append([v, 1, m])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    return np.array([p[2] / p[1] for p in pools]), np.array([p[0] / p[1] for p in pools])


@dataclass
class Model:
    weight: dict[str, float]
    trees: Trees | None
    knots: tuple[np.ndarray, np.ndarray]
    share: float

    def score(self, texts: list[str]) -> np.ndarray:
        if self.trees is None:
            return np.full(len(texts), self.share)
        margin = self.trees.margin(np.array([features(t, self.weight) for t in texts]))
        flat = np.interp(margin, *self.knots)
        # Within a flat part of the calibration the margin still tells texts apart, by less than shows elsewhere.
        return np.clip(0.999 * flat + 0.001 / (1 + np.exp(-margin)), 0.0, 1.0)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents per word and label, summed up in the task first."""
    for b in batches:
        seen: Counter = Counter()
        for text, toxic in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), strict=True):
            seen.update((w, toxic) for w in set(tokens(text)))
        yield pa.RecordBatch.from_arrays(
            [pa.array([w for w, _ in seen], pa.string()), pa.array([n if t else 0 for (_, t), n in seen.items()], pa.int64()), pa.array([0 if t else n for (_, t), n in seen.items()], pa.int64())],
            ["word", "toxic", "clean"],
        )


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model learned from a bounded sample of labelled rows that are not held out."""
    ready(docs.sparkSession)
    known = columns(labels, ("doc_id", "toxic")).where(learns_from(F.col("doc_id")) & F.col("toxic").isNotNull())
    total = known.count()
    luck = F.pmod(F.xxhash64(F.col("doc_id").cast("long"), F.lit(7)), F.lit(1 << 30))
    picked = luck < int(min(1.0, sample / max(1, total)) * (1 << 30))
    rows = (
        columns(docs, ("doc_id", "text")).where(learns_from(F.col("doc_id")) & picked)
        .join(known.where(picked).withColumnRenamed("doc_id", "labelled"), F.col("doc_id") == F.col("labelled"))
        .select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.when(F.col("toxic") > 0, 1).otherwise(0).alias("toxic"))
    )
    size = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    toxic, clean = size.get(1, 0), size.get(0, 0)
    if not toxic or not clean:
        return Model({}, None, (np.zeros(1), np.zeros(1)), float(bool(toxic)))
    words = rows.mapInArrow(tidy(_counted), "word string, toxic long, clean long").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    odds = F.log((F.col("toxic") + 0.5) / (toxic + 1.0)) - F.log((F.col("clean") + 0.5) / (clean + 1.0))
    # A word counts by how far its odds exceed what so few documents could show by chance.
    sure = odds - 2 * F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))
    found = words.where("toxic >= 3").withColumns({"odds": odds, "sure": sure}).where((F.col("odds") > LEAST_ODDS) & (F.col("sure") > 0))
    weight = {r.word: float(r.odds) for r in found.orderBy(F.desc("sure"), "word").limit(LEXICON).collect()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [features(t, weight) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("toxic"), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "toxic", "x"])

    got = rows.mapInArrow(run, "doc_id long, toxic int, x array<double>").collect()
    got.sort(key=lambda r: (r.doc_id, r.toxic))
    x, y = np.array([r.x for r in got]), np.array([r.toxic for r in got], float)
    third = np.random.default_rng(3).permutation(len(y)) % 3 == 0
    if len(set(y[third])) < 2 or len(set(y[~third])) < 2:
        third = np.ones(len(y), bool)
        trees = Trees.fit(x, y)
    else:
        trees = Trees.fit(x[~third], y[~third])
    return Model(weight, trees, isotonic(trees.margin(x[third]), y[third]), toxic / (toxic + clean))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = model.score([t or "" for t in b.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(found, pa.float64())], ["doc_id", "score"])

    return columns(docs, ("doc_id", "text")).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(run), "doc_id long, score double")


def rate(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Learn from labelled rows of ``docs`` and score each of its rows."""
    held_out = F.coalesce(~learns_from(F.col("doc_id")), F.lit(True))
    return score(docs, fit(docs, labels, sample)).select(
        "doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= TOXIC_FROM, 1).otherwise(0).alias("predicted")
    )


def drop_toxic(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``docs`` without the rows that the model rejects; columns stay as they are."""
    model = fit(docs, labels, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = model.score([t or "" for t in b.column("text").to_pylist()])
            yield b.filter(pa.array(np.asarray(found) < TOXIC_FROM, pa.bool_()))

    return docs.mapInArrow(tidy(run), docs.schema)
