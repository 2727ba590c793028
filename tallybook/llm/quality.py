"""Quality rules: word counts and repeats, and robust multivariate outliers.

Base rules count words, symbols, repeated lines and words in repeated 3-word windows.
The method then estimates, for every (language, source), the location and scatter of
five transformed statistics by the minimum covariance determinant, and rejects
documents whose squared Mahalanobis distance lies beyond a chi-square quantile. All is
done by SQL expressions and aggregates: no Python and no collect on the path.

Estimation. Two deterministic starts (distance from the medians in units of the
quartile range; classical mean and covariance) are improved by concentration steps:
the share ``SUBSET`` of nearest documents gives the next mean and covariance. The start
with the smaller determinant wins; a reweighting step follows. A small ridge on the
diagonal keeps constant statistics from giving infinite distances. Groups with fewer
than ``LEAST_GROUP`` documents use the estimate of their language, and small languages
that of all documents; with too few of those, nothing is rejected by the method. Every
document counts in every estimate that it belongs to. Subsets are cut at approximate
quantiles, which have bounded state and combine before the shuffle, so a source with
a third of all documents is no hot task.

Null text counts as empty (no words: the base rules fail it). Null language or source
forms its own group. Repeated rows are judged as often as they occur; equal vectors get
equal verdicts. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from math import exp, lgamma, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.once import once
from .common import SPACE, WORD, Stage, columns

SUBSET = 0.75
STEPS = 3
LEAST_GROUP = 200
REWEIGHT = 0.975
REJECT = 1 - 1e-6
# Standard deviations below which differences of a statistic are never called unusual.
RIDGE = (0.25, 0.1, 0.05, 0.2, 0.2)
NAMES = ("x0", "x1", "x2", "x3", "x4")
D = len(NAMES)
PAIRS = [(i, j) for i in range(D) for j in range(i, D)]
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def chi2_below(x: float, k: float) -> float:
    """Share of a chi-square distribution with ``k`` degrees of freedom below ``x`` (series of the incomplete gamma)."""
    a, x = k / 2, x / 2
    if x <= 0:
        return 0.0
    term = total = 1 / a
    n = a
    while term > total * 1e-16:
        n += 1
        term *= x / n
        total += term
    return min(1.0, total * exp(-x + a * log(x) - lgamma(a)))


def chi2_quantile(p: float, k: float) -> float:
    low, high = 0.0, 1000.0
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if chi2_below(middle, k) < p else (low, middle)
    return (low + high) / 2


def consistency(share: float) -> float:
    """Factor that makes the covariance of the nearest ``share`` of a normal sample agree with the whole."""
    return share / chi2_below(chi2_quantile(share, D), D + 2)


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the five counts of every text.

    Repeated windows: a window's place and 36 bits of its hash share one number, so a
    sort of numbers brings equal windows together. Only windows that meet another are
    then compared word by word, so hash collisions cannot change a count.
    """
    rows = columns(docs, ("doc_id", "lang", "source", "text")).withColumn("text", F.coalesce("text", F.lit("")))
    trimmed = r"btrim(text, ' \t\n\u000b\u000c\r')"
    rows = once(rows, "words", F.expr(f"CASE WHEN {trimmed} = '' THEN cast(array() AS array<string>) ELSE split({trimmed}, '{SPACE}+') END"))
    keys = F.expr(
        """CASE WHEN size(words) < 4 THEN cast(array() AS array<bigint>) ELSE sort_array(transform(sequence(0, size(words) - 3),
        i -> shiftleft(xxhash64(get(words, i), get(words, i + 1), get(words, i + 2)), 28) | cast(i AS bigint))) END"""
    )
    rows = once(rows, "keys", keys)
    met = F.expr(
        """filter(keys, (k, i) -> shiftrightunsigned(k, 28) = shiftrightunsigned(get(keys, i - 1), 28)
        OR shiftrightunsigned(k, 28) = shiftrightunsigned(get(keys, i + 1), 28))"""
    )
    rows = once(rows.withColumn("met", met).drop("keys"), "same", F.expr(
        """sort_array(transform(met, k -> transform(array(cast(k & 268435455 AS int)), i -> named_struct(
        'words', concat_ws(' ', get(words, i), get(words, i + 1), get(words, i + 2)), 'at', i))[0]))"""
    ))
    at = F.expr(
        """array_sort(transform(filter(same, (s, i) -> s.words = get(same, i - 1).words OR s.words = get(same, i + 1).words), s -> s.at))"""
    )
    covered = "aggregate(at, named_struct('last', -3, 'n', 0L), (s, p) -> named_struct('last', p, 'n', s.n + least(3, p - s.last)), s -> s.n)"
    lines = f"filter(split(text, '\\n'), l -> l RLIKE '{WORD}')"
    rows = once(once(rows, "at", at), "lines", F.expr(lines))
    return rows.select(
        "doc_id", "lang", "source",
        F.size("words").cast("long").alias("n_words"),
        F.expr("cast(length(array_join(words, '')) AS bigint)").alias("word_chars"),
        F.expr("cast(length(regexp_replace(text, '[^#*$%&|<>]+', '')) AS bigint)").alias("n_symbols"),
        F.expr("cast(size(lines) - size(array_distinct(lines)) AS bigint)").alias("n_dup_lines"),
        F.expr(covered).alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
    )


def base_failed() -> Column:
    return F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words")


def vector() -> list[Column]:
    """The statistics: logarithms of sizes, square roots of rates (which evens out their spread)."""
    share = lambda a, b: f"sqrt(cast({a} AS double) / greatest({b}, 1))"
    texts = ("ln(cast(1 + n_words AS double))", "ln(greatest(word_chars, 1) / cast(greatest(n_words, 1) AS double))",
             share("n_symbols", "word_chars"), share("n_dup_lines", "n_lines"), share("n_repeat_words", "n_words"))
    return [F.expr(t).alias(n) for t, n in zip(texts, NAMES, strict=True)]


def group_key(level: int) -> Column:
    """Text that names a (language, source), a language, or everything; nulls are values of their own."""
    parts = [F.lit(level).alias("level")] + [F.col(c) for c in ("lang", "source")[: 2 - level]]
    return F.to_json(F.struct(*parts))


def distance(row: str = "") -> Column:
    """Squared Mahalanobis distance of a row's vector under ``mean`` and ``inverse`` (flat upper triangle)."""
    terms = [
        f"{'' if i == j else '2 * '}inverse[{n}] * ({NAMES[i]} - mean[{i}]) * ({NAMES[j]} - mean[{j}])" for n, (i, j) in enumerate(PAIRS)
    ]
    return F.expr(" + ".join(terms))


def moments(rows: DataFrame, *keys: str, factor: float = 1.0) -> DataFrame:
    """Mean, inverse of the ridged covariance (times ``factor``) and log determinant of each group."""
    sums = [F.count("*").alias("n")] + [F.avg(n).alias(f"m{i}") for i, n in enumerate(NAMES)]
    # Values are logarithms and rates of size one to ten, so products lose no digits that matter.
    sums += [F.avg(F.col(NAMES[i]) * F.col(NAMES[j])).alias(f"p{i}{j}") for i, j in PAIRS]
    at = lambda i, j: f"p{min(i, j)}{max(i, j)} - m{i} * m{j}"
    cells = [f"{factor!r}D * ({at(i, j)})" + (f" + {RIDGE[i] ** 2!r}D" if i == j else "") for i in range(D) for j in range(D)]
    # Sweeping every pivot turns a matrix into its negative inverse; the pivots multiply to the determinant.
    swept = f"""aggregate(sequence(0, {D - 1}), named_struct('a', array({", ".join(cells)}), 'logdet', 0.0D),
      (s, k) -> transform(array(get(s.a, k * {D + 1})), d -> named_struct('a', transform(s.a, (v, c) -> CASE
          WHEN c = k * {D + 1} THEN -1 / d
          WHEN cast(floor(c / {D}) AS int) = k OR c % {D} = k THEN v / d
          ELSE v - get(s.a, cast(floor(c / {D}) AS int) * {D} + k) * get(s.a, k * {D} + c % {D}) / d END), 'logdet', s.logdet + ln(d)))[0])"""
    out = rows.groupBy(*keys).agg(*sums)
    out = once(out, "swept", F.expr(swept))
    inverse = F.array(*[F.expr(f"-swept.a[{i * D + j}]") for i, j in PAIRS])
    return out.select(*keys, "n", F.array(*[f"m{i}" for i in range(D)]).alias("mean"), inverse.alias("inverse"), F.col("swept.logdet").alias("logdet"))


def estimates(stage: Stage, vectors: DataFrame) -> DataFrame:
    """(group, n, mean, inverse) by minimum covariance determinant for every group of ``vectors`` (group, x0...)."""
    middle = [F.percentile_approx(n, F.array(*map(F.lit, (0.25, 0.5, 0.75))), 1000).alias(n) for n in NAMES]
    spread = vectors.groupBy("group").agg(*middle)
    precision = [
        f"1 / (pow(({NAMES[i]}[2] - {NAMES[i]}[0]) / 1.349, 2) + {RIDGE[i] ** 2!r}D)" if i == j else "0.0D" for i, j in PAIRS
    ]
    first = spread.select("group", F.lit(0).alias("start"), F.array(*[F.expr(f"{n}[1]") for n in NAMES]).alias("mean"),
                          F.expr(f"array({', '.join(precision)})").alias("inverse"))
    second = moments(vectors, "group").select("group", F.lit(1).alias("start"), "mean", "inverse")
    now = stage.store(first.union(second), "fit-0")
    for step in range(1, STEPS + 1):
        far = vectors.join(now, "group").withColumn("d2", distance()).drop("mean", "inverse", "logdet", "n")
        cut = far.groupBy("group", "start").agg(F.percentile_approx("d2", F.lit(SUBSET), 1000).alias("cut"))
        near = far.join(cut, ["group", "start"]).where("d2 <= cut")
        now = stage.store(moments(near, "group", "start", factor=consistency(SUBSET)), f"fit-{step}")
    best = now.groupBy("group").agg(F.min_by(F.struct("mean", "inverse"), F.struct("logdet", "start")).alias("b")).select("group", "b.*")
    inside = vectors.join(best, "group").where(distance() <= chi2_quantile(REWEIGHT, D))
    return moments(inside, "group", factor=consistency(REWEIGHT))


def judge(docs: DataFrame) -> DataFrame:
    """Per document: the counts, ``base_failed``, ``distance`` (null where nothing could be estimated) and ``kept``."""
    stage = Stage(docs.sparkSession, "quality")
    rows = measure(docs).select("doc_id", "lang", "source", *COUNTS, base_failed().alias("base_failed"), *vector())
    rows = stage.store(rows, "vectors")
    groups = F.explode(F.array(*[group_key(level) for level in range(3)])).alias("group")
    fitted = stage.store(estimates(stage, rows.where("NOT base_failed").select(groups, *NAMES)).where(F.col("n") >= LEAST_GROUP), "fitted")
    # The choice of level is per group, not per document.
    choice = rows.select("lang", "source").distinct().select(
        group_key(0).alias("own"), F.posexplode(F.array(*[group_key(level) for level in range(3)])).alias("level", "group")
    )
    chosen = (
        choice.join(fitted, "group")
        .groupBy("own").agg(F.min_by(F.struct("mean", "inverse"), "level").alias("f")).select("own", "f.*")
    )
    far = rows.withColumn("own", group_key(0)).join(chosen, "own", "left").withColumn("distance", distance())
    limit = chi2_quantile(REJECT, D)
    kept = ~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= limit)
    return far.select("doc_id", *COUNTS, "base_failed", kept.alias("kept"), "distance")
