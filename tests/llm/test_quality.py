import random
import re
from collections import Counter

import numpy as np
import pytest

from tallybook.llm import quality as Q
from tallybook.llm.common import table

SF = "/root/testdata/sf0.001"

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    words = WORD.findall(text)
    lines = [line for line in text.split("\n") if WORD.search(line)]
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if often[g] > 1 for k in range(3)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


def brute_distances(x):
    """Minimum covariance determinant with exact quantiles."""

    def fit(rows, factor):
        return rows.mean(0), np.linalg.inv(factor * np.cov(rows.T, bias=True) + np.diag(np.square(Q.RIDGE)))

    def far(mean, inverse):
        return np.einsum("ni,ij,nj->n", x - mean, inverse, x - mean)

    low, middle, high = np.quantile(x, [0.25, 0.5, 0.75], axis=0, method="inverted_cdf")
    starts = [(middle, np.diag(1 / (((high - low) / 1.349) ** 2 + np.square(Q.RIDGE)))), fit(x, 1.0)]
    for _ in range(Q.STEPS):
        starts = [fit(x[(d := far(*s)) <= np.quantile(d, Q.SUBSET, method="inverted_cdf")], Q.consistency(Q.SUBSET)) for s in starts]
    best = max(starts, key=lambda s: np.linalg.det(s[1]))
    return far(*fit(x[far(*best) <= Q.chi2_quantile(Q.REWEIGHT, Q.D)], Q.consistency(Q.REWEIGHT)))


def made(n, rng):
    return [" ".join(rng.choice(WORDS) for _ in range(rng.randint(60, 300))) for _ in range(n)]


WORDS = ["".join(random.Random(i).choices("abcdefgh", k=2 + i % 7)) for i in range(400)]


def test_counts_against_brute_force(documents):
    rng = random.Random(3)
    texts = [None, "", " \t\n", "a b c", "a b c a b c", "x x x x x", "é b c\x0bd\x0cf", "of of of of", "a\na\n\n\na b\n"]
    texts += [" ".join(rng.choice("ab") for _ in range(n)) for n in range(3, 40)]
    texts += ["".join(rng.choice("ab #*\n\t\x0cé🙂") for _ in range(200)) for _ in range(40)]
    texts += ["w%d " % 7 * 30_000, " ".join(f"w{i}" for i in range(40_000))] + texts[:3]
    for r in Q.judge(documents(texts)).collect():
        want = counts(texts[r.doc_id] or "")
        assert tuple(r[c] for c in Q.COUNTS) == want
        failed = want[0] < 50 or 100 * want[4] > 50 * want[0]
        assert r.base_failed == failed and not (failed and r.kept)


def test_distances_against_brute_force(documents):
    rng = random.Random(8)
    texts = made(600, rng) + ["$$$ ".join(made(1, rng)[0].split()) for _ in range(20)]
    got = {r.doc_id: r for r in Q.judge(documents(texts)).collect()}
    c = np.array([counts(t) for t in texts], float)
    lines = np.array([len([x for x in t.split("\n") if x.strip()]) for t in texts])
    x = np.column_stack([np.log1p(c[:, 0]), np.log(c[:, 1] / c[:, 0]), np.sqrt(c[:, 2] / c[:, 1]), np.sqrt(c[:, 3] / lines), np.sqrt(c[:, 4] / c[:, 0])])
    want = brute_distances(x)
    have = np.array([got[i].distance for i in range(len(texts))])
    np.testing.assert_allclose(have, want, rtol=0.05, atol=0.2)
    assert [got[i].kept for i in range(len(texts))] == list(want <= Q.chi2_quantile(Q.REJECT, Q.D))
    assert not any(got[i].kept for i in range(600, 620)) and all(got[i].kept for i in range(600))


def test_small_groups_use_wider_estimates(documents):
    rng = random.Random(9)
    texts = made(300, rng)
    langs = ["en"] * 200 + [None] * 90 + ["xx"] * 10
    sources = [f"s{i % 3}" for i in range(299)] + [None]
    rows = Q.judge(documents(texts, langs, sources)).collect()
    assert len(rows) == 300 and all(r.distance is not None and r.kept for r in rows)
    few = Q.judge(documents(texts[:20])).collect()
    assert all(r.distance is None and r.kept for r in few)
    assert Q.judge(documents(["a"]).limit(0)).count() == 0


def test_chi_square():
    assert Q.chi2_quantile(0.95, 5) == pytest.approx(11.0705, abs=1e-3)
    assert Q.chi2_below(3.357, 3) == pytest.approx(0.66, abs=1e-3)


def test_plan_has_no_python(spark):
    plan = Q.judge(table(spark, SF, "documents"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
