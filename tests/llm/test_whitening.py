import math
from fractions import Fraction

import numpy as np
import pytest

from tallybook.llm import whitening
from tallybook.llm.common import table

SF = "/root/testdata/sf0.001"
DDL = "vec_id long, embedding array<double>, label int, key string, x int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, "k", 1) for i, v in rows], DDL)


def plain(rows, weights="one"):
    """Everything by whole fractions but the eigenvectors, one row at a time."""
    kept = [(i, tuple(math.floor(64 * c) + 1_000_000 for c in v)) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fits = [x for _, x in kept] if weights == "copies" else sorted({x for _, x in kept})
    n = len(fits)
    sums = [sum(column) for column in zip(*fits)]
    centred = [[Fraction(n * a - s, n) for a, s in zip(x, sums)] for x in fits]
    v = np.array([[float(sum(r[i] * r[j] for r in centred) / n) for j in range(len(sums))] for i in range(len(sums))])
    deviation = {i: sum((n * a - s) ** 2 for a, s in zip(x, sums)) for i, x in kept}
    whole = {i: np.array([float(Fraction(n * a - s, n)) for a, s in zip(x, sums)]) for i, x in kept}
    e, u = np.linalg.eigh(v)
    return n, deviation, whole, e[::-1], u[:, ::-1], float(np.trace(v))


def compare(out, rows, weights="one", components=16):
    n, deviation, whole, e, u, trace = plain(rows, weights)
    width = min(components, int((e > 1e-12 * e[0]).sum()))
    assert sorted((r.vec_id, r.component) for r in out) == sorted((i, k + 1) for i in deviation for k in range(width))
    for k in range(width):
        mine = [r for r in out if r.component == k + 1]
        assert all(r.n == n and r.deviation == deviation[r.vec_id] for r in mine)
        assert all(abs(r.explained - e[k] / trace) <= 1e-9 * r.explained and r.identity_error <= 1e-6 for r in mine)
        got = np.array([r.whitened for r in mine])
        want = np.array([whole[r.vec_id] @ u[:, k] / math.sqrt(e[k]) for r in mine])
        sign = 1 if got @ want >= 0 else -1
        assert np.abs(got - sign * want).max() < 1e-6


def sample(rng, dims=5):
    rows = [(i, (rng.normal(size=dims) * np.arange(dims, 0, -1)).tolist()) for i in range(60)]
    rows += [(100 + i, list(rows[3][1])) for i in range(90)] + [(300, [c + 1e-9 for c in rows[5][1]])]
    return rows


@pytest.mark.parametrize("weights", ["one", "copies"])
def test_against_fractions(spark, weights):
    rows = sample(np.random.default_rng(1))
    odd = [(400, None), (401, [None] * 5), (402, [1.0, math.nan, 1.0, 1.0, 1.0]), (403, [1.0, math.inf, 1.0, 1.0, 1.0])]
    out = whitening.whiten(vectors(spark, rows + odd), weights=weights).collect()
    compare(out, rows, weights)


def test_equal_rows_have_equal_values_and_hot_ones_need_no_shuffle(spark):
    rows = sample(np.random.default_rng(2)) + [(1, [0.5] * 5), (1, [0.5] * 5), (None, [0.25] * 5)]
    out = whitening.whiten(vectors(spark, rows)).collect()
    assert len(out) == len(rows) * 5
    assert len({(r.whitened, r.deviation) for r in out if r.component == 1 and r.vec_id is not None and (r.vec_id == 3 or 100 <= r.vec_id < 200)}) == 1
    assert len([r for r in out if r.vec_id is None]) == 5 and len([r for r in out if r.vec_id == 1]) == 15


def test_fewer_components_and_flat_directions(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(a), float(b), float(a), 7.0]) for i, (a, b) in enumerate(rng.normal(size=(40, 2)) * 9)]
    compare(whitening.whiten(vectors(spark, rows)).collect(), rows)
    compare(whitening.whiten(vectors(spark, rows), components=1).collect(), rows, components=1)


def test_no_result(spark):
    assert whitening.whiten(vectors(spark, [])).collect() == []
    assert whitening.whiten(vectors(spark, [(1, None), (2, [])])).collect() == []
    assert whitening.whiten(vectors(spark, [(1, [0.5, 1.0]), (2, [0.5, 1.0])])).collect() == []


def test_other_lengths_and_far_entries(spark):
    rows = [(i, [float(i), float(i * i % 7)]) for i in range(20)]
    out = whitening.whiten(vectors(spark, rows + [(50, [1.0]), (51, [1.0, 2.0, 3.0]), (52, [])])).collect()
    compare(out, rows)
    far = rows + [(60, [1e300, -1e300])]
    assert len(whitening.whiten(vectors(spark, far)).collect()) in (21, 42)
    assert whitening.whitening_report(vectors(spark, far)).where("vec_id = 60 AND deviation IS NULL").count() >= 1


def test_offsets_and_squares_are_exact():
    x = np.array([[2**53, -(2**53)], [1_000_003, 999_990]], np.int64)
    n, sums = 10**9, (10**15 + 1, 10**15 - 7)
    off = whitening.offsets(x, n, sums)
    assert off.dtype == object and whitening.squares(off) == [sum((n * int(a) - s) ** 2 for a, s in zip(r, sums)) for r in x]
    near = whitening.offsets(x[1:], n, sums)
    assert near.dtype == np.int64 and whitening.squares(near) == [sum((n * int(a) - s) ** 2 for a, s in zip(x[1], sums))]


def test_wide_vectors_are_refused(spark, monkeypatch):
    monkeypatch.setattr(whitening, "LARGEST", 4)
    with pytest.raises(ValueError):
        whitening.whiten(vectors(spark, sample(np.random.default_rng(4))))


def test_whole_table(spark):
    table_rows = [(r.vec_id, r.embedding) for r in table(spark, SF, "embeddings").collect()][:150]
    compare(whitening.whiten(vectors(spark, [(i, list(map(float, v))) for i, v in table_rows])).collect(), table_rows)
