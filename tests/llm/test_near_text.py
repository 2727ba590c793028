import random

import numpy as np
import pytest

from tallybook.llm import near_text as N


def shingles(text):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    width = min(5, len(words))
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1))


def brute(rows):
    """Per row: set size and smallest doc_id reachable."""
    sets = [shingles(t) for _, t in rows]
    root = {d: d for d, _ in rows if d is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, _) in enumerate(rows):
        for j in range(i):
            b = rows[j][0]
            common = len(sets[i] & sets[j])
            if a is not None and b is not None and common and 100 * common >= 85 * (len(sets[i]) + len(sets[j]) - common):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [(d, len(s), None if d is None else find(d)) for (d, _), s in zip(rows, sets, strict=True)]


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
    return " ".join(words)


def corpus(seed):
    rng = random.Random(seed)
    texts = [None, "", " \t", "one", "one", "ONE", "É one", "é one", "a b c d", "a b c d e", "a  b\nc\x0bd e", "a b c d e f"]
    base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    texts += [edited(rng, base, rng.choice([0, 1, 1, 2, 3, 4, 5, 6, 9, 14])) for _ in range(140)]
    for n in (7, 8, 11, 12, 30, 400):
        base = [f"w{rng.randrange(10**6)}" for _ in range(n)]
        texts += [edited(rng, base, rng.choice([0, 1, n // 60, n // 40])) for _ in range(9)]
        texts += [" ".join(base[:-k]) for k in (1, 2, 3) if n > k]
    passage = " ".join(f"p{i}" for i in range(60))
    texts += [passage + " " + edited(rng, ["x"] * 40, 40) for _ in range(30)]
    texts += ["x " * 20_000, "x " * 9]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    return [(i - 20, t) for i, t in zip(ids, texts, strict=True)] + [(None, "one"), (None, texts[20]), (5, "one"), (ids[14] - 20, texts[14])]


@pytest.mark.parametrize("seed,block", [(1, 1024), (2, 16)])
def test_against_brute_force(spark, monkeypatch, seed, block):
    monkeypatch.setattr(N, "BLOCK", block)
    monkeypatch.setattr(N, "ROUNDS", 1 if block < 1024 else 2)
    rows = corpus(seed)
    df = spark.createDataFrame([(*r, "x", 3, "y") for r in rows], "doc_id long, text string, digest string, rep int, band string")
    got = sorted([(r.doc_id, r.n_shingles, r.component_id) for r in N.group_texts(df).collect()], key=repr)
    want = brute(rows)
    assert got == sorted(want, key=repr)
    assert len({c for _, _, c in want}) > 40


def test_one_document_of_each_group_stays(spark):
    rows = corpus(3)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = N.drop_near_copies(df)
    assert out.columns == df.columns
    want = sorted([d for d, _, c in brute(rows) if d == c], key=repr)
    assert sorted([r.doc_id for r in out.collect()], key=repr) == want


def test_empty(spark):
    df = spark.createDataFrame([(1, None)], "doc_id long, text string")
    assert [tuple(r) for r in N.group_texts(df).collect()] == [(1, 0, 1, True)]
    assert N.group_texts(df.limit(0)).count() == 0


def test_estimates_and_collisions():
    rng = np.random.default_rng(2)
    for share in (0.2, 0.6, 0.9):
        errors = []
        for _ in range(60):
            x = np.unique(rng.integers(2**64 - 1, size=3000, dtype=np.uint64))
            n = int(len(x) * 2 * share / (1 + share))
            y = np.unique(np.concatenate([x[rng.permutation(len(x))[:n]], rng.integers(2**64 - 1, size=len(x) - n, dtype=np.uint64)]))
            true = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
            a, b = N.registers(x)[None], N.registers(y)[None]
            errors.append(N.estimates(a, b, np.array([len(x)]), np.array([len(y)]))[0][0, 0] - true)
        assert abs(np.mean(errors)) < 0.02
    assert 0 < N.collision(5, 5) < 2e-3


def groups_of_rows(rows, threshold):
    """Brute force over rows: lists of the rows of each group, without those that stay in any case."""
    sets = [shingles(t) for _, t in rows]
    some = [i for i, (d, _) in enumerate(rows) if d is not None and sets[i]]
    root = {i: i for i in some}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in some:
        for j in some[: some.index(i)]:
            common = len(sets[i] & sets[j])
            if 100 * common >= threshold * (len(sets[i]) + len(sets[j]) - common):
                root[find(i)] = find(j)
    out = {}
    for i in some:
        out.setdefault(find(i), []).append(rows[i])
    return list(out.values())


@pytest.mark.parametrize("seed", [3, 4])
def test_pipeline_stage_drops_at_four_fifths(spark, seed):
    """Near copies at 0.80 to 0.85 go, repeated rows stay once, and a text stays though another of its doc_id goes."""
    import corpus_pipeline

    rng = random.Random(seed)
    rows = [r for r in corpus(seed) if r[0] is not None]
    words = [f"v{i}" for i in range(204)]  # 200 shingles; a changed word takes five of them
    rows += [(1000, " ".join(words)), (1001, edited(rng, words[:100] + ["c"] + words[101:150] + ["d"] + words[151:], 0))]
    rows += [(1001, "a text of its own that shares nothing with others"), (1002, " ".join(words[:170]))]
    rows += [(1000, " ".join(words)), (1003, ""), (1003, ""), (None, "one"), (None, "one")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, gone string")
    out = corpus_pipeline.near_copies(spark, df, "")
    assert out.columns == df.columns
    left = [(r.doc_id, r.text) for r in out.collect()]
    groups = groups_of_rows(rows, 80)
    assert len(groups) < len(groups_of_rows(rows, 85))
    for g in groups:
        low = min(d for d, _ in g)
        assert sum(r in g for r in left) == 1 and any(r in g and r[0] == low for r in left)
    assert sorted((r for r in left if r[0] is None or not shingles(r[1])), key=repr) == sorted((r for r in rows if r[0] is None or not shingles(r[1])), key=repr)


def test_bands_fit_the_threshold():
    for threshold in (0.6, 0.8, 0.85, 0.95):
        width = N.band_width(threshold)
        assert (1 - threshold**width) ** (N.BUCKETS // width) <= 1e-6
    assert N.band_width(0.85) == 5
