import numpy as np
import pytest

from tallybook.llm import near_vectors as V
from tallybook.llm.common import table

SF = "/root/testdata/sf0.01"


def brute(rows, least=0.9):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    root = {i: i for i, _ in rows if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = dict.fromkeys(root, 0)
    for a, (i, x) in enumerate(good):
        for j, y in good[:a]:
            if len(x) == len(y) and x @ y >= least * np.linalg.norm(x) * np.linalg.norm(y) and i != j:
                links[i] += 1
                links[j] += 1
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    return sorted([(i, links.get(i, 0), None if i is None else find(i)) for i, _ in rows], key=repr)


def near(rng, center, spread, n):
    return [(center + rng.normal(size=len(center)) * spread).tolist() for _ in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(V, "BLOCK", 64)
    rng = np.random.default_rng(seed)
    vectors = [None, [], [0.0] * 16, [float("nan")] * 16, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, [1.0, 2.0], [2.0, 4.0], [-0.0] * 15 + [1.0], [0.0] * 15 + [2.0]]
    for spread in (0.05, 0.2, 0.4, 1.0):
        vectors += near(rng, rng.normal(size=16), spread, 120)
    vectors += [vectors[20]] * 90 + [vectors[200]] * 3
    rows = [(i * 3 - 40, v) for i, v in enumerate(vectors)] + [(None, vectors[20])]
    df = spark.createDataFrame([(*r, 5, "x") for r in rows], "vec_id long, embedding array<double>, label int, digest string")
    got = sorted([(r.vec_id, r.n_links, r.component_id) for r in V.group_vectors(df).collect()], key=repr)
    assert got == brute(rows)


def test_whole_table(spark):
    df = table(spark, SF, "embeddings")
    rows = [(r.vec_id, list(r.embedding)) for r in df.collect()]
    got = V.group_vectors(df).collect()
    assert sorted([(r.vec_id, r.n_links, r.component_id) for r in got], key=repr) == brute(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    assert V.group_vectors(df.limit(0)).count() == 0


def test_recall_and_widening():
    rng = np.random.default_rng(4)
    centers = rng.normal(size=(60, 32))
    x = np.vstack([near(rng, centers[rng.integers(60)], rng.choice([0.1, 0.25, 0.6]), 1) for _ in range(2500)] + [near(rng, centers[0], 0.02, 900)])
    x = V.unit(x)
    g = V.Graph.build(x)
    assert len(g.layers) > 1
    g.audit(0.9)
    truth = x @ x.T >= 0.9
    q, r = g.within(x, 0.9)
    assert len(set(zip(q.tolist(), r.tolist(), strict=True))) == len(q)
    assert truth[q, r].all() and len(q) >= 0.995 * truth.sum()
    # The group of 900 is far wider than any first beam.
    assert np.bincount(q, minlength=len(x))[-900:].min() >= 890


def test_bounded_slices_of_a_large_group(monkeypatch):
    """A block inside a large group is verified in bounded slices, and its forest connects what all pairs connect."""
    rng = np.random.default_rng(6)
    x = np.vstack([near(rng, rng.normal(size=16), 0.02, 3000), near(rng, rng.normal(size=16), 0.02, 40), rng.normal(size=(500, 16))])
    monkeypatch.setattr(V, "PAIRS", 1 << 12)
    monkeypatch.setattr(V, "MEETINGS", 1 << 16)
    g = V.Graph.build(V.unit(x))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    tree, links = V.Forest(len(x)), []
    for block in (np.arange(0, 3040, 12), np.arange(3000, 3100)):
        count = np.zeros(len(block), int)
        tree.ask(len(block))
        for q, r in V.partners(g, x[block], x, 0.9):
            assert len(q) <= 1 << 12
            count += np.bincount(q, minlength=len(block))
            new = tree.join(q, r)
            links += zip(block[q[new]].tolist(), r[new].tolist(), strict=True)
        assert (count == (unit[block] @ unit.T >= 0.9).sum(1)).all()
        # A query joins its own row, or one that is joined with it.
        assert (tree.root[len(x) :] == tree.root[block]).all()
    assert len(links) < len(x) + 400
    assert len(set(tree.root[:3000].tolist())) == 1 and len(set(tree.root[3000:3040].tolist())) == 1 and tree.root[0] != tree.root[3000]
    assert max(len(q) for q, _ in g.slices(g.x[:256], 0.9)) <= 1 << 16


def test_audit_sees_small_groups_beside_a_large_one():
    """A graph that finds no link of small groups must not pass for all that a large group brings."""
    rng = np.random.default_rng(7)
    centers = rng.normal(size=(300, 32))
    x = V.unit(np.vstack([near(rng, centers[0], 0.02, 1500)] + [near(rng, c, 0.05, 2) for c in centers[1:]]))

    class Blind(V.Graph):
        def search(self, queries, beam):
            found, near = super().search(queries, beam)
            if beam >= 256:
                return found, near
            own = near >= 1 - 1e-6
            large = (near >= 0.9).all(1)[:, None]
            return np.where(own | large, found, -1), np.where(own | large, near, -3.0)

    g = V.Graph.build(x)
    blind = Blind(x, 64)
    blind.layers = g.layers
    blind.audit(0.9)
    assert blind.beam >= 256
    truth = x[1500:] @ x.T >= 0.9
    q, _ = blind.within(x[1500:], 0.9)
    assert len(q) >= 0.99 * truth.sum()


def shard(x, first, sizes, beam=None):
    g = V.Graph.build(V.unit(x))
    if beam:
        g.beam = beam
    else:
        g.audit(0.9)
    return V.Shard(g, np.arange(first, first + len(x)), sizes, x)


def linked(x, sizes):
    """Weights of all partners of each row, by brute force."""
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    close = unit @ unit.T >= 0.9
    np.fill_diagonal(close, False)
    return close, close @ sizes


@pytest.mark.parametrize("blind", [False, True])
def test_links_count_for_both_ends(monkeypatch, blind):
    """Rows of a large group, of small ones and copies; also where searches of one side miss what the other finds."""
    monkeypatch.setattr(V, "BLOCK", 200)
    rng = np.random.default_rng(8)
    large, centers = rng.normal(size=24), rng.normal(size=(60, 24))
    parts = [near(rng, large, 0.05, 500), near(rng, large, 0.45, 60)] + [near(rng, c, 0.15, 6) for c in centers]
    x = rng.permutation(np.vstack([*parts, rng.normal(size=(120, 24))]))
    sizes = rng.integers(1, 4, len(x))
    half = len(x) // 2
    one, two = shard(x[:half], 0, sizes[:half]), shard(x[half:], half, sizes[half:])
    if blind:
        plain = V.Graph.search

        def search(self, queries, beam):
            found, near_ = plain(self, queries, beam)
            if self is one.graph and beam < 256:
                few = ~(near_ >= 0.9).all(1)[:, None]
                found, near_ = np.where(few, -1, found), np.where(few, -3.0, near_)
            return found, near_

        monkeypatch.setattr(V.Graph, "search", search)
    numbers, links = V.meet(one, two, 0.9)
    close, _ = linked(x, sizes)
    want = np.concatenate([close[:half, half:] @ sizes[half:], close[half:, :half] @ sizes[:half]])
    got = np.zeros(len(x), int)
    got[numbers[0]] = numbers[1]
    assert (got == want).all()
    assert len(links.T) < len(x) and close[links[0], links[1]].all()
    if not blind:
        for s, at in ((one, slice(0, half)), (two, slice(half, None))):
            numbers, _ = V.meet(s, s, 0.9)
            got = np.zeros(len(x), int)
            got[numbers[0]] = numbers[1]
            assert (got[at] == close[at, at] @ sizes[at]).all()


def test_small_shards_are_searched_by_their_graph(monkeypatch):
    """Every query goes through the graph; only rows with more partners than the beam is wide see a whole shard."""
    rng = np.random.default_rng(9)
    x = np.vstack([near(rng, c, 0.1, 4) for c in rng.normal(size=(14, 32))] + [rng.normal(size=(6, 32))])
    s = shard(x, 0, np.ones(len(x), int))
    searched, plain = [], V.Graph.search
    monkeypatch.setattr(V.Graph, "search", lambda self, q, beam: searched.append(len(q)) or plain(self, q, beam))
    answers = list(s.graph.answers(s.graph.x, 0.9))
    assert sum(searched) == len(x) and not any(whole for *_, whole in answers)
    assert sum(len(q) for q, *_ in answers) == 14 * 16 + 6


def test_many_vectors_with_a_hot_group(spark):
    """A third of the rows in one group, small groups beside it; all shards are searched by their graphs."""
    rng = np.random.default_rng(10)
    centers = rng.normal(size=(800, 32))
    x = np.vstack([near(rng, centers[0], 0.05, 2000)] + [near(rng, c, 0.12, 4) for c in centers[1:]] + [rng.normal(size=(800, 32))]).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.permutation(x))], "vec_id long, embedding array<float>")
    rows = sorted(df.collect())
    close, number = linked(np.array([r.embedding for r in rows], float), np.ones(len(rows), int))
    got = {r.vec_id: r for r in V.group_vectors(df).collect()}
    assert all(got[i].n_links <= number[i] for i in range(len(rows)))
    assert sum(r.n_links for r in got.values()) % 2 == 0
    assert sum(r.n_links for r in got.values()) >= 0.9999 * number.sum()
    small = number < 100
    assert sum(got[i].n_links for i in np.flatnonzero(small)) >= 0.999 * number[small].sum()


def test_parts_apart_are_joined():
    """Groups larger than a row's links would link to themselves only: beams far below the shard must still reach all of them."""
    rng = np.random.default_rng(11)
    centers = rng.normal(size=(40, 32))
    x = V.unit(rng.permutation(np.vstack([near(rng, c, 0.02, 60) for c in centers] + [near(rng, centers[0], 0.02, 900)])))
    g = V.Graph.build(x)
    links = g.layers[0][1]
    assert V._connected(links, False).all() and V._connected(links, True).all()
    assert links.shape[1] <= 2 * V.DEGREE + 8
    g.audit(0.9)
    assert g.beam <= V.WIDE < len(x)
    q, _ = g.within(x, 0.9)
    assert len(q) >= 0.999 * (x @ x.T >= 0.9).sum()
