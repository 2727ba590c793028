"""Near-duplicate vectors by hierarchical navigable small-world graphs, one per shard.

Equal vectors form a class with one representative. Representatives are dealt over shards
by hash (``SHARDS`` at least, more where a shard would pass ``SHARD_ROWS``); a task builds
each shard's graph. Every representative queries every shard, in blocks: a task holds two
shards and asks each with the rows of the other, or one shard and asks it with its own
rows. A beam that ends full of links is widened, up to ``WIDE`` and then to the whole
shard, so no number of partners is cut off. Before that, an audit compares the shard's
answers to sets of its own vectors with brute force and widens the beam of all queries
until the mean recall of a vector, hits on itself left out, reaches ``RECALL``: among
vectors with fewer partners than the beam is wide, of which it draws up to ``AUDIT``, and
among the others. Links are verified by cosine in double precision, a bounded slice of
pairs at a time. A link found from either end counts for both. Tasks put out each row's
number of partners (copies included) and a spanning forest of the links that they found,
not all pairs; the forests are united to components.

Null vectors, and those with null or non-finite components or of length zero, link with
nothing; nor do rows without vec_id. Vectors of different dimension never link. Rows that
repeat a vector are copies and linked with each other; rows that share a vec_id count as
one node. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stage, columns, components, ready

SHARDS = 8
SHARD_ROWS = 50_000
BLOCK = 512
DEGREE = 16
BEAM = 64  # first width; a quarter of a shard that has fewer than four times as many rows
NARROW = 8
WIDE = 256  # a beam that is still full here costs more than the whole shard
BUILD = 48
AUDIT = 128
DRAWS = 8192  # vectors of a shard among which the audit looks for some with few partners
RECALL = 0.999
PAIRS = 1 << 16  # pairs that are verified at once
MEETINGS = 1 << 22  # similarities that a widened search holds at once
LOOSE = 1e-5  # what single precision may hide


def unit(x: np.ndarray) -> np.ndarray:
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def diverse(x: np.ndarray, own: np.ndarray, found: np.ndarray, near: np.ndarray, keep: int) -> np.ndarray:
    """Of candidates in descending similarity, those nearer to ``own`` than to any kept one; the best others fill up.

    ``found`` (rows, candidates) has -1 where there is none; the result has ``keep`` columns.
    """
    out = np.full((len(found), keep), -1, np.int32)
    step = max(1, (1 << 21) // max(1, found.shape[1] ** 2))
    for i in range(0, len(found), step):
        f, s = found[i : i + step], near[i : i + step]
        v = x[f]
        between = np.matmul(v, v.transpose(0, 2, 1))
        kept = np.zeros(f.shape, bool)
        for j in range(f.shape[1]):
            close = np.where(kept, between[:, :, j], -2.0).max(1)
            kept[:, j] = (f[:, j] >= 0) & (s[:, j] > close) & (kept.sum(1) < keep)
        rank = np.argsort(np.where(kept, 0, np.where(f >= 0, 1, 2)), axis=1, kind="stable")[:, :keep]
        out[i : i + step, : rank.shape[1]] = np.take_along_axis(f, rank, 1)
    return out


def _connected(links: np.ndarray, to_first: bool) -> np.ndarray:
    """Rows that have a way to row 0, or to which row 0 has one."""
    seen = np.zeros(len(links), bool)
    seen[:1] = True
    new = np.flatnonzero(seen)
    while len(new):
        if to_first:
            new = np.flatnonzero(~seen & (seen[links] & (links >= 0)).any(1))
        else:
            next_ = np.unique(links[new])
            new = next_[(next_ >= 0) & ~seen[next_]]
        seen[new] = True
    return seen


def _parts(links: np.ndarray, without: np.ndarray) -> np.ndarray:
    """The smallest row that each row is connected with, in either direction and only over rows not in ``without``."""
    source, target = np.repeat(np.arange(len(links)), links.shape[1]), links.ravel()
    use = (target >= 0) & ~without[source] & ~without[target]
    source, target = source[use], target[use]
    label = np.arange(len(links))
    while True:
        low = label.copy()
        np.minimum.at(low, source, label[target])
        np.minimum.at(low, target, label[source])
        low = low[low]
        if (low == label).all():
            return label
        label = low


def _widened(links: np.ndarray, source: np.ndarray, target: np.ndarray, most: int = 4) -> np.ndarray:
    """``links`` with the new ones, at most so many of a source; rows are as wide as the fullest needs."""
    order = np.argsort(source, kind="stable")
    source, target = source[order], target[order]
    _, first, count = np.unique(source, return_index=True, return_counts=True)
    place = np.arange(len(source)) - np.repeat(first, count)
    fits = place < most
    more = np.full((len(links), most), -1, np.int32)
    more[source[fits], place[fits]] = target[fits]
    out = np.hstack([links, more])
    out = np.take_along_axis(out, np.argsort(out < 0, axis=1, kind="stable"), 1)
    return np.ascontiguousarray(out[:, : max(links.shape[1], int((out >= 0).sum(1).max()))])


class Graph:
    """Layered graphs over the rows of ``x`` (of unit length): layer 0 has all rows, each higher one a sixteenth."""

    def __init__(self, x: np.ndarray, beam: int | None = None):
        self.x, self.beam = x, beam or min(BEAM, max(NARROW, len(x) // 4))
        self.layers: list[tuple[np.ndarray, np.ndarray]] = []  # nodes, neighbours (as rows of x)

    @classmethod
    def build(cls, x: np.ndarray) -> Graph:
        out = cls(x)
        rng = np.random.default_rng(len(x))
        height = np.floor(-np.log(np.maximum(rng.random(len(x)), 1e-12)) / np.log(DEGREE)).astype(int)
        above = []
        for level in range(1, int(height.max(initial=0)) + 1):
            nodes = np.flatnonzero(height >= level).astype(np.int32)
            if len(nodes) < 2:
                break
            above.append((nodes, out._exact(nodes, DEGREE)))
        # Nodes of the upper layers come first, so that the ground layer grows from its hubs.
        order = np.argsort(-height, kind="stable").astype(np.int32)
        links = np.full((len(x), 2 * DEGREE), -1, np.int32)
        first = order[: min(len(order), 1024)]
        links[first] = out._exact(first, 2 * DEGREE)
        out.layers = [(np.arange(len(x), dtype=np.int32), links), *above]
        out._link_back(first, 2 * DEGREE)
        done = len(first)
        while done < len(order):
            new = order[done : done + min(done, 4096)]
            out._insert(new)
            done += len(new)
        out._join_parts()
        return out

    def _exact(self, nodes: np.ndarray, degree: int) -> np.ndarray:
        """Diverse neighbours of each of ``nodes`` among them, from all similarities."""
        k = min(len(nodes) - 1, BUILD)
        if k < 1:
            return np.full((len(nodes), degree), -1, np.int32)
        out = []
        for i in range(0, len(nodes), 512):
            s = self.x[nodes[i : i + 512]] @ self.x[nodes].T
            s[np.arange(len(s)), np.arange(i, i + len(s))] = -2
            best = np.argpartition(-s, k - 1, axis=1)[:, :k]
            near = np.take_along_axis(s, best, 1)
            rank = np.argsort(-near, axis=1)
            out.append(diverse(self.x, nodes[i : i + 512], nodes[np.take_along_axis(best, rank, 1)], np.take_along_axis(near, rank, 1), degree))
        return np.concatenate(out)

    def _insert(self, new: np.ndarray) -> None:
        """Link a batch of rows to what the beam finds and to each other, and back."""
        links = self.layers[0][1]
        for i in range(0, len(new), BLOCK):
            part = new[i : i + BLOCK]
            found, near = self.search(self.x[part], BUILD)
            among = self.x[part] @ self.x[new].T
            among[np.arange(len(part)), np.arange(i, i + len(part))] = -2
            k = min(len(new) - 1, BUILD // 2)
            if k > 0:
                best = np.argpartition(-among, k - 1, axis=1)[:, :k]
                found = np.hstack([found, new[best]])
                near = np.hstack([near, np.take_along_axis(among, best, 1)])
            # A row of this batch that an earlier block has linked back may show up twice.
            rank = np.lexsort((found, -near))
            found, near = np.take_along_axis(found, rank, 1), np.take_along_axis(near, rank, 1)
            again = np.zeros(found.shape, bool)
            again[:, 1:] = found[:, 1:] == found[:, :-1]
            bad = again | (found == part[:, None]) | (found < 0)
            rank = np.argsort(bad, axis=1, kind="stable")[:, :BUILD]
            found, near = np.where(np.take_along_axis(bad, rank, 1), -1, np.take_along_axis(found, rank, 1)), np.take_along_axis(near, rank, 1)
            links[part, :DEGREE] = diverse(self.x, part, found, near, DEGREE)
        self._link_back(new, DEGREE)

    def _link_back(self, new: np.ndarray, degree: int) -> None:
        """Offer ``new`` to the rows that they link to, which keep diverse ones of what they have and are offered."""
        links = self.layers[0][1]
        source = np.repeat(new, degree)
        target = links[new, :degree].ravel()
        source, target = source[target >= 0], target[target >= 0]
        near = np.einsum("ij,ij->i", self.x[source], self.x[target])
        order = np.lexsort((-near, target))
        source, target = source[order], target[order]
        nodes, first, count = np.unique(target, return_index=True, return_counts=True)
        place = np.arange(len(target)) - np.repeat(first, count)
        width = 2 * DEGREE
        inside = place < width
        incoming = np.full((len(nodes), width), -1, np.int32)
        incoming[np.repeat(np.arange(len(nodes)), count)[inside], place[inside]] = source[inside]
        for i in range(0, len(nodes), 2048):
            own = nodes[i : i + 2048]
            have = links[own]
            fresh = incoming[i : i + 2048]
            fresh = np.where((fresh[:, :, None] == have[:, None, :]).any(2), -1, fresh)
            both = np.hstack([have, fresh])
            s = np.where(both >= 0, np.einsum("ijk,ik->ij", self.x[both], self.x[own]), -2)
            rank = np.argsort(-s, axis=1)
            links[own] = diverse(self.x, own, np.take_along_axis(both, rank, 1), np.take_along_axis(s, rank, 1), width)

    def _join_parts(self) -> None:
        """Give every row a way to every other on the ground: groups of near rows else link to themselves only.

        Each part that a walk from the first row leaves out (then: that has no way to it)
        gets a link from (to) the row outside that is most similar to one of its rows.
        """
        nodes, links = self.layers[0]
        for to_first in (False, True):
            while not (inside := _connected(links, to_first)).all():
                out, rest = np.flatnonzero(~inside), np.flatnonzero(inside)
                best, near = np.empty(len(out), np.int64), np.empty(len(out), np.float32)
                step = max(1, MEETINGS // len(rest))
                for i in range(0, len(out), step):
                    s = self.x[out[i : i + step]] @ self.x[rest].T
                    best[i : i + step], near[i : i + step] = rest[s.argmax(1)], s.max(1)
                part = _parts(links, inside)[out]
                order = np.lexsort((-near, part))
                pick = order[np.unique(part[order], return_index=True)[1]]
                source, target = (out[pick], best[pick]) if to_first else (best[pick], out[pick])
                links = _widened(links, source, target)
        self.layers[0] = nodes, links

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(rows, similarities), best first, -1 where fewer were found: down the layers, then a beam on the ground."""
        top, links = self.layers[-1] if len(self.layers) > 1 else (self.layers[0][0][:0], None)
        if len(top):
            s = queries @ self.x[top].T
            start = top[s.argmax(1)][:, None]
        else:
            hubs = np.flatnonzero(self.layers[0][1][:, 0] >= 0)[:64] if len(self.x) > 1 else np.zeros(1, int)
            hubs = hubs if len(hubs) else np.zeros(1, int)
            start = hubs[(queries @ self.x[hubs].T).argmax(1)][:, None]
        for nodes, links in self.layers[-2:0:-1]:
            row = np.full(len(self.x), -1, np.int32)
            row[nodes] = np.arange(len(nodes))
            start = self._beam(queries, start, 4, links, row)[0][:, :1]
        return self._beam(queries, start, beam, self.layers[0][1], None)

    def _beam(self, queries: np.ndarray, start: np.ndarray, beam: int, links: np.ndarray, row: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """All queries step together: each opens its best unopened rows until its beam holds none."""
        n, at_once = len(queries), 4
        found = np.full((n, beam), -1, np.int32)
        near = np.full((n, beam), -3.0, np.float32)
        opened = np.ones((n, beam), bool)
        seen = np.zeros((n, len(self.x)), bool)
        found[:, : start.shape[1]] = start
        near[:, : start.shape[1]] = np.einsum("ijk,ik->ij", self.x[start], queries)
        opened[:, : start.shape[1]] = False
        seen[np.arange(n)[:, None], start] = True
        live = np.arange(n)
        while len(live):
            rank = np.where(opened[live], -9.0, near[live])
            k = min(at_once, beam)
            pick = np.argpartition(-rank, k - 1, axis=1)[:, :k] if k < beam else np.tile(np.arange(beam), (len(live), 1))
            ok = np.take_along_axis(rank, pick, 1) > -9
            go = ok.any(1)
            live, pick, ok = live[go], pick[go], ok[go]
            if not len(live):
                break
            opened[live[:, None], pick] = True
            nodes = found[live[:, None], pick]
            new = []
            for j in range(k):
                own = nodes[:, j]
                next_ = links[own if row is None else row[own]]
                fresh = (next_ >= 0) & ok[:, j, None]
                fresh &= ~seen[live[:, None], next_]
                a, b = np.nonzero(fresh)
                seen[live[a], next_[a, b]] = True
                new.append(np.where(fresh, next_, -1))
            new = np.hstack(new)
            # Most of what is met has been seen: only as many columns are compared as the fullest row has.
            order = np.argsort(new < 0, axis=1, kind="stable")[:, : max(1, int((new >= 0).sum(1).max()))]
            new = np.take_along_axis(new, order, 1)
            s = np.where(new >= 0, np.einsum("ijk,ik->ij", self.x[new], queries[live]), -3.0).astype(np.float32)
            all_found, all_near = np.hstack([found[live], new]), np.hstack([near[live], s])
            all_opened = np.hstack([opened[live], new < 0])
            best = np.argpartition(-all_near, beam - 1, axis=1)[:, :beam]
            found[live], near[live], opened[live] = (np.take_along_axis(t, best, 1) for t in (all_found, all_near, all_opened))
        rank = np.argsort(-near, axis=1)
        return np.take_along_axis(found, rank, 1), np.take_along_axis(near, rank, 1)

    def within(self, queries: np.ndarray, least: float, beam: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(query, row) of all found rows with a similarity of ``least``."""
        found = list(self.slices(queries, least, beam))
        if not found:
            return np.empty(0, int), np.empty(0, int)
        return tuple(np.concatenate(c) for c in zip(*found, strict=True))

    def slices(self, queries: np.ndarray, least: float, beam: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """What ``within`` has, a few queries at a time."""
        for q, r, _ in self.answers(queries, least, beam):
            yield q, r

    def answers(self, queries: np.ndarray, least: float, beam: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
        """(query, row, whether these queries saw the whole shard); full beams are widened up to the whole shard."""
        beam = beam or self.beam
        left = np.arange(len(queries))
        while len(left):
            if beam >= len(self.x):
                step = max(1, min(BLOCK, MEETINGS // len(self.x)))
                for i in range(0, len(left), step):
                    q, r = np.nonzero(queries[left[i : i + step]] @ self.x.T >= least)
                    yield left[i + q], r, True
                return
            again = []
            step = max(1, min(BLOCK, (1 << 25) // len(self.x), MEETINGS // beam))
            for i in range(0, len(left), step):
                part = left[i : i + step]
                found, near = self.search(queries[part], beam)
                full = near[:, -1] >= least
                again.append(part[full])
                q, k = np.nonzero((near >= least) & ~full[:, None])
                yield part[q], found[q, k], False
            left, beam = np.concatenate(again), 4 * beam if 4 * beam <= WIDE else len(self.x)

    def audit(self, least: float) -> None:
        """Widen the beam until the answers to own rows agree with brute force, for rows of few partners and of many."""
        few, many = self._audited(least)
        while self.beam < len(self.x) and min(self._recall(*few, least), self._recall(*many, least)) < RECALL:
            self.beam *= 2

    def _audited(self, least: float) -> list[tuple[np.ndarray, np.ndarray]]:
        """Rows with fewer partners than the beam is wide and rows with more, up to ``AUDIT`` of each, and their partners' number."""
        order = np.random.default_rng(len(self.x)).permutation(len(self.x))[:DRAWS]
        drawn, number, enough = [], [], 0
        for i in range(0, len(order), AUDIT):
            part = order[i : i + AUDIT]
            partners = (self.x[part] @ self.x.T >= least).sum(1) - 1
            drawn.append(part)
            number.append(partners)
            enough += int(((partners > 0) & (partners < self.beam)).sum())
            if enough >= AUDIT:
                break
        rows, partners = np.concatenate([*drawn, order[:0]]), np.concatenate([*number, order[:0]])
        kinds = [np.flatnonzero((partners > 0) & (partners < self.beam))[:AUDIT], np.flatnonzero(partners >= self.beam)[:AUDIT]]
        return [(rows[k], partners[k]) for k in kinds]

    def _recall(self, rows: np.ndarray, partners: np.ndarray, least: float) -> float:
        """Mean share of their partners that ``rows`` find."""
        if not len(rows):
            return 1.0
        found = np.zeros(len(rows), int)
        for q, r in self.slices(self.x[rows], least):
            found += np.bincount(q[r != rows[q]], minlength=len(rows))
        return float((found / partners).mean())


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes of the doubles of every vector that can link, and their digest."""
    for b in batches:
        vectors, digests, dims = [], [], []
        for v in b.column("embedding").to_pylist():
            data = None
            if v and None not in v:
                x = np.array(v, np.float64) + 0.0  # no negative zeros
                if np.isfinite(x).all() and x.any():
                    data = x.tobytes()
            vectors.append(data)
            digests.append(None if data is None else xxhash.xxh3_128_hexdigest(data))
            dims.append(0 if data is None else len(v))
        yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(dims, pa.int32()), pa.array(digests, pa.string()), pa.array(vectors, pa.binary())], ["vec_id", "dim", "digest", "vector"])


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, list[dict]]]:
    """The rows of each key; a key's rows follow each other."""
    held: list[dict] = []
    key = None
    for b in batches:
        for r in b.to_pylist():
            if held and key != tuple(r[k] for k in keys):
                yield key, held
                held = []
            key = tuple(r[k] for k in keys)
            held.append(r)
    if held:
        yield key, held


def _indexed(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (dim, shard), rows in grouped(batches, ["dim", "shard"]):
            x = np.frombuffer(b"".join(r["vector"] for r in rows), np.float64).reshape(len(rows), dim)
            g = Graph.build(unit(x))
            g.audit(least)
            parts = [np.array([g.beam, len(rows), len(g.layers)], "<i8").tobytes(), np.array([r["rep"] for r in rows], "<i8").tobytes(), np.array([r["n"] for r in rows], "<i8").tobytes(), x.tobytes()]
            for nodes, links in g.layers:
                parts += [np.array(links.shape, "<i8").tobytes(), nodes.tobytes(), links.tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([shard], pa.int64()), pa.array([zlib.compress(b"".join(parts), 1)], pa.binary())], ["dim", "shard", "graph"])

    return run


class Shard(NamedTuple):
    graph: Graph
    ids: np.ndarray
    sizes: np.ndarray  # copies of each vector, itself included
    x: np.ndarray


def loaded(blob: bytes, dim: int) -> Shard:
    data, at = zlib.decompress(blob), 0

    def take(kind: str, *shape: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(data, kind, int(np.prod(shape)), at).reshape(shape)
        at += out.nbytes
        return out

    beam, n, layers = take("<i8", 3).tolist()
    ids, sizes, x = take("<i8", n), take("<i8", n), take("<f8", n, dim)
    g = Graph(unit(x), beam)
    for _ in range(layers):
        rows, width = take("<i8", 2).tolist()
        g.layers.append((take("<i4", rows), take("<i4", rows, width)))
    return Shard(g, ids, sizes, x)


class Forest:
    """Links that connect whatever all links connect. A shard's rows stay, the queries of a block come and go."""

    def __init__(self, n: int):
        self.n, self.root = n, np.arange(n)  # the smallest row that a row is joined with

    def ask(self, n: int) -> None:
        self.root = np.concatenate([self.root[: self.n], np.arange(self.n, self.n + n)])

    def join(self, q: np.ndarray, r: np.ndarray) -> np.ndarray:
        """Indexes of the links (query, row) that join what was apart."""
        a, b = self.root[self.n + q], self.root[r]
        apart = np.flatnonzero(a != b)
        if not len(apart):
            return apart
        low, high = np.minimum(a, b)[apart], np.maximum(a, b)[apart]
        first = np.unique(low * len(self.root) + high, return_index=True)[1]
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            while (p := parent.setdefault(x, x)) != x:
                parent[x] = x = parent.setdefault(p, p)
            return x

        kept = []
        for i, x, y in zip(apart[first].tolist(), low[first].tolist(), high[first].tolist(), strict=True):
            x, y = find(x), find(y)
            if x != y:
                parent[max(x, y)] = min(x, y)
                kept.append(i)
        to = np.arange(len(self.root))
        touched = list(parent)
        to[touched] = [find(x) for x in touched]
        self.root = to[self.root]
        return np.array(kept, int)


def partners(g: Graph, queries: np.ndarray, x: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Verified (query, row), at most ``PAIRS`` at a time."""
    for q, r, _ in verified(g, queries, x, least):
        yield q, r


def verified(g: Graph, queries: np.ndarray, x: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """What ``partners`` has, and whether the queries saw the whole shard."""
    lengths, own = np.linalg.norm(x, axis=1), np.linalg.norm(queries, axis=1)
    for i, j, whole in g.answers(unit(queries), least - LOOSE):
        for at in range(0, len(i), PAIRS):
            q, r = i[at : at + PAIRS], j[at : at + PAIRS]
            good = np.einsum("ij,ij->i", queries[q], x[r]) / (own[q] * lengths[r]) >= least
            yield q[good], r[good], whole


def weighed(rows: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(rows, weights, n).astype(np.int64)


def meet(one: Shard, two: Shard, least: float) -> tuple[np.ndarray, np.ndarray]:
    """((id, partners), links of a forest) between two shards, or within one if both are the same.

    A link counts for both of its rows whichever of them found it. Rows that saw the whole
    other shard count their partners themselves and add themselves to their partners'
    number. Other rows have fewer partners than a beam is wide; their links are held until
    both sides have searched, and repeated ones count once.
    """
    same, n, m = one is two, len(one.ids), len(two.ids)
    tree, links = Forest(m), [np.empty((2, 0), np.int64)]
    tree.ask(n)
    shards = [one] if same else [one, two]
    if same:
        tree.join(np.arange(n), np.arange(n))
    saw = [np.zeros(len(s.ids), bool) for s in shards]
    counted, added = ([np.zeros(len(s.ids), np.int64) for s in shards] for _ in range(2))
    held = [np.empty(0, np.int64)]
    for side, own in enumerate(shards):
        across = len(shards) - 1 - side
        other = shards[across]
        for at in range(0, len(own.ids), BLOCK):
            for q, r, whole in verified(other.graph, own.x[at : at + BLOCK], other.x, least):
                q = q + at
                apart = own.ids[q] != other.ids[r]
                q, r = q[apart], r[apart]
                i, j = (r, q) if side else (q, r)
                new = tree.join(i, j)
                links.append(np.stack([one.ids[i[new]], two.ids[j[new]]]))
                if whole:
                    saw[side][q] = True
                    counted[side] += weighed(q, other.sizes[r], len(own.ids))
                    added[across] += weighed(r, own.sizes[q], len(other.ids))
                else:
                    held.append(i * np.int64(m) + j)
                    if same:
                        held.append(j * np.int64(m) + i)
    ends = np.divmod(np.unique(np.concatenate(held)), m)
    numbers = []
    for side, own in enumerate(shards):
        across = len(shards) - 1 - side
        rows, others = ends[side], ends[1 - side]
        unseen = ~saw[across][others]
        total = np.where(saw[side], counted[side], added[side] + weighed(rows[unseen], shards[across].sizes[others[unseen]], len(own.ids)))
        numbers.append(np.stack([own.ids, total])[:, total > 0])
    return np.concatenate(numbers, axis=1), np.concatenate(links, axis=1)


def _met(least: float):
    """Numbers of partners (kind 0) and links of forests (kind 1). A pair of shards follows each other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first: tuple[tuple, Shard] | None = None
        for b in batches:
            for r in b.to_pylist():
                key, own = (r["dim"], r["one"], r["two"]), loaded(r["graph"], r["dim"])
                if r["one"] == r["two"]:
                    pair = own, own
                elif first and first[0] == key:
                    pair = first[1], own
                else:
                    first = key, own
                    continue
                first = None
                numbers, links = meet(*pair, least)
                kinds = np.repeat(np.array([0, 1], np.int32), [numbers.shape[1], links.shape[1]])
                a, b_ = np.concatenate([numbers, links], axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(a), pa.array(b_)], ["kind", "a", "b"])

    return run


def group_vectors(vectors: DataFrame, least: float = 0.9) -> DataFrame:
    """Per row: vec_id, n_links, component_id and kept."""
    spark = ready(vectors.sparkSession)
    stage = Stage(spark, "vectors")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = columns(vectors, ("vec_id", "embedding")).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    rows = stage.store(rows.mapInArrow(_parsed, "vec_id long, dim int, digest string, vector binary"), "rows")
    good = rows.where("digest IS NOT NULL AND vec_id IS NOT NULL")
    classes = stage.store(good.groupBy("digest").agg(F.min("vec_id").alias("rep"), F.countDistinct("vec_id").alias("n")), "classes")
    reps = stage.store(
        good.join(classes, "digest").where("vec_id = rep").dropDuplicates(["digest"]).select("rep", "n", "dim", "vector", F.xxhash64("digest").alias("luck")), "reps"
    )
    shards = max(SHARDS, -(-reps.count() // SHARD_ROWS))
    dealt = reps.withColumn("shard", F.pmod("luck", F.lit(shards))).repartition(max(tasks, shards), "dim", "shard").sortWithinPartitions("dim", "shard", "luck")
    index = stage.store(dealt.select("dim", "shard", "rep", "n", "vector").mapInArrow(_indexed(least - LOOSE), "dim int, shard long, graph binary"), "index")

    # Every pair of shards meets in one task; a graph is dealt once for each shard there is.
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long")))
    pairs = index.withColumn("other", other).select("dim", F.least("shard", "other").alias("one"), F.greatest("shard", "other").alias("two"), "shard", "graph")
    pairs = pairs.repartition(max(tasks, shards * (shards + 1) // 2), "dim", "one", "two").sortWithinPartitions("dim", "one", "two", "shard")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    found = stage.store(pairs.select("dim", "one", "two", "graph").mapInArrow(_met(least), "kind int, a long, b long"), "found")
    ready(spark)

    label = components(stage, found.where("kind = 1").select("a", "b"))
    partners = found.where("kind = 0").groupBy(F.col("a").alias("rep")).agg(F.sum("b").alias("partners"))
    nodes = classes.join(label.withColumnRenamed("id", "rep"), "rep", "left").join(partners, "rep", "left").select(
        "digest", F.coalesce("component", "rep").alias("root"), (F.coalesce("partners", F.lit(0)) + F.col("n") - 1).alias("links")
    )
    out = rows.select("vec_id", F.when(F.col("vec_id").isNotNull(), F.col("digest")).alias("digest")).join(nodes, "digest", "left")
    component = F.coalesce("root", "vec_id")
    return out.select(
        "vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept")
    )


ORACLE = """
with recursive v as (select vec_id, list_transform(embedding, lambda x: x::double) as e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
link as (select a.vec_id as a, b.vec_id as b from v a join v b on a.vec_id <> b.vec_id and len(a.e) = len(b.e) where list_cosine_similarity(a.e, b.e) >= 0.9),
reach(id, root) as (select vec_id, vec_id from embeddings union select link.b, reach.root from reach join link on link.a = reach.id where reach.root < link.b),
low as (select id, min(root) as component_id from reach group by id),
many as (select a, count(*) as n from link group by a)
select vec_id, coalesce(n, 0) as n_links, component_id, vec_id = component_id as kept from embeddings e left join many on many.a = e.vec_id join low on low.id = e.vec_id
"""
