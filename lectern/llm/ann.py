"""Approximate nearest neighbours by NN-descent and greedy graph search (operator 5).

1. The means of a bounded sample's groups cut space into cells; every row goes to one cell, a large cell's rows are dealt to shards of bounded size.
2. Every shard is a graph, built where its rows are.  Equal vectors are one node.  Every node gets starting neighbours: random hyperplanes deal the
   nodes to small leaves several times, and each leaf is compared whole.  NN-descent: a node meets the neighbours of its neighbours and of those
   that have it as a neighbour, the new ones first, and keeps the best, until a round replaces few of the edges.
3. A query visits the cells whose means it is nearest to, and walks each shard's graph greedily: the best nodes not yet expanded are expanded,
   until none of its best nodes is left to expand.  The best of these are scored exactly on the original vectors there and then.
4. The effort is not fixed.  A sample of the queries is compared with all rows, which tells how many cells hold enough of a query's true neighbours; in
   each shard some queries are compared with all its rows, and while too few of their best are found, queries keep twice as many nodes.

All of this runs at every size of the table.  A row crosses the network once, a query once for each shard that it visits, and its best rows of a shard come back.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.balltree import usable, vectors_of
from lectern.llm.common import checkpointed, shuffle_partitions
from lectern.llm.textnum import mixed

DEGREE, TREES, LEAF = 40, 4, 500
#: NN-descent ends with the round that replaces no more than this share of the edges.
REPLACED = 0.05
#: Nodes a query keeps at first, and the share of them it expands in a step.
BEAM, WIDTH = 160, 0.3
#: Queries compared with all rows, about, and the share of their true neighbours that the cells visited have to hold.
SAMPLE, NEAR = 256, 0.98
#: Queries compared with all rows of a shard, and the share of its rows nearest to them that the walk has to find.
TRIED, FOUND = 64, 0.96
#: Rows and bytes of vectors that a shard has at most, about; cells that a small table has too; the most cells; and rows that they are fitted on, about.
SHARD_ROWS, SHARD_BYTES, FEW_CELLS, CELLS, FITTED = 400_000, 100 << 20, 16, 1_024, 30_000
#: Nodes of a round and queries worked on at once, nodes a walk may begin at, and those it does begin at.
NODES, WALKERS, ENTRIES, STARTS = 64, 128, 1_024, 32
#: Neighbours, and nodes that have it as a neighbour, by way of which a node meets others in a round.
AHEAD, BACK = 10, 5
DEALT = "shard int, kind int, id bigint, dims int, vec binary"
MET = "query bigint, ids array<bigint>, scores array<double>"


def _top(ids: np.ndarray, s: np.ndarray, k: int, *more: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of each line the ``k`` distinct ids of highest score, best first; of an id met twice the first one stays."""
    # ids with their places, so that a plain sort keeps the order of equal ones
    order = np.sort((ids.astype(np.int64) + 1) * ids.shape[1] + np.arange(ids.shape[1]), axis=1) % ids.shape[1]
    ids, s = np.take_along_axis(ids, order, 1), np.take_along_axis(s, order, 1)
    s[:, 1:][ids[:, 1:] == ids[:, :-1]] = -np.inf
    best = np.argpartition(-s, k - 1, axis=1)[:, :k] if s.shape[1] > k else np.broadcast_to(np.arange(s.shape[1]), s.shape)
    best = np.take_along_axis(best, np.argsort(-np.take_along_axis(s, best, 1), axis=1), 1)
    s = np.take_along_axis(s, best, 1)
    ids = np.where(s > -np.inf, np.take_along_axis(ids, best, 1), -1)
    return ids, s, *(np.take_along_axis(np.take_along_axis(m, order, 1), best, 1) for m in more)


class Graph:
    """Up to ``degree`` neighbours of every row of ``x``, best first; -1 for none."""

    def __init__(self, x: np.ndarray, *, degree: int, trees: int, leaf: int, replaced: float, seed: int = 5):
        self.x, self.rng = x, np.random.default_rng(seed)
        n, self.degree = len(x), max(1, min(degree, len(x) - 1))
        self.ids = np.full((n, self.degree), -1, np.int32)
        self.scores = np.full((n, self.degree), -np.inf, np.float32)
        for _ in range(trees):
            self._leaves(leaf)
        self.fresh = np.ones((n, self.degree), bool)
        while n > 2 and self._round() > replaced:
            pass
        del self.fresh, self.scores
        self.seen, self.slot, self.walks, self.loose = np.zeros(n, np.int32), np.empty(n, np.int32), 0, bool((self.ids < 0).any())

    def _leaves(self, leaf: int) -> None:
        """Compares the rows of each leaf of a tree of random hyperplanes, each through the middle of its rows."""
        todo = [np.arange(len(self.x), dtype=np.int32)]
        while todo:
            rows = todo.pop()
            if len(rows) > leaf:
                side = self.x[rows] @ self.rng.standard_normal(self.x.shape[1]).astype(np.float32)
                order = np.argpartition(side, len(rows) // 2)
                todo += [rows[order[: len(rows) // 2]], rows[order[len(rows) // 2 :]]]
                continue
            s = self.x[rows] @ self.x[rows].T
            np.fill_diagonal(s, -np.inf)
            k = min(self.degree, len(rows) - 1)
            if not k:
                continue
            near = np.argpartition(s, len(rows) - k, axis=1)[:, len(rows) - k :]
            ids = np.concatenate([self.ids[rows], rows[near]], axis=1)
            both = np.concatenate([self.scores[rows], np.take_along_axis(s, near, 1)], axis=1)
            self.ids[rows], self.scores[rows] = _top(ids, both, self.degree)

    def _back(self) -> np.ndarray:
        """For every node some of those that have it as a neighbour, drawn anew in each round."""
        n = len(self.x)
        column = self.rng.permutation(self.degree)[: max(1, self.degree // 4)]
        to = self.ids[:, column].ravel()
        order = self.rng.permutation(len(to))
        order = order[np.argsort(to[order], kind="stable")]
        to = to[order]
        rank = np.arange(len(to)) - np.searchsorted(to, to)
        some = (rank < BACK) & (to >= 0)
        back = np.full((n, BACK), -1, np.int32)
        back[to[some], rank[some]] = order[some] // len(column)
        return back

    def _round(self) -> float:
        """One round of NN-descent; the share of edges that it replaced."""
        n, changed, back = len(self.x), 0, self._back()
        reach = -(-self.degree // 2)
        held = np.empty((NODES * ((AHEAD + BACK) * reach + BACK), self.x.shape[1]), np.float32)
        for at in range(0, n, NODES):
            u = np.arange(at, min(n, at + NODES), dtype=np.int32)
            # fresh neighbours first, the rest by chance
            urge = self.rng.random((len(u), self.degree), np.float32) + self.fresh[u]
            ahead = np.argpartition(-urge, min(AHEAD, self.degree) - 1, axis=1)[:, :AHEAD]
            by = np.concatenate([np.take_along_axis(self.ids[u], ahead, 1), back[u]], axis=1)
            met = self.ids[by, :reach]
            met[by < 0] = -1
            met = np.concatenate([met.reshape(len(u), -1), back[u]], axis=1)
            met[met == u[:, None]] = -1
            # into memory that is there already
            x = self.x.take(met.ravel(), axis=0, out=held[: met.size], mode="clip").reshape(*met.shape, -1)
            s = np.matmul(x, self.x[u][:, :, None])[:, :, 0]
            old = self.fresh[u]
            np.put_along_axis(old, ahead, False, 1)
            # only what is better than a node's worst neighbour
            row, column = np.nonzero((met >= 0) & (s > self.scores[u][:, -1:]))
            place = np.arange(len(row)) - np.searchsorted(row, row)
            more = np.full((len(u), place.max(initial=0) + 1), -1, np.int32)
            gained = np.full(more.shape, -np.inf, np.float32)
            more[row, place], gained[row, place] = met[row, column], s[row, column]
            # 2 and 3: edges that were there; 1: new ones
            was = np.concatenate([old + np.int8(2), np.ones(more.shape, np.int8)], axis=1)
            ids, scores, was = _top(np.concatenate([self.ids[u], more], axis=1), np.concatenate([self.scores[u], gained], axis=1), self.degree, was)
            new = (was == 1) & (ids >= 0)
            changed += int(new.sum())
            self.ids[u], self.scores[u], self.fresh[u] = ids, scores, new | (was == 3)
        return changed / self.ids.size

    def walk(self, q: np.ndarray, start: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """A query's ``beam`` best nodes met, best first, with scores, after it has expanded every one of them."""
        seen, slot = self.seen, self.slot
        width = max(1, int(beam * WIDTH))
        ids, s, done = start, self.x[start] @ q, np.zeros(len(start), bool)
        self.walks += 1
        seen[ids] = self.walks
        while True:
            order = np.argpartition(-s, beam - 1)[:beam] if len(s) > 2 * beam else slice(None)
            order = np.argsort(-s[order])[:beam] if len(s) <= 2 * beam else order[np.argsort(-s[order])]
            ids, s, done = ids[order], s[order], done[order]
            go = np.flatnonzero(~done)[:width]
            if not len(go):
                return ids, s
            done[go] = True
            met = self.ids.take(ids[go], axis=0).ravel()
            met = met[seen.take(met, mode="wrap") != self.walks]
            if self.loose:
                met = met[met >= 0]
            places = np.arange(len(met), dtype=np.int32)
            slot[met] = places
            met = met[slot.take(met) == places]  # each once
            seen[met] = self.walks
            score = self.x.take(met, axis=0) @ q
            if len(s) >= beam:
                better = score > s[-1]
                met, score = met[better], score[better]
            ids, s, done = np.concatenate([ids, met]), np.concatenate([s, score]), np.concatenate([done, np.zeros(len(met), bool)])


def _numbers(x: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row."""
    h = np.full(len(x), x.shape[1], np.uint64)
    for column in x.T:
        h = mixed(h * np.uint64(0x9E3779B97F4A7C15) ^ column.astype(np.float64).view(np.uint64))
    return h


def _scaled(x: np.ndarray, axis: int | None) -> np.ndarray:
    """``x`` in single precision, divided by its largest component if products might not fit."""
    top = np.abs(x).max(axis=axis, keepdims=True, initial=0.0).astype(np.float64)
    odd = (top > 1e15) | (top < 1e-15)
    return (x / np.where(odd & (top > 0), top, 1.0)).astype(np.float32) if odd.any() else x.astype(np.float32, copy=False)


class Shard:
    """The rows of a shard with their graph; takes the pieces out of ``parts``, so that they aren't held twice."""

    def __init__(self, ids: np.ndarray, parts: list[np.ndarray], k: int, effort: dict):
        self.k, self.depth, self.beam, self.tried = k, effort["depth"], max(2 * k + 2, effort["beam"]), False
        vectors = np.concatenate(parts)
        parts.clear()
        numbers = _numbers(vectors)
        order = np.lexsort((ids, numbers))
        numbers = numbers[order]
        first = np.flatnonzero(np.concatenate([[True], numbers[1:] != numbers[:-1]]))
        self.numbers, self.vectors = numbers[first], vectors[order[first]]
        del vectors
        # of equal vectors the smallest ids suffice
        node = np.cumsum(np.bincount(first, minlength=len(ids))) - 1
        some = np.arange(len(ids)) - first[node] <= k
        self.members, self.cuts = ids[order[some]], np.searchsorted(node[some], np.arange(len(first) + 1))
        self.graph = Graph(_scaled(self.vectors, None), degree=effort["degree"], trees=effort["trees"], leaf=effort["leaf"], replaced=effort["replaced"])
        n = len(first)
        self.entries = np.random.default_rng(7).permutation(n)[:ENTRIES].astype(np.int32)

    def _walk(self, q: np.ndarray, own: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Each query's walk, from the best of the entries and from its own node."""
        s = q @ self.graph.x[self.entries].T
        m = min(len(self.entries), STARTS)
        start = self.entries[np.argpartition(-s, m - 1, axis=1)[:, :m]]
        for one, at, node in zip(q, start, own.tolist()):
            yield self.graph.walk(one, at if node < 0 or node in at else np.append(at, np.int32(node)), self.beam)

    def _try(self, q: np.ndarray, own: np.ndarray) -> None:
        """Doubles the beam until queries find enough of the shard's ``depth`` best nodes."""
        x, q, own = self.graph.x, q[:TRIED], own[:TRIED]
        k = min(self.depth, len(x))
        floors = np.concatenate([np.partition(q[a : a + 16] @ x.T, len(x) - k, axis=1)[:, len(x) - k] for a in range(0, len(q), 16)])
        floors -= np.abs(floors) * 1e-5
        while self.beam < len(x):
            if np.mean([(s[:k] >= floor).sum() / k for (_, s), floor in zip(self._walk(q, own), floors)]) >= FOUND:
                break
            self.beam *= 2
        self.tried = True

    def best(self, vectors: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each query in turn ids and exact scores of the ``k + 1`` best rows found."""
        numbers = _numbers(vectors)
        own = np.minimum(np.searchsorted(self.numbers, numbers), len(self.numbers) - 1)
        own = np.where(self.numbers[own] == numbers, own, -1)
        q = _scaled(vectors, 1)
        if not self.tried:
            self._try(q, own)
        for at in range(0, len(q), WALKERS):
            p = slice(at, at + WALKERS)
            near = [np.append(ids[: 2 * self.k + 2], node) for (ids, _), node in zip(self._walk(q[p], own[p]), own[p])]
            row, node = np.repeat(np.arange(len(near)), [len(i) for i in near]), np.concatenate(near)
            key = np.unique((row * np.int64(len(self.numbers)) + node)[node >= 0])  # the own node may be among the best
            row, node = key // len(self.numbers), key % len(self.numbers)
            score = np.zeros(len(row))
            asked, held = vectors[p].astype(np.float64), self.vectors
            for d in range(held.shape[1]):  # one after the other, so the order of additions is always the same
                score += held[node, d].astype(np.float64) * asked[row, d]
            many = self.cuts[node + 1] - self.cuts[node]
            of = np.repeat(np.arange(len(node)), many)
            ids = self.members[np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many) + self.cuts[node][of]]
            row, score = row[of], score[of]
            order = np.lexsort((ids, -score, row))
            cuts = np.searchsorted(row[order], np.arange(len(near) + 1))
            for a, b in zip(cuts[:-1], cuts[1:]):
                some = order[a : min(b, a + self.k + 1)]
                yield ids[some], score[some]


def _matrix(column: pa.BinaryArray, dims: int) -> np.ndarray:
    """The vectors of a batch; in double precision if one of them is."""
    got = column.to_pylist()
    kinds = [np.float32 if len(v) == 4 * dims else np.float64 for v in got]
    if len(set(kinds)) == 1:
        return np.frombuffer(b"".join(got), kinds[0]).reshape(len(got), dims)
    return np.array([np.frombuffer(v, kind).astype(np.float64) for v, kind in zip(got, kinds)])


def _answers(k: int, effort: dict):
    """Rows of a shard come first, its queries after them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pieces():
            for batch in batches:
                if batch.num_rows:
                    keys = np.stack([batch.column(i).to_numpy() for i in range(2)], axis=1)
                    new = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)]))
                    for a, b in zip(new, np.append(new[1:], len(keys))):
                        part = batch.slice(a, b - a)
                        yield *keys[a].tolist(), part.column(2).to_numpy().copy(), _matrix(part.column(4), part.column(3)[0].as_py())

        for _, held in groupby(pieces(), key=lambda p: p[0]):
            ids, vectors, shard = [], [], None
            for _, kind, own, matrix in held:
                if not kind:
                    ids.append(own)
                    vectors.append(matrix)
                    continue
                if shard is None:
                    if not ids:
                        continue
                    shard = Shard(np.concatenate(ids), vectors, k, effort)
                lists = list(shard.best(matrix))
                cuts = pa.array(np.concatenate([[0], np.cumsum([len(i) for i, _ in lists])]), pa.int32())
                columns = (pa.ListArray.from_arrays(cuts, np.concatenate(c)) for c in zip(*lists))
                yield pa.RecordBatch.from_arrays([pa.array(own), *columns], names=["query", "ids", "scores"])

    return run


class Cells:
    """Where rows of each length go, and which cells a query visits, nearest first."""

    def __init__(self, sample: dict[int, np.ndarray], wanted: dict[int, int]):
        self.means: dict[int, np.ndarray] = {}
        for dims, rows in sample.items():
            rng = np.random.default_rng([3, dims])
            rows = np.unique(rows, axis=0)
            means = rows[rng.permutation(len(rows))[: wanted[dims]]].copy()
            for _ in range(10 if len(means) > 1 else 0):
                cell = self._nearest(rows, means)
                for c in np.unique(cell):
                    means[c] = rows[cell == c].mean(axis=0)
            self.means[dims] = means

    @staticmethod
    def _nearest(x: np.ndarray, means: np.ndarray) -> np.ndarray:
        half = (means**2).sum(axis=1) / 2
        return np.concatenate([(x[a : a + 4096] @ means.T - half).argmax(axis=1) for a in range(0, len(x), 4096)]) if len(x) else np.empty(0, np.int64)

    def of(self, x: np.ndarray) -> np.ndarray:
        means = self.means.get(x.shape[1])
        return np.zeros(len(x), np.int64) if means is None else self._nearest(x, means)

    def order(self, q: np.ndarray) -> np.ndarray:
        """For each query the cells: the one it would be in, then by inner product with their means."""
        means = self.means.get(q.shape[1])
        if means is None:
            return np.zeros((len(q), 1), np.int64)
        s = q @ means.T
        s[np.arange(len(q)), self.of(q)] = np.inf
        return np.argsort(-s, axis=1, kind="stable")


def _small(x: np.ndarray) -> np.ndarray:
    """Vectors as cells see them: no product of these overflows."""
    top = np.abs(x).max(axis=1, keepdims=True, initial=0.0)
    return x / np.where(top > 1e100, top / 1e100, 1.0)


def _packed(x: np.ndarray) -> pa.Array:
    """A binary value for each row, in single precision if that is what all of them are."""
    with np.errstate(over="ignore"):
        single = x.astype(np.float32)
    x = single if (single == x).all() else x
    width = x.shape[1] * x.itemsize
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(np.arange(0, (len(x) + 1) * width, width, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(x))])


def _cells_of(cells: Cells):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for places, x in vectors_of(batch.column(1)) if batch.num_rows else ():
                cell, n = np.unique(cells.of(_small(x)), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cell), x.shape[1])), pa.array(cell), pa.array(n)], names=["dims", "cell", "n"])

    return run


def _dealt(cells: Cells, shards: dict[int, tuple[np.ndarray, np.ndarray]], visits: dict[int, int], kind: int):
    """Rows to a shard of their cell, queries (``kind`` 1) to every shard of the cells they visit."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for places, x in vectors_of(batch.column(1)) if batch.num_rows else ():
                dims = x.shape[1]
                x = x + 0.0  # no negative zeros
                for at in range(0, len(x), 256 if kind else len(x)):
                    some = x[at : at + 256] if kind else x
                    ids = batch.column(0).to_numpy()[places[at : at + len(some)]]
                    first, many = shards[dims]
                    if kind:
                        cell = cells.order(_small(some))[:, : visits[dims]]
                        row = np.repeat(np.arange(len(some)), cell.shape[1])
                        cell = cell.ravel()
                        of = np.repeat(np.arange(len(cell)), many[cell])
                        shard = first[cell][of] + np.arange(len(of)) - (np.cumsum(many[cell]) - many[cell])[of]
                        row = row[of]
                    else:
                        cell, row = cells.of(_small(some)), np.arange(len(some))
                        shard = first[cell] + (mixed(ids.view(np.uint64)) % many[cell].astype(np.uint64)).astype(np.int64)
                    vec = _packed(some)
                    for a in range(0, len(row), 8192):
                        r = row[a : a + 8192]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(shard[a : a + 8192].astype(np.int32)), pa.array(np.full(len(r), kind, np.int32)), pa.array(ids[r]), pa.array(np.full(len(r), dims, np.int32)), vec.take(pa.array(r))],
                            names=["shard", "kind", "id", "dims", "vec"],
                        )

    return run


def _nearest(sample: dict[int, list[tuple[int, np.ndarray]]], cells: Cells, k: int):
    """A task's ``k`` best rows for each query of ``sample`` but its equals, with their cells."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for _, x in vectors_of(batch.column(1)) if batch.num_rows else ():
                if x.shape[1] not in sample:
                    continue
                q, cell = np.array([v for _, v in sample[x.shape[1]]]), cells.of(_small(x))
                s = q @ x.T
                for i, j in zip(*np.nonzero(s >= (q * q).sum(axis=1)[:, None] * (1 - 1e-9))):
                    if (q[i] == x[j]).all():
                        s[i, j] = -np.inf
                s[~np.isfinite(s)] = -np.inf
                near = np.argpartition(s, max(0, s.shape[1] - k), axis=1)[:, -k:]
                s, cell = np.take_along_axis(s, near, 1), cell[near]
                if x.shape[1] in best:
                    s, cell = np.concatenate([best[x.shape[1]][0], s], axis=1), np.concatenate([best[x.shape[1]][1], cell], axis=1)
                near = np.argsort(-s, axis=1, kind="stable")[:, :k]
                best[x.shape[1]] = np.take_along_axis(s, near, 1), np.take_along_axis(cell, near, 1)
        for dims, (s, cell) in best.items():
            ids = np.repeat([i for i, _ in sample[dims]], s.shape[1])
            fine = np.isfinite(s.ravel())
            yield pa.RecordBatch.from_arrays([pa.array(ids[fine], pa.int64()), pa.array(cell.ravel()[fine]), pa.array(s.ravel()[fine])], names=["query", "cell", "score"])

    return run


def _visits(rows: DataFrame, asking: DataFrame, cells: Cells, many: dict[int, int], k: int) -> tuple[dict[int, int], int]:
    """Cells that queries of each length have to visit, and how many of a cell's best rows have to be found: so many that those of a sample would see
    ``NEAR`` of their true neighbours."""
    n = asking.count()
    bound = min(1 << 30, int(SAMPLE / max(1, n) * (1 << 30)) + 1)
    sample: dict[int, list[tuple[int, np.ndarray]]] = {}
    for r in asking.where(F.pmod(F.xxhash64("id", F.lit(9)), F.lit(1 << 30)) < bound).limit(4 * SAMPLE).collect():
        sample.setdefault(len(r["vec"]), []).append((r["id"], np.array(r["vec"], np.float64)))
    met = rows.mapInArrow(_nearest(sample, cells, k), "query bigint, cell bigint, score double")
    best = met.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "cell"))).where(F.col("r") <= k)
    held: dict[int, list[int]] = {}
    for r in best.select("query", "cell").collect():
        held.setdefault(r["query"], []).append(r["cell"])
    visits, depths = dict(many), []  # all cells, where no sample tells
    for dims, some in sample.items():
        order = cells.order(_small(np.array([v for _, v in some])))
        places = [int(np.flatnonzero(line == c)[0]) for (i, _), line in zip(some, order) for c in held.get(i, [])]
        if places:
            visits[dims] = int(np.sort(places)[max(0, int(np.ceil(NEAR * len(places))) - 1)]) + 1
    for found in held.values():
        depths += [place + 1 for c in set(found) for place in range(found.count(c))]
    # the query's own node is one more
    return visits, 1 + (int(np.sort(depths)[int(np.ceil(NEAR * len(depths))) - 1]) if depths else k)


def search(vectors: DataFrame, *, key: str = "vec_id", vector: str = "embedding", query_every: int = 20, k: int = 20, degree: int = DEGREE) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for every row whose id ``query_every`` divides, the ``k`` best other rows found.

    Scores are inner products of the original vectors in double precision; ties go to the smaller id.  Vectors null, zero or holding
    null or non-finite components take no part; vectors of different lengths don't meet.  Rows that carry the query's id are its own; otherwise
    repeated rows are candidates each, and a repeated id that is a query has one answer over its rows.  Fewer than ``k`` candidates give that many
    rows, an empty table none; extra columns are ignored.  Of equal vectors in a shard the ``k + 1`` smallest ids suffice, so copies
    of a third of all rows are one node of each and found exactly.  Nodes are told apart by 64-bit hashes of their vectors.

    However large the table, a query visits as many cells as a sample of the queries needs for ``NEAR`` of its true neighbours, and in each shard
    the walk goes on until ``FOUND`` of the shard's best are found, or its beam has room for all rows.  The cells are fitted on a hashed sample of about
    ``FITTED`` rows; every row is in one.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, key=key, vector=vector).where(F.exists("vec", lambda x: x != 0))
    sizes = {r["dims"]: r["n"] for r in rows.groupBy(F.size("vec").alias("dims")).agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    n = sum(sizes.values())
    # the queries, equal ones once
    asked = checkpointed(rows.where(F.col("vec_id") % query_every == 0).select(F.xxhash64(F.size("vec"), "vec").alias("id"), "vec_id", "vec"))
    asking = checkpointed(asked.select("id", "vec").dropDuplicates(["id"]))
    bound = min(1 << 30, int(FITTED / n * (1 << 30)) + 1)
    sample: dict[int, list] = {}
    for r in rows.where(F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(1 << 30)) < bound).limit(2 * FITTED).select("vec").toLocalIterator():
        sample.setdefault(len(r["vec"]), []).append(np.array(r["vec"], np.float64))
    few = min(FEW_CELLS, shuffle_partitions(spark))
    least = -(-n // few)
    shard_rows = {d: max(1, min(SHARD_ROWS, SHARD_BYTES // (4 * max(1, d)), least)) for d in sizes}
    cells = Cells({d: _small(np.array(v)) for d, v in sample.items()}, {d: min(CELLS, -(-sizes[d] // shard_rows[d])) for d in sample})
    shards: dict[int, tuple[np.ndarray, np.ndarray]] = {d: (np.zeros(len(cells.means.get(d, [0])), np.int64), np.zeros(len(cells.means.get(d, [0])), np.int64)) for d in sizes}
    for r in rows.mapInArrow(_cells_of(cells), "dims bigint, cell bigint, n bigint").groupBy("dims", "cell").agg(F.sum("n").alias("n")).collect():
        # cells differ in size; a shard may have half more
        shards[r["dims"]][1][r["cell"]] = max(1, round(r["n"] / shard_rows[r["dims"]]))
    total = 0
    for first, many in shards.values():
        first[:] = total + np.cumsum(many) - many
        total += int(many.sum())
    visits, depth = _visits(rows, asking, cells, {d: len(many) for d, (_, many) in shards.items()}, k)
    effort = {"degree": degree, "trees": TREES, "leaf": 2 * LEAF, "beam": BEAM, "depth": depth, "replaced": REPLACED}
    dealt = rows.mapInArrow(_dealt(cells, shards, visits, 0), DEALT).unionAll(asking.mapInArrow(_dealt(cells, shards, visits, 1), DEALT))
    met = dealt.repartitionById(total, "shard").sortWithinPartitions("shard", "kind").mapInArrow(_answers(k, effort), MET)
    best = lambda of: Window.partitionBy(of).orderBy(F.desc("score"), "vec_id")
    each = met.repartition(max(shuffle_partitions(spark), total), "query").select(F.col("query").alias("node"), F.explode(F.arrays_zip("ids", "scores")).alias("x"))
    around = each.select("node", F.col("x.ids").alias("vec_id"), F.col("x.scores").alias("score"))
    around = around.withColumn("r", F.row_number().over(best("node"))).where(F.col("r") <= k + 1).drop("r")
    own = asked.select(F.col("id").alias("node"), F.col("vec_id").alias("query_id")).distinct()
    answers = around.join(own, "node").where("vec_id <> query_id")
    return answers.withColumn("rank", F.row_number().over(best("query_id"))).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
