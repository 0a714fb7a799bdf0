"""Exact top-k inner products by ball trees (operator 8).

1. A bounded sample's ball tree cuts space into at most ``CELLS`` cells; every row goes to its cell, and a cell's rows are
   dealt to shards of bounded size.  A cell's ball holds all its rows, not only the sampled ones.
2. A shard builds its ball tree once and then reads its queries as a stream.  It bounds a query's inner product with
   anything in a ball by ``q.c + |q| r``, walks the balls by falling bound and stops where the bound can't reach the current k-th score.
3. A query first searches its home shard.  The k-th score found there goes with it as a floor: cells whose ball
   can't reach the floor never see the query.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import checkpointed, shuffle_partitions

SHARD_ROWS, LEAF = 16_384, 512
#: Queries that one copy of a shard's rows answers.
QUERY_BLOCK = 1 << 20
#: Rows that the cells are fitted on, about, and the most cells; both hold at every size of the table.
SAMPLE, CELLS = 20_000, 4_096
RESULT = "query_id bigint, vec_id bigint, score bigint"
#: What a score below the range of a long is kept as until it is known whether it is among the best.
LOWEST = -(1 << 63)


def vectors_of(column: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The vectors of each length: their places in ``column``, and a matrix."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    starts = np.concatenate([[0], np.cumsum(lengths)])
    values = column.flatten().to_numpy(zero_copy_only=False)
    for n in np.unique(lengths):
        places = np.flatnonzero(lengths == n)
        yield places, values[(starts[places][:, None] + np.arange(n)).ravel()].reshape(len(places), n)


class BallTree:
    """Balls over the rows of ``points``, split at the median of the coordinate direction of largest spread."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.points = points.astype(np.float64)
        self.order = np.arange(len(points))
        self.spans: list[tuple[int, int]] = []
        self.children: list[tuple[int, int]] = []
        centres, radii, largest = [], [], []
        todo = [(0, len(points), -1, 0)]
        while todo:
            a, b, parent, side = todo.pop()
            node, rows = len(self.spans), self.points[self.order[a:b]]
            centre = rows.mean(axis=0)
            centres.append(centre)
            # a little more than the largest distance, against rounding
            radii.append(float(np.sqrt(((rows - centre) ** 2).sum(axis=1).max())) * (1 + 1e-9) + 1e-9)
            largest.append(float(np.abs(rows).max(initial=0.0)))
            self.spans.append((a, b))
            self.children.append((-1, -1))
            if parent >= 0:
                left, right = self.children[parent]
                self.children[parent] = (node, right) if side == 0 else (left, node)
            if b - a > leaf and radii[-1] > 1e-6:
                axis = int(np.argmax(rows.max(axis=0) - rows.min(axis=0)))
                middle = (b - a) // 2
                self.order[a:b] = self.order[a:b][np.argpartition(rows[:, axis], middle)]
                todo += [(a, a + middle, node, 0), (a + middle, b, node, 1)]
        self.centres, self.radii, self.largest = np.array(centres), np.array(radii), np.array(largest)
        self.norms = np.sqrt((self.centres**2).sum(axis=1))

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """What no inner product of ``q`` with a row of each ball exceeds."""
        size = np.sqrt(q @ q)
        return self.centres @ q + size * self.radii + size * (self.norms + self.radii) * 1e-9 + 1e-6

    def search(self, query: np.ndarray, ids: np.ndarray, own: int, k: int, floor: int | None, score) -> list[tuple[int, int]]:
        """Scores and ids of the k best rows but ``own`` that score at least ``floor``, in any order; of equal scores the smaller ids."""
        bounds = self.bounds(query.astype(np.float64))
        kth = float("-inf") if floor is None else floor
        # nodes whose ancestors can all reach the floor
        alive, leaves = [0], []
        while alive:
            node = alive.pop()
            if bounds[node] < kth:
                continue
            left, right = self.children[node]
            if left < 0:
                leaves.append(node)
            else:
                alive += [left, right]
        best: list[tuple[int, int]] = []
        for node in sorted(leaves, key=lambda n: -bounds[n]):
            if bounds[node] < kth:
                break
            a, b = self.spans[node]
            rows = self.order[a:b]
            values = score(rows, query, self.largest[node])
            near = np.flatnonzero((values >= kth) & (ids[rows] != own))
            if len(near) > k and values.dtype != object:  # only these can be among the best
                near = near[np.lexsort((ids[rows][near], -values[near]))[:k]]
            if len(near):
                best = sorted([*best, *zip(values[near].tolist(), ids[rows][near].tolist())], key=lambda x: (-x[0], x[1]))[:k]
                if len(best) == k:
                    kth = max(kth, best[-1][0])
        return best


def _scores(points: np.ndarray):
    """Exact integer inner products; with integers of any size where a long might not hold them."""
    as_double = points.astype(np.float64)

    def score(rows: np.ndarray, query: np.ndarray, largest: float) -> np.ndarray:
        size = points.shape[1] * largest * float(np.abs(query.astype(np.float64)).max(initial=0.0))
        if size < 1 << 52:
            return (as_double[rows] @ query.astype(np.float64)).astype(np.int64)
        if size < 1 << 62:
            return points[rows] @ query
        return points[rows].astype(object) @ query.astype(object)

    return score


def _long(score: int) -> int:
    if score >= 1 << 63:  # nothing but a score as large could displace it
        raise OverflowError("an integer inner product among the best doesn't fit a long")
    return max(score, LOWEST)


def _answer(k: int):
    """Rows of a shard come first, its queries after them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pieces():
            for batch in batches:
                if batch.num_rows:
                    keys = np.stack([batch.column(i).to_numpy() for i in range(4)], axis=1)
                    kinds = batch.column(4).to_numpy()
                    new = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1) | (kinds[1:] != kinds[:-1])]))
                    for a, b in zip(new, np.append(new[1:], len(kinds))):
                        yield tuple(keys[a].tolist()), int(kinds[a]), batch.slice(a, b - a)

        for _, shard in groupby(pieces(), key=lambda p: p[0]):
            rows: list[pa.RecordBatch] = []
            tree = None
            for _, kind, part in shard:
                if not kind:
                    rows.append(part)
                    continue
                if not rows:
                    continue
                if tree is None:
                    ids = np.concatenate([r.column(5).to_numpy() for r in rows])
                    points = np.concatenate([m for r in rows for _, m in vectors_of(r.column(6))])
                    tree, score = BallTree(points), _scores(points)
                found = []
                floors = part.column(7).to_pylist()
                own = part.column(5).to_numpy()
                for places, matrix in vectors_of(part.column(6)):
                    for i, query in zip(places.tolist(), matrix):
                        found += [(int(own[i]), vec, _long(s)) for s, vec in tree.search(query, ids, int(own[i]), k, floors[i], score)]
                columns = zip(*found) if found else ([], [], [])
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["query_id", "vec_id", "score"])

    return run


class Cells:
    """A cut of space into cells, fitted on a sample, for vectors of one length."""

    def __init__(self, sample: np.ndarray, cells: int):
        self.axes, self.cuts, self.next, centres = [], [], [], []
        todo = [(sample.astype(np.float64), cells, -1, 0)]
        while todo:
            rows, cells, parent, side = todo.pop()
            node, spread = len(self.axes), rows.max(axis=0) - rows.min(axis=0) if rows.size else np.zeros(0)
            self.axes.append(int(np.argmax(spread)) if len(spread) else 0)
            self.next.append([-1, -1])
            if parent >= 0:
                self.next[parent][side] = node
            cut = float(np.median(rows[:, self.axes[-1]])) if len(spread) else 0.0
            self.cuts.append(cut)
            left = rows[:, self.axes[-1]] <= cut if len(spread) else np.ones(len(rows), bool)
            if cells > 1 and left.any() and not left.all():
                todo += [(rows[left], cells // 2, node, 0), (rows[~left], cells - cells // 2, node, 1)]
            else:
                self.next[-1] = [~len(centres), ~len(centres)]
                centres.append(rows.mean(axis=0))
        self.axes, self.cuts, self.next, self.centres = np.array(self.axes), np.array(self.cuts), np.array(self.next), np.array(centres)

    def of(self, points: np.ndarray) -> np.ndarray:
        """The cell of each row."""
        at = np.zeros(len(points), np.int64)
        if not points.shape[1]:
            return at
        while (inner := np.flatnonzero(at >= 0)).size:
            node = at[inner]
            at[inner] = self.next[node, (points[inner, self.axes[node]] > self.cuts[node]).astype(np.int64)]
        return ~at


def _place(cells: dict[int, Cells]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, far = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
            dims = batch.column(1).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            for places, points in vectors_of(batch.column(1)):
                points, cut = points.astype(np.float64), cells.get(points.shape[1])
                if cut is not None:
                    cell[places] = cut.of(points)
                    points = points - cut.centres[cell[places]]
                far[places] = np.sqrt((points**2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(dims), pa.array(cell), pa.array(far)], names=["vec_id", "vec", "dims", "cell", "far"])

    return run


def _reachable(cells: dict[int, Cells], stats: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]):
    """Each query once for every cell that may hold a row of at least its floor, with the number of the cell's shards."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            floors = np.array([float("-inf") if f is None else float(f) for f in batch.column(2).to_pylist()])
            for places, queries in vectors_of(batch.column(1)):
                if queries.shape[1] not in stats:
                    continue
                q, (number, radii, shards) = queries.astype(np.float64), stats[queries.shape[1]]
                cut = cells.get(queries.shape[1])
                centres = cut.centres[number] if cut is not None else np.zeros((len(number), queries.shape[1]))
                size = np.sqrt((q**2).sum(axis=1))[:, None]
                reach = size * (np.sqrt((centres**2).sum(axis=1)) + radii) * 2e-9 + 1e-6
                for at in range(0, len(q), 1024):
                    s = slice(at, at + 1024)
                    i, j = np.nonzero(q[s] @ centres.T + size[s] * radii + reach[s] >= floors[places[s], None])
                    for part in range(0, len(i), 4096):
                        p = slice(part, part + 4096)
                        some = batch.take(pa.array(places[s][i[p]]))
                        yield pa.RecordBatch.from_arrays([*some.columns, pa.array(number[j[p]]), pa.array(shards[j[p]])], names=[*batch.schema.names, "cell", "shards"])

    return run


def usable(vectors: DataFrame, *, key: str, vector: str) -> DataFrame:
    """``(vec_id, vec)`` in doubles, without vectors null, or holding null or non-finite components."""
    v = F.col(f"`{vector}`").cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(F.col(f"`{vector}`").isNotNull() & F.coalesce(fine, F.lit(False))).select(F.col(f"`{key}`").cast("bigint").alias("vec_id"), v.alias("vec"))


def top_k(
    vectors: DataFrame, *, key: str = "vec_id", vector: str = "embedding", scale: int = 256, query_every: int = 50, k: int = 5, shard_rows: int = SHARD_ROWS, query_block: int = QUERY_BLOCK, sample: int = SAMPLE
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: each query's ``k`` rows of highest integer inner product, ties to the smaller id.

    Components become ``floor(scale * x)``.  Queries are the rows whose id ``query_every`` divides, candidates all rows but
    those of the query's own id.  Scores are exact integers; a result that doesn't fit a long, or a component that doesn't, raises.
    Fewer than ``k`` candidates give that many rows.  Unusable vectors take no part, vectors of different lengths don't meet,
    empty tables give no rows, and extra columns are ignored.  Repeated rows count as one row each; if they are
    queries, their common id has one answer over all of them.  The cells are fitted on a hashed sample of about ``sample`` rows, which decides how
    much is pruned but never what is found.  A shard has about ``shard_rows`` rows and answers ``query_block`` queries at most, however
    large the table; rows all alike are dealt to shards by a hash of their ids.
    """
    spark = vectors.sparkSession
    whole = lambda x: F.when(F.abs(x * scale) >= float(1 << 63), F.raise_error(F.lit("a component doesn't fit a long"))).otherwise(F.floor(x * scale)).cast("bigint")
    rows = usable(vectors, key=key, vector=vector).select("vec_id", F.transform("vec", whole).alias("vec"))
    n, asked = rows.agg(F.count("*"), F.count(F.when(F.col("vec_id") % query_every == 0, 1))).first()
    if not asked:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    blocks = -(-asked // query_block)
    share = min(1.0, sample / n)
    by_length: dict[int, list] = {}
    for r in rows.where(F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(1 << 30)) < int(share * (1 << 30)) + 1).limit(2 * sample).collect():
        by_length.setdefault(len(r["vec"]), []).append(r["vec"])
    wanted = min(CELLS, -(-n // shard_rows))
    drawn = sum(map(len, by_length.values()))
    cells = {d: Cells(np.array(v, np.int64).reshape(len(v), d), max(1, wanted * len(v) // drawn)) for d, v in by_length.items()}
    placed = rows.mapInArrow(_place(cells), "vec_id bigint, vec array<bigint>, dims bigint, cell bigint, far double")
    found: dict[int, list] = {}
    for r in placed.groupBy("dims", "cell").agg(F.count("*").alias("n"), F.max("far").alias("far")).orderBy("dims", "cell").collect():
        found.setdefault(r["dims"], []).append((r["cell"], r["far"] * (1 + 1e-9) + 1e-9, -(-r["n"] // shard_rows)))
    stats = {d: (np.array([c for c, _, _ in v], np.int64), np.array([f for _, f, _ in v]), np.array([s for _, _, s in v], np.int64)) for d, v in found.items()}
    shards = spark.createDataFrame([(d, c, s) for d, v in found.items() for c, _, s in v], "dims bigint, cell bigint, shards bigint")
    total = sum(s for v in found.values() for _, _, s in v)
    parts = max(shuffle_partitions(spark), total * blocks // 8)

    # one row for each cell, so at most CELLS and one for each length
    placed = placed.join(F.broadcast(shards), ["dims", "cell"]).withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.col("shards")))
    queries = placed.where(F.col("vec_id") % query_every == 0).select("vec_id", "vec", "dims", "cell", "shard")
    block = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks))
    copies = placed.select("dims", "cell", "shard", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))).alias("block"), F.lit(0).alias("kind"), "vec_id", "vec", F.lit(None).cast("bigint").alias("floor"))

    def answered(asking: DataFrame) -> DataFrame:
        both = copies.unionAll(asking.select("dims", "cell", "shard", block.alias("block"), F.lit(1).alias("kind"), "vec_id", "vec", "floor"))
        cell = ["dims", "cell", "shard", "block"]
        return both.repartition(parts, *cell).sortWithinPartitions(*cell, "kind").mapInArrow(_answer(k), RESULT)

    home = checkpointed(answered(queries.withColumn("floor", F.lit(None).cast("bigint"))))
    result = home
    if total > 1:
        kth = home.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("floor"))
        known = queries.join(kth, queries.vec_id == kth.query_id, "left").select("vec_id", "vec", "floor", "dims", F.col("cell").alias("home"), F.col("shard").alias("home_shard"))
        schema = "vec_id bigint, vec array<bigint>, floor bigint, dims bigint, home bigint, home_shard bigint, cell bigint, shards bigint"
        away = known.mapInArrow(_reachable(cells, stats), schema).withColumn("shard", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("shards") - 1)))
        result = home.unionAll(answered(away.where("cell <> home or shard <> home_shard")))
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = result.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    score = F.when(F.col("score") == LOWEST, F.raise_error(F.lit("an integer inner product among the best doesn't fit a long"))).otherwise(F.col("score")).cast("bigint")
    return ranked.select("query_id", "rank", "vec_id", score.alias("score"))
