"""Exact top-k inner-product search with two cover trees.

Queries and data are indexed together. Shared pivots split the space; rows of one pivot, in the
order of their distance from it, are cut into blocks of bounded size, which are the upper nodes of
the trees: a centre and a covering radius. Inside a block follows a cover tree, level by level:
centres at least a radius apart that cover all rows within it, the radius halved each time.

No row under a pair of nodes scores more than c_q.c_d + |c_q| r_d + |c_d| r_q + r_q r_d. A first round
lets each query block meet the data blocks that promise most, which gives every query a kth score
to beat. Then all other pairs of blocks whose bound reaches the worst kth score of the query block
meet, and the dual traversal drops pairs of nodes by the worst kth score of the query node. Nothing
is dropped that could tie. Scores are exact integers.

Pivots are chosen from at most ``SAMPLE`` rows; every row is indexed and nothing is approximate.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqlab.session import written

SAMPLE = 2048
PIVOTS = 32
#: Rows of a block of data and of queries, and data blocks that a query block meets at first.
DATA_BLOCK, QUERY_BLOCK = 512, 128
FIRST = 2
#: Query blocks that one task lets meet a data block.
TOGETHER = 64
EXACT = float(1 << 53)
LONG = (1 << 63) - 1


def scaled_rows(vectors: DataFrame, scale: float) -> DataFrame:
    """dim, vec_id, row = floor(scale * x) of the vectors that take part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, rows = [], []
            for k, v in enumerate(batch.column(1).to_pylist()):
                x = np.array([np.nan if c is None else c for c in v], np.float64) * scale
                if len(x) and np.isfinite(x).all():
                    keep.append(k)
                    rows.append(np.floor(x))
            ids = batch.column(0).take(pa.array(keep, pa.int64()))
            dims = pa.array([len(r) for r in rows], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [dims, ids, pa.array(rows, pa.list_(pa.float64()))], ["dim", "vec_id", "row"]
            )

    ready = vectors.where("vec_id IS NOT NULL AND embedding IS NOT NULL")
    return ready.select("vec_id", "embedding").mapInArrow(run, "dim int, vec_id long, row array<double>")


def choose_pivots(rows: DataFrame) -> dict[int, np.ndarray]:
    """Rows far from each other, for each number of dimensions in a bounded sample."""
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()
    by_dim: dict[int, list] = {}
    for r in sample:
        by_dim.setdefault(r.dim, []).append(r.row)
    pivots = {}
    for dim, own in by_dim.items():
        x = np.array(own)
        chosen, far = [0], np.full(len(x), np.inf)
        while len(chosen) < min(PIVOTS, len(x)):
            far = np.minimum(far, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
            chosen.append(int(far.argmax()))
        pivots[dim] = x[chosen]
    return pivots


BLOCKS = "block long, dim int, centre array<double>, radius double, ids array<long>, points array<double>"


def blocks_of(rows: DataFrame, pivots: dict[int, np.ndarray], size: int) -> DataFrame:
    """Rows by pivot and distance, cut into blocks of at most ``size``."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pivot, away = [], []
            for v in batch.column(2).to_pylist():
                own = pivots.get(len(v), np.zeros((1, len(v))))
                d = ((own - np.array(v)) ** 2).sum(axis=1)
                pivot.append(int(d.argmin()))
                away.append(float(np.sqrt(d.min())))
            columns = [*batch.columns, pa.array(pivot, pa.int32()), pa.array(away, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "pivot", "away"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            keys = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in (0, 3)], axis=1)
            change = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            bounds = [0, *change.tolist(), len(batch)]
            out = []
            for start, stop in zip(bounds[:-1], bounds[1:], strict=True):
                for k in range(start, stop, size):
                    part = batch.slice(k, min(size, stop - k))
                    x = np.array(part.column(2).to_pylist())
                    centre = x.mean(axis=0)
                    radius = float(np.sqrt(((x - centre) ** 2).sum(axis=1).max()))
                    out.append([number, x.shape[1], centre, radius, part.column(1).to_numpy(), x.ravel()])
                    number += 1
            if out:
                names = ["block", "dim", "centre", "radius", "ids", "points"]
                kinds = [pa.int64(), pa.int32(), pa.list_(pa.float64()), pa.float64(),
                         pa.list_(pa.int64()), pa.list_(pa.float64())]
                columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names)

    keys = ["dim", "pivot", "away", "vec_id"]
    placed = rows.mapInArrow(place, "dim int, vec_id long, row array<double>, pivot int, away double")
    return placed.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(cut, BLOCKS)


class CoverTree:
    """Levels of (centres, radii, children): every node covers the rows under it."""

    def __init__(self, points: np.ndarray) -> None:
        self.points = points
        nodes = [np.arange(len(points))]
        self.levels: list[tuple[np.ndarray, np.ndarray, list[np.ndarray]]] = []
        reach = self._radius(nodes[0])[1]
        while True:
            described = [self._radius(n) for n in nodes]
            centres = np.array([points[c] for c, _ in described])
            radii = np.array([r for _, r in described])
            self.levels.append((centres, radii, nodes))
            if not radii.any():
                return
            reach /= 2
            split = [part for n in nodes for part in self._split(n, reach)]
            nodes = split

    def _radius(self, rows: np.ndarray) -> tuple[int, float]:
        d = ((self.points[rows] - self.points[rows[0]]) ** 2).sum(axis=1)
        return int(rows[0]), float(np.sqrt(d.max()))

    def _split(self, rows: np.ndarray, reach: float) -> list[np.ndarray]:
        """Groups around centres more than ``reach`` apart; the first row leads each group."""
        out = []
        while len(rows):
            d = ((self.points[rows] - self.points[rows[0]]) ** 2).sum(axis=1)
            near = d <= reach * reach
            out.append(rows[near])
            rows = rows[~near]
        return out


def _bound(cq, rq, cd, rd) -> np.ndarray:
    """Largest inner product under each pair of nodes, rounded up a little."""
    nq, nd = np.sqrt((cq * cq).sum(axis=1)), np.sqrt((cd * cd).sum(axis=1))
    most = cq @ cd.T + nq[:, None] * rd + rq[:, None] * nd + rq[:, None] * rd
    return most + 1 + 1e-9 * (nq + rq)[:, None] * (nd + rd)


def _children(level: list[np.ndarray], below: list[np.ndarray]) -> list[list[int]]:
    """Nodes of the level below that stand under each node; both list rows node by node."""
    out, k = [], 0
    for rows in level:
        own, seen = [], 0
        while seen < len(rows):
            own.append(k)
            seen += len(below[k])
            k += 1
        out.append(own)
    return out


def dual_search(
    queries: CoverTree, data: CoverTree, least: np.ndarray
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query rows, data rows) of the node pairs that may hold a score of at least ``least``.

    ``least`` is the score that each query must reach. Both trees go down together, level by
    level, the shorter one staying at its last.
    """
    pairs = np.zeros((1, 2), np.int64)
    depth = max(len(queries.levels), len(data.levels))
    for step in range(depth):
        at = [min(step, len(t.levels) - 1) for t in (queries, data)]
        (cq, rq, q_rows), (cd, rd, d_rows) = queries.levels[at[0]], data.levels[at[1]]
        if step:
            for side, tree in ((0, queries), (1, data)):
                if len(tree.levels) > step:
                    below = _children(tree.levels[step - 1][2], tree.levels[step][2])
                    many = np.array([len(below[p]) for p in pairs[:, side]])
                    spread = [c for p in pairs[:, side].tolist() for c in below[p]]
                    pairs = np.repeat(pairs, many, axis=0)
                    pairs[:, side] = spread
        worst = np.array([least[r].min() for r in q_rows])
        fits = _bound(cq, rq, cd, rd) >= worst[:, None]
        pairs = pairs[fits[pairs[:, 0], pairs[:, 1]]]
        if not len(pairs):
            return
    for node in np.unique(pairs[:, 0]).tolist():
        hit = pairs[pairs[:, 0] == node, 1]
        yield q_rows[node], np.concatenate([d_rows[h] for h in hit])


def _scores(q: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Exact integer inner products; beyond 64 bits they stop at the largest number."""
    if not len(q) or not len(d):
        return np.zeros((len(q), len(d)), np.int64)
    if np.abs(q).max() * np.abs(d).max() * q.shape[1] < EXACT:
        return (q @ d.T).astype(np.int64)
    big = [np.array([[int(x) for x in row] for row in m], object) for m in (q, d)]
    return np.clip(big[0] @ big[1].T, -LONG, LONG).astype(np.int64)


def _meet(k: int) -> Callable[[pa.Table], pa.Table]:
    """A data block and query blocks: of every query the k best ids of the block.

    Repeated rows of an id stand together in a block and must not take the place of other ids.
    """

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        first = rows[0]
        data = np.array(first["points"]).reshape(-1, first["dim"])
        ids = np.array(first["ids"])
        repeated = len(np.unique(ids)) < len(ids)
        tree = CoverTree(data)
        out: list[tuple[int, int, int]] = []
        for r in rows:
            points = np.array(r["q_points"]).reshape(-1, r["dim"])
            q_ids = np.array(r["q_ids"])
            for q_rows, d_rows in dual_search(CoverTree(points), tree, np.array(r["least"])):
                scores = _scores(points[q_rows], data[d_rows])
                for i, q in enumerate(q_rows.tolist()):
                    ok = ids[d_rows] != q_ids[q]
                    found, score = ids[d_rows][ok], scores[i][ok]
                    best = np.lexsort((found, -score))
                    if repeated:
                        best = best[np.sort(np.unique(found[best], return_index=True)[1])]
                    best = best[:k]
                    out += [
                        (int(q_ids[q]), int(v), int(s))
                        for v, s in zip(found[best], score[best], strict=True)
                    ]
        columns = list(zip(*out, strict=True)) or [[], [], []]
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["query_id", "vec_id", "score"])

    return run


def _met(pairs: DataFrame, queries: DataFrame, data: DataFrame, k: int) -> DataFrame:
    """Let the blocks of ``pairs(q_block, block, least)`` meet."""
    sides = pairs.join(data.select("block", "dim", "ids", "points"), "block").join(
        queries.select(
            F.col("block").alias("q_block"), F.col("ids").alias("q_ids"), F.col("points").alias("q_points")
        ),
        "q_block",
    )
    # So many query blocks at most on average; a data block may be built in several tasks.
    share = F.pmod(F.xxhash64("q_block"), F.ceil(F.col("met") / TOGETHER))
    count = pairs.groupBy("block").agg(F.count("*").alias("met"))
    grouped = sides.join(count, "block").groupBy("block", share.alias("share"))
    return grouped.applyInArrow(_meet(k), "query_id long, vec_id long, score long")


def _best(scores: DataFrame, k: int) -> DataFrame:
    """The k best of each query; an id that occurs several times counts with its best score."""
    once = scores.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, every: int = 50, k: int = 5, scale: float = 256.0) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` best rows for each query of ``vectors(vec_id, embedding)``.

    Queries are the rows whose ``vec_id`` is divisible by ``every``; candidates are all rows with
    another ``vec_id``. The score is the inner product of floor(``scale`` * x), a 64-bit integer
    (larger products stop at the largest). Ties go to the smaller ``vec_id``; with fewer candidates
    a query has fewer ranks. Rows with a null ``vec_id``, a null or empty vector or a component that
    is null, not finite or too large to scale take no part. Vectors of different lengths do not
    meet. Rows that share a ``vec_id`` are one candidate and one query with the best of their
    scores. Other columns are ignored; an empty table gives an empty one.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    rows = written(scaled_rows(rows, scale), "rows")
    pivots = choose_pivots(rows)
    data = written(blocks_of(rows, pivots, DATA_BLOCK), "data_blocks")
    asked = rows.where(F.col("vec_id") % every == 0)
    queries = written(blocks_of(asked, pivots, QUERY_BLOCK), "query_blocks")
    dot = F.aggregate(F.zip_with("q_centre", "centre", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    norm = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x * x))
    q = queries.select(
        F.col("block").alias("q_block"), "dim", F.col("centre").alias("q_centre"),
        F.col("radius").alias("q_radius"), norm("centre").alias("q_norm"), F.size("ids").alias("asked"),
    )
    d = data.select("block", "dim", "centre", "radius", norm("centre").alias("norm"))
    # One row per pair of blocks: the root level of the traversal, over nodes without their rows.
    meta = q.join(d, "dim").withColumn("dot", dot)
    most = (
        F.col("dot") + F.col("q_norm") * F.col("radius") + F.col("norm") * F.col("q_radius")
        + F.col("q_radius") * F.col("radius")
    )
    slack = 1 + 1e-9 * (F.col("q_norm") + F.col("q_radius")) * (F.col("norm") + F.col("radius"))
    meta = written(meta.select("q_block", "block", "asked", "dot", (most + slack).alias("most")), "pairs")
    promise = W.partitionBy("q_block").orderBy(F.desc("dot"), "block")
    chosen = meta.withColumn("nth", F.row_number().over(promise)).where(F.col("nth") <= FIRST)
    nothing = F.array_repeat(F.lit(float("-inf")), F.col("asked"))
    chosen = written(chosen.select("q_block", "block", nothing.alias("least")), "chosen")
    first = written(_best(_met(chosen, queries, data, k), k).drop("rank"), "first")
    reached = first.groupBy("query_id").agg(
        F.when(F.count("*") == k, F.min("score")).alias("kth")
    )
    own = queries.select("block", F.posexplode("ids").alias("place", "query_id"))
    least = own.join(reached, "query_id", "left").groupBy(F.col("block").alias("q_block")).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("place", F.coalesce("kth", F.lit(float("-inf"))).alias("kth")))),
            lambda s: s["kth"].cast("double"),
        ).alias("least")
    )
    rest = meta.join(chosen.select("q_block", "block"), ["q_block", "block"], "left_anti")
    rest = rest.join(least, "q_block").where(F.col("most") >= F.array_min("least"))
    rest = written(rest.select("q_block", "block", "least"), "rest")
    best = _best(first.unionByName(_met(rest, queries, data, k)), k)
    return best.select("query_id", "rank", "vec_id", "score")
