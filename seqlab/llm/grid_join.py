"""Embedding near-dedup by an epsilon grid order join.

Two vectors of one label link when their cosine reaches a threshold, that is, when the unit
vectors are at most ``epsilon`` apart. Unit vectors are laid on leading principal axes and
ordered by the cells of a grid of width epsilon. The sequence is cut into blocks of bounded
size, each with the box of its projections. Blocks whose boxes are further apart than epsilon in
the leading axes cannot hold a link and never meet; blocks that meet are joined by halving both
sequences again and again, dropping halves that are provably distant, down to exact products.

Equal vectors are one point with a weight. What a pair of blocks returns is a count per point and
a spanning forest of its links, never the pairs. The axes are fitted on at most ``SAMPLE`` vectors
(any orthonormal axes give right results, principal ones prune best); all vectors are joined.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqlab.llm.components import Forest, components
from seqlab.session import written

SAMPLE = 4096
#: Axes that order the grid, axes of the boxes, rows of a block, rows compared at once.
GRID, AXES = 4, 8
BLOCK, LEAF = 512, 64
SLACK = 1e-9


def unit_rows(vectors: DataFrame) -> DataFrame:
    """label, dim, vec_id, unit of the vectors that can link: finite, not zero, with a label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, units = [], []
            for k, v in enumerate(batch.column(2).to_pylist()):
                x = np.array([np.nan if c is None else c for c in v or []], np.float64)
                top = np.abs(x).max() if len(x) else 0.0
                if top > 0 and np.isfinite(top) and np.isfinite(x).all():
                    x = x / top
                    keep.append(k)
                    units.append(x / np.sqrt(x @ x))
            rows = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column(0),
                    pa.array([len(u) for u in units], pa.int32()),
                    rows.column(1),
                    rows.column(3),
                    rows.column(4),
                    pa.array(units, pa.list_(pa.float64())),
                ],
                ["label", "dim", "vec_id", "copies", "shape", "unit"],
            )

    wanted = vectors.select("label", "vec_id", "embedding", "copies", "shape")
    return wanted.mapInArrow(
        run, "label long, dim int, vec_id long, copies long, shape long, unit array<double>"
    )


def principal_axes(units: DataFrame) -> dict[int, np.ndarray]:
    """Axes for each number of dimensions in a sample of at most ``SAMPLE`` rows."""
    rows = units.select("dim", "unit").orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()
    by_dim: dict[int, list] = {}
    for r in rows:
        by_dim.setdefault(r.dim, []).append(r.unit)
    axes = {}
    for dim, own in by_dim.items():
        x = np.array(own)
        _, v = np.linalg.eigh((x - x.mean(axis=0)).T @ (x - x.mean(axis=0)))
        axes[dim] = v[:, ::-1][:, :AXES]
    return axes


def _on_axes(matrix: np.ndarray, axes: dict[int, np.ndarray]) -> np.ndarray:
    own = axes.get(matrix.shape[1])
    flat = matrix[:, :AXES] if own is None else matrix @ own
    return np.pad(flat, ((0, 0), (0, AXES - flat.shape[1])))


def grid_ordered(units: DataFrame, axes: dict[int, np.ndarray], epsilon: float) -> DataFrame:
    """Rows in the order of their cells, over all partitions; equal cells may be split."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = [
                np.floor(_on_axes(np.array([u]), axes)[0, :GRID] / epsilon).astype(int).tolist()
                for u in batch.column(5).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(cells, pa.list_(pa.int32()))],
                [*batch.schema.names, "cell"],
            )

    schema = "label long, dim int, vec_id long, copies long, shape long, unit array<double>, cell array<int>"
    keys = ["label", "dim", *(F.col("cell")[k] for k in range(GRID)), "vec_id"]
    return units.mapInArrow(run, schema).repartitionByRange(*keys).sortWithinPartitions(*keys)


BLOCKS = (
    "block long, label long, dim int, low array<double>, high array<double>, "
    "ids array<long>, copies array<long>, shapes array<long>, points array<double>"
)


def _blocks(ordered: DataFrame, axes: dict[int, np.ndarray]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        names = [c.split()[0] for c in BLOCKS.split(", ")]
        for batch in batches:
            keys = np.stack([batch.column(k).to_numpy() for k in (0, 1)], axis=1)
            change = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            bounds = [0, *change.tolist(), len(batch)]
            rows = []
            for start, stop in zip(bounds[:-1], bounds[1:], strict=True):
                for k in range(start, stop, BLOCK):
                    part = batch.slice(k, min(BLOCK, stop - k))
                    points = np.array(part.column(5).to_pylist())
                    flat = _on_axes(points, axes)
                    rows.append(
                        [number, *keys[k].tolist(), flat.min(axis=0), flat.max(axis=0)]
                        + [part.column(c).to_numpy() for c in (2, 3, 4)]
                        + [points.ravel()]
                    )
                    number += 1
            if rows:
                schema = pa.schema([(n, _KIND[n]) for n in names])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, schema.field(k).type) for k, c in enumerate(zip(*rows, strict=True))],
                    schema=schema,
                )

    return ordered.mapInArrow(run, BLOCKS)


_LONGS, _DOUBLES = pa.list_(pa.int64()), pa.list_(pa.float64())
_KIND = {
    "block": pa.int64(), "label": pa.int64(), "dim": pa.int32(), "low": _DOUBLES, "high": _DOUBLES,
    "ids": _LONGS, "copies": _LONGS, "shapes": _LONGS, "points": _DOUBLES,
}


def _block_pairs(blocks: DataFrame, epsilon: float) -> DataFrame:
    """Pairs of blocks whose boxes are within epsilon, from rows without their points.

    Blocks meet by the cells that they cover on the first axis, one of them widened by one.
    """
    meta = blocks.select("block", "label", "dim", "low", "high")
    cell = lambda c: F.floor(F.col(c)[0] / epsilon).cast("int")
    left = meta.withColumn("cell", F.explode(F.sequence(cell("low"), cell("high"))))
    right = meta.withColumn("cell", F.explode(F.sequence(cell("low") - 1, cell("high") + 1)))
    right = right.select("label", "dim", "cell", *[F.col(c).alias(f"{c}_2") for c in ("block", "low", "high")])
    gap = F.zip_with(
        F.zip_with("low_2", "high", lambda a, b: a - b),
        F.zip_with("low", "high_2", lambda a, b: a - b),
        lambda a, b: F.greatest(a, b, F.lit(0.0)),
    )
    square = F.aggregate(gap, F.lit(0.0), lambda s, g: s + g * g)
    near = left.join(right, ["label", "dim", "cell"]).where(
        (F.col("block") <= F.col("block_2")) & (square <= (epsilon + SLACK) ** 2)
    )
    pairs = near.select("block", "block_2").distinct()
    return pairs.select(
        F.xxhash64("block", "block_2").alias("pair"),
        F.explode(F.array_distinct(F.array("block", "block_2"))).alias("block"),
    )


def _join_blocks(epsilon: float, threshold: float):
    def run(table: pa.Table) -> pa.Table:
        sides = table.sort_by("block").to_pylist()
        first, last = sides[0], sides[-1]
        same = len(sides) == 1
        a = np.array(first["points"]).reshape(-1, first["dim"])
        b = a if same else np.array(last["points"]).reshape(-1, last["dim"])
        copies_a, copies_b = np.array(first["copies"]), np.array(last["copies"])
        n, m = len(a), len(b)
        counts_a, counts_b = np.zeros(n, np.int64), np.zeros(m, np.int64)
        forest, edges = Forest(n if same else n + m), []

        def distant(i: slice, j: slice) -> bool:
            gap = np.maximum(a[i].min(axis=0) - b[j].max(axis=0), b[j].min(axis=0) - a[i].max(axis=0))
            gap = np.maximum(gap, 0)
            return gap @ gap > (epsilon + SLACK) ** 2

        def visit(i: slice, j: slice) -> None:
            if (same and j.stop <= i.start) or distant(i, j):
                return
            wide_i, wide_j = i.stop - i.start > LEAF, j.stop - j.start > LEAF
            if wide_i or wide_j:
                for x in _halves(i) if wide_i else [i]:
                    for y in _halves(j) if wide_j else [j]:
                        visit(x, y)
                return
            linked = a[i] @ b[j].T >= threshold
            if same:  # each pair once; halves of one block may overlap themselves
                rows = np.arange(i.start, i.stop)[:, None]
                linked &= rows < np.arange(j.start, j.stop)
            np.add.at(counts_a, np.arange(i.start, i.stop), linked @ copies_b[j])
            np.add.at(counts_b, np.arange(j.start, j.stop), linked.T @ copies_a[i])
            for x, y in np.argwhere(linked).tolist():
                x, y = i.start + x, j.start + y
                if forest.union(x, y if same else n + y):
                    edges.append((first["ids"][x], last["ids"][y]))

        visit(slice(0, n), slice(0, m))
        rows = [(v, s, None, int(c)) for v, s, c in zip(first["ids"], first["shapes"], counts_a, strict=True) if c]
        rows += [(v, s, None, int(c)) for v, s, c in zip(last["ids"], last["shapes"], counts_b, strict=True) if c]
        rows += [(x, None, y, None) for x, y in edges]
        columns = list(zip(*rows, strict=True)) or [[], [], [], []]
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["a", "shape", "b", "n"])

    return run


def _halves(s: slice) -> list[slice]:
    middle = (s.start + s.stop) // 2
    return [slice(s.start, middle), slice(middle, s.stop)]


def near(vectors: DataFrame, threshold: float = 0.93) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of ``vectors(vec_id, embedding, label)``.

    Rows link when their labels are equal and the cosine, in double precision, is at least
    ``threshold`` (above 0). Null or zero vectors, vectors with a null or non-finite component
    and rows without a label or ``vec_id`` link with nothing: they are their own component and
    kept (with a null id, the component is null). Vectors of different lengths never link.
    ``n_links`` counts rows, so an equal vector is a link; rows that share a ``vec_id`` are in
    one component. Other columns are ignored; an empty table gives an empty one.
    """
    epsilon = float(np.sqrt(2 - 2 * threshold))
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.col("label").cast("long").alias("label"),
        F.col("embedding").cast("array<double>").alias("embedding"),
    ).withColumn("shape", F.xxhash64("label", "embedding"))
    key = ["shape", "label", "embedding"]
    ready = rows.where("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL")
    points = ready.groupBy(*key).agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies"))
    points = written(points, "points")
    units = written(unit_rows(points), "units")
    axes = principal_axes(units)
    blocks = written(_blocks(grid_ordered(units, axes, epsilon), axes), "blocks")
    sides = _block_pairs(blocks, epsilon).join(
        blocks.select("block", "dim", "ids", "copies", "shapes", "points"), "block"
    )
    schema = "a long, shape long, b long, n long"
    links = written(sides.groupBy("pair").applyInArrow(_join_blocks(epsilon, threshold), schema), "links")
    counts = links.where("b IS NULL").groupBy(F.col("a").alias("vec_id"), "shape").agg(F.sum("n").alias("n"))
    linked = components(written(links.where("b IS NOT NULL").select("a", "b"), "links"))
    linked = linked.select(F.col("id").alias("vec_id"), "component")
    valid = units.select("vec_id", "shape", F.lit(True).alias("valid"))
    named = points.join(valid, ["vec_id", "shape"]).join(counts, ["vec_id", "shape"], "left")
    named = named.join(linked, "vec_id", "left").select(
        *key,
        (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"),
        F.coalesce("component", "vec_id").alias("component_id"),
    )
    found = rows.join(written(named, "named"), key, "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
    )
    # Without an id a row is no copy of the others, though its vector may equal theirs.
    apart = F.col("vec_id").isNull()
    return found.select(
        "vec_id",
        F.when(apart, 0).otherwise(F.col("n_links")).alias("n_links"),
        F.when(~apart, F.col("component_id")).alias("component_id"),
        F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"),
    )
