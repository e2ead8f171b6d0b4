"""Softmax training with weights, gradients and curvature in tables.

Nothing here brings a feature name or a weight to the driver: it holds the bias, one cell per class, and
sums. Two trainers share the objective

    mean over rows of -sum_k target_k ln p_k  +  reg * (sum of squared weights)

in which the bias is free:

* :func:`lbfgs` finds the optimum. Rows with equal features are one *context* with summed targets. A step
  needs one look-up of the direction's scores by feature, one aggregate that gives the slope of the loss
  at every tried length of the step, and one gradient by feature; the two-loop recursion runs on the inner products
  of the vectors, which are one aggregate over the state table.
* :func:`epochs` makes passes of mini-batch descent in parallel parts, averages the parts' weights, and
  stops by the loss.

Both go on from given weights, also when the vocabulary has grown since.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqlab.functions.draws import draw_key
from seqlab.functions.vectors import argmax, softmax
from seqlab.operators.linear import LinearModel
from seqlab.operators.scale import heavy_keys, lookup, number_rows
from seqlab.session import discard, written
from seqlab.sources.corpora import TOKEN

BIAS = -1  # the row of the bias in a table of weights
#: Curvature pairs that are kept.
PAIRS = 5
#: Lengths of a step that one aggregate tries.
STEPS = [0.0, 0.05, 0.3, 1.0, 3.0, 12.0]
#: Weights of which each part of :func:`epochs` gets all; of more it gets those that it needs.
FEW_WEIGHTS = 100_000


class Trained(NamedTuple):
    model: LinearModel
    loss: float
    steps: int
    gradient: float  # largest entry
    converged: bool


def _vector(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def list_array(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=kind))


def _zeros(k: int) -> Column:
    return F.array_repeat(F.lit(0.0), k)


# Array expressions are written as SQL: a step has dozens of them, and each is one call that way.


def _number(x: float) -> str:
    return f"({float(x)!r}D)"


def _combined(terms: list[tuple[float, str]], k: int) -> Column:
    """The sum of array columns, each times a number."""
    used = " + ".join(f"{_number(c)} * {name}[i]" for c, name in terms if c != 0.0)
    return F.expr(f"transform(sequence(0, {k - 1}), i -> {used or '0D'})")


def _dot_sql(a: str, b: str) -> str:
    return f"aggregate(zip_with({a}, {b}, (x, y) -> x * y), 0D, (total, x) -> total + x)"


def _dot(a: str, b: str) -> Column:
    return F.expr(_dot_sql(a, b))


def _let(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` for a value that is computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _total(a: str) -> str:
    return f"aggregate({a}, 0D, (total, x) -> total + x)"


def _sums(column: str, k: int) -> Column:
    return F.array(*[F.sum(F.col(column)[i]) for i in range(k)])


def contexts(rows: DataFrame, vocab: DataFrame, k: int) -> DataFrame:
    """Rows with equal features as one: ctx, ``idx`` (the numbers of its features), n, target sums.

    Features that the vocabulary lacks are dropped. Written.
    """
    names = F.array_sort(F.array_distinct("features")).alias("features")
    each = rows.select(names, "target").groupBy("features").agg(F.count(F.lit(1)).alias("n"), _sums("target", k).alias("target"))
    each = written(each.withColumn("ctx", F.monotonically_increasing_id()), "contexts")
    long = each.select("ctx", F.explode("features").alias("feature"))
    found = long.join(vocab.select("feature", "idx"), "feature").groupBy("ctx").agg(F.collect_list("idx").alias("idx"))
    joined = each.join(found, "ctx", "left").select("ctx", F.coalesce("idx", F.array().cast("array<long>")).alias("idx"), "n", "target")
    out = written(joined, "contexts")
    discard(each)
    return out


def _frequent(table: DataFrame) -> DataFrame | None:
    """(idx, n) for look-ups when some feature is heavy, else None."""
    freq = table.select(F.explode("idx").alias("idx")).groupBy("idx").agg(F.count(F.lit(1)).alias("n"))
    return None if heavy_keys(freq).isEmpty() else written(freq, "frequencies")


def _scores(table: DataFrame, vectors: DataFrame, bias, k: int, freq: DataFrame | None) -> DataFrame:
    """(ctx, d): the sum of the vectors ``d`` of a context's features, and of the bias."""
    each = table.select("ctx", F.explode_outer("idx").alias("idx"))
    found = lookup(each, vectors, ["idx"], freq)
    cells = [F.coalesce(F.sum(F.col("d")[i]), F.lit(0.0)) + F.lit(float(bias[i])) for i in range(k)]
    return found.groupBy("ctx").agg(F.array(*cells).alias("d"))


def _log_total(z: str) -> str:
    return _let(f"array_max({z})", "top", f"top + ln({_total(f'transform({z}, x -> exp(x - top))')})")


def _ahead(t: float) -> str:
    """The scores of a context after a step of length ``t`` along the direction."""
    return f"zip_with(z, d, (a, b) -> a + {_number(t)} * b)"


def _slopes(steps: list[float]) -> list[Column]:
    """The slope of the data's loss along the direction at each of the steps, summed over contexts."""
    gap = "zip_with(target, e, (y, x) -> n * x / whole - y)"
    outs = []
    for j, t in enumerate(steps):
        slope = _let(_total("e"), "whole", _dot_sql(gap, "d"))
        slope = _let("transform(moved, x -> exp(x - array_max(moved)))", "e", slope)
        outs.append(F.expr(f"sum({_let(_ahead(t), 'moved', slope)})").alias(f"slope{j}"))
    return outs


def _gradient(table: DataFrame, k: int, n_rows: int) -> DataFrame:
    """(idx, part): the mean gradient of the data by feature, with that of the bias."""
    gap = F.zip_with("target", softmax(F.col("z")), lambda y, p: (F.col("n") * p - y) / F.lit(float(n_rows)))
    each = table.select(F.explode(F.concat("idx", F.array(F.lit(BIAS).cast("long")))).alias("idx"), gap.alias("gap"))
    return each.groupBy("idx").agg(_sums("gap", k).alias("part"))


def _direction(m: np.ndarray, order: list[int]) -> np.ndarray:
    """The two-loop recursion on inner products: coefficients of the descent direction.

    ``m`` holds the products of s_0.., y_0.., the gradient and the weights; ``order`` the kept pairs, oldest first.
    """
    out = np.zeros(len(m))
    out[2 * PAIRS] = -1.0
    alpha = {}
    for j in reversed(order):
        alpha[j] = (out @ m[:, j]) / m[j, PAIRS + j]
        out[PAIRS + j] -= alpha[j]
    if order:
        j = order[-1]
        out *= m[j, PAIRS + j] / m[PAIRS + j, PAIRS + j]
    for j in order:
        out[j] += alpha[j] - (out @ m[:, PAIRS + j]) / m[j, PAIRS + j]
    return out


def _root(steps: list[float], slopes: list[float]) -> float:
    """Where the slope along the line, which never falls, passes zero; near 1 the full step is taken."""
    one = steps.index(1.0)
    if abs(slopes[one]) <= 0.1 * abs(slopes[0]):
        return 1.0
    for a, b, sa, sb in zip(steps, steps[1:], slopes, slopes[1:]):
        if sb >= 0.0:
            return a + (b - a) * (-sa / (sb - sa)) if sb > sa else b
    return steps[-1]


def numbered_features(rows: DataFrame, start: LinearModel | None) -> DataFrame:
    """(feature, idx): the features of the rows and of the model to start from. Written."""
    names = rows.select(F.explode("features").alias("feature"))
    if start is not None:
        names = names.union(start.weights.select("feature"))
    return written(number_rows(names.distinct(), [], ["feature"], None, "idx"), "vocabulary")


def _first_weights(vocab: DataFrame, start: LinearModel | None, k: int) -> DataFrame:
    if start is None:
        return vocab.select("idx", _zeros(k).alias("w"))
    known = vocab.join(start.weights.select("feature", "w"), "feature", "left")
    return known.select("idx", F.coalesce("w", _zeros(k)).alias("w"))


def lbfgs(
    rows: DataFrame,
    tags: list[str],
    reg: float,
    start: LinearModel | None = None,
    max_steps: int = 200,
    tolerance: float = 1e-6,
    vocab: DataFrame | None = None,
) -> Trained:
    """The optimum for ``rows`` (``features``, ``target`` per class), up to gradient entries of ``tolerance``.

    Starts from zero, or from ``start``, whose features need not be those of the rows. Without rows the
    weights stay as they are. ``vocab`` (feature, idx) leaves other features out; else all of the rows and
    of ``start`` count.
    """
    k = len(tags)
    vocab = numbered_features(rows, start) if vocab is None else vocab.select("feature", "idx")
    table = contexts(rows, vocab, k)
    n_rows = table.agg(F.sum("n")).first()[0] or 0
    bias = [0.0] * k if start is None else list(start.bias)
    first = written(_first_weights(vocab, start, k), "weights")
    if not n_rows:
        return Trained(_packed(vocab, first, bias, tags), 0.0, 0, 0.0, True)
    freq = _frequent(table)
    names = [f"s{j}" for j in range(PAIRS)] + [f"y{j}" for j in range(PAIRS)] + ["g", "w"]
    size = len(names)
    free = (F.col("idx") != BIAS).cast("double")  # the bias is not drawn to zero

    def state_of(weights: DataFrame, line: DataFrame, more: list[Column]) -> DataFrame:
        """The weights with their gradient at the scores of ``line``, and further columns."""
        data = weights.join(_gradient(line, k, n_rows), "idx", "left")
        part = F.coalesce("part", _zeros(k))
        g = F.zip_with(part, "w", lambda a, b: a + F.lit(2.0 * reg) * free * b)
        return written(data.withColumn("g_new", g).select("idx", "w", *more, F.col("g_new").alias("g")), "training_state")

    def products(state: DataFrame, fresh: list[str], old: np.ndarray | None):
        """Inner products of the fresh vectors with all, the largest gradient entry, the bias row."""
        pairs = [(a, b) for a in fresh for b in names if b not in fresh or a <= b]
        # The weights' own products leave out the bias, which the penalty does not see.
        free_sql = f"double(idx <> {BIAS})"
        cells = [F.expr(f"sum({_dot_sql(a, b)} * {free_sql if 'w' in (a, b) else '1D'})") for a, b in pairs]
        own = [F.max(F.when(F.col("idx") == BIAS, F.col(c))) for c in ("w", "g", *names[: 2 * PAIRS])]
        top = F.max(F.array_max(F.transform("g", lambda x: F.abs(x))))
        got = state.agg(*cells, *own, top).first()
        m = np.zeros((size, size)) if old is None else old.copy()
        for (a, b), v in zip(pairs, got):
            m[names.index(a), names.index(b)] = m[names.index(b), names.index(a)] = v
        rest = got[len(pairs) :]
        at_bias = dict(zip(("w", "g", *names[: 2 * PAIRS]), (np.array(x) for x in rest)))
        return m, at_bias, float(rest[-1])

    weights = first.union(first.sparkSession.range(1).select(F.lit(BIAS).cast("long"), _vector(bias)))
    scored = _scores(table, first.select("idx", F.col("w").alias("d")), bias, k, freq)
    line = written(table.join(scored, "ctx").select("ctx", "idx", "n", "target", F.col("d").alias("z")), "line")
    current = line
    state = state_of(weights, current, [_zeros(k).alias(c) for c in names[: 2 * PAIRS]])
    m, at_bias, top = products(state, names, None)
    order: list[int] = []
    step = 0
    while top > tolerance and step < max_steps:
        delta = _direction(m, order)
        if not order:
            delta /= max(1.0, np.sqrt(m[2 * PAIRS, 2 * PAIRS]))
        terms = list(zip(delta, names))
        d_bias = sum(c * at_bias[name] for c, name in terms)
        d = state.where(F.col("idx") != BIAS).select("idx", _combined(terms, k).alias("d"))
        moved = written(current.join(_scores(table, d, d_bias, k, freq), "ctx"), "line")
        found = moved.agg(*_slopes(STEPS)).first()
        # What the penalty sees: products with w leave out the bias, those of the direction do not.
        w_d = float(delta @ m[:, -1])
        d_d = float(delta @ m @ delta) - float(d_bias @ d_bias)
        slopes = [found[f"slope{j}"] / n_rows + 2 * reg * (w_d + t * d_d) for j, t in enumerate(STEPS)]
        t = _root(STEPS, slopes)
        slot = step % PAIRS
        following = moved.select("ctx", "idx", "n", "target", F.expr(_ahead(t)).alias("z"))
        step_by = _combined([(t * c, name) for c, name in terms], k)
        weights = state.withColumn("step", step_by).select(
            "idx", F.zip_with("w", "step", lambda a, b: a + b).alias("w"), F.col("g").alias("g_old"), "step",
            *[c for c in names[: 2 * PAIRS] if c not in (f"s{slot}", f"y{slot}")],
        )
        more = [
            F.col("step").alias(c) if c == f"s{slot}"
            else F.zip_with("g_new", "g_old", lambda a, b: a - b).alias(c) if c == f"y{slot}"
            else F.col(c)
            for c in names[: 2 * PAIRS]
        ]
        after = state_of(weights, following, more)
        for old in (state, line):
            discard(old)
        state, line, current = after, moved, following
        m, at_bias, top = products(state, [f"s{slot}", f"y{slot}", "g", "w"], m)
        order = [j for j in order if j != slot] + ([slot] if m[slot, PAIRS + slot] > 0.0 else [])
        step += 1
    model = _packed(vocab, written(state.where(F.col("idx") != BIAS).select("idx", "w"), "weights"), at_bias["w"], tags)
    final = current.agg(F.expr(f"sum(n * {_log_total('z')} - {_dot_sql('target', 'z')})")).first()[0]
    loss = final / n_rows + reg * m[-1, -1]
    for old in (state, line, first, table):
        discard(old)
    return Trained(model, loss, step, top, top <= tolerance)


def _packed(vocab: DataFrame, weights: DataFrame, bias, tags: list[str]) -> LinearModel:
    named = vocab.join(weights, "idx").select("feature", "w")
    return LinearModel(tags, written(named, "model"), [float(b) for b in bias])


# Mini-batches


class Part(NamedTuple):
    """The rows of a part as flat arrays: ``at`` holds the columns of all rows one after another."""

    at: np.ndarray
    ends: np.ndarray  # where the columns of each row end
    y: np.ndarray  # targets, a row each

    def sums(self, w: np.ndarray, low: int, high: int) -> np.ndarray:
        """Sums of the weights of the rows from ``low`` to ``high``, a row of them for each class of ``w``."""
        begin = int(self.ends[low - 1]) if low else 0
        ends = self.ends[low:high] - begin
        starts = np.concatenate([[0], ends[:-1]])
        some = np.flatnonzero(ends > starts)  # sums over no columns are none
        out = np.zeros((len(w), high - low))
        if len(some):
            cells = w.take(self.at[begin : begin + int(ends[-1])], axis=1)
            out[:, some] = np.add.reduceat(cells, starts[some], axis=1)
        return out


def descend(part: Part, w: np.ndarray, b: np.ndarray, rates: list[float], reg: float, batch: int):
    """Passes over the rows in order, one per rate, in batches; ``w`` has a row for each class.

    Weights are kept as ``scale * w``, so that the penalty shrinks all of them by one product; after
    each pass every feature's mean over the classes, and that of the bias, is taken away.
    """
    n, k = part.y.shape
    batches = []
    for low in range(0, n, batch):
        high = min(low + batch, n)
        begin, end = (int(part.ends[low - 1]) if low else 0), int(part.ends[high - 1])
        of = np.repeat(np.arange(high - low), np.diff(part.ends[low:high], prepend=begin))
        cells = (part.at[begin:end] + np.arange(k)[:, None] * w.shape[1]).ravel()
        batches.append((low, high, of, cells, part.y[low:high].T.copy()))
    w, b = w.copy(), b.copy()
    flat = w.reshape(-1)  # the same numbers, the classes one after another
    for rate in rates:
        scale = 1.0
        for low, high, of, cells, y in batches:
            scores = part.sums(w, low, high) * scale + b[:, None]
            p = np.exp(scores - scores.max(axis=0))
            gap = y - p / p.sum(axis=0)
            keep = 1.0 - 2.0 * reg * rate
            b += gap.mean(axis=1) * rate
            gap *= rate / (scale * keep) / (high - low)
            np.add.at(flat, cells, gap.take(of, axis=1).ravel())
            scale *= keep
            if scale < 1e-3:
                w *= scale
                scale = 1.0
        w *= scale
        w -= w.mean(axis=0)
        b -= b.mean()
    return w, b


def _packed_part(table: pa.Table) -> pa.Table:
    """The rows of one part, (part, order, features, target), as one row of arrays in their order.

    ``names`` are the features of the part in the order of their bytes; ``at`` says for each feature of each row,
    sorted within the row, where its name stands.
    """
    table = table.take(pc.sort_indices(table, sort_keys=[("order", "ascending")])).combine_chunks()
    features, target = (pa.concat_arrays(table.column(c).chunks) for c in ("features", "target"))
    counts = features.value_lengths().to_numpy(zero_copy_only=False)
    coded = features.flatten().dictionary_encode()
    by_name = pc.sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(by_name), np.int64)
    rank[by_name] = np.arange(len(by_name))
    at = rank[coded.indices.to_numpy(zero_copy_only=False)] if len(by_name) else np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(counts)), counts)
    at = at[np.lexsort((at, row))]
    columns = {
        "part": pa.array([table.column("part")[0].as_py()], pa.int32()),
        "names": pa.array([coded.dictionary.take(pa.array(by_name))], pa.list_(pa.string())),
        "at": list_array(at.astype(np.int32), np.array([len(at)]), pa.int32()),
        "ends": list_array(np.cumsum(counts).astype(np.int32), np.array([len(counts)]), pa.int32()),
        "target": list_array(target.flatten().to_numpy(zero_copy_only=False), np.array([len(target.flatten())]), pa.float64()),
    }
    return pa.table(columns)


PACKED = "part int, names array<string>, at array<int>, ends array<int>, target array<double>"


def stopped(losses: list[float], improvement: float) -> bool:
    """The rule of :func:`selection.early_stop` for one run whose losses are at hand."""
    return len(losses) > 10 and losses[-1] * (1 + improvement) > float(np.mean(losses[-10:-1]))


def epochs(
    rows: DataFrame,
    tags: list[str],
    reg: float,
    eta: float,
    improvement: float,
    start: LinearModel | None = None,
    batch: int = 100,
    check_every: int = 10,
    max_epochs: int = 1000,
    part_rows: int = 50_000,
    seed: int = 123,
) -> tuple[Trained, list[tuple[int, float]]]:
    """Mini-batch descent that stops by its loss, and the losses: (epoch, loss).

    ``rows``: token key, ``features``, ``target``. They are dealt by a seeded hash of their key to parts of about
    ``part_rows``, and lie in a seeded order in each. Epoch i has the rate ``eta / i^0.1``. Every ``check_every``
    epochs the weights of the parts are averaged, weighted by their rows; a part that lacks a feature
    counts with what the penalty left of its weight. Then the loss is taken; training ends when it no
    longer beats the mean of the nine before it by ``improvement``. With one part this is plain mini-batch descent.
    """
    k, batch_rows = len(tags), batch
    vocab = numbered_features(rows, start)
    key = draw_key(seed, *[F.col(c) for c in TOKEN])
    named = rows.select(*TOKEN, F.array_distinct("features").alias("features"), "target")
    n_rows = named.count()
    parts = max(1, -(-n_rows // part_rows))
    bias = np.zeros(k) if start is None else np.array(start.bias)
    weights = written(_first_weights(vocab, start, k), "weights")
    if not n_rows:
        return Trained(_packed(vocab, weights, bias, tags), 0.0, 0, 0.0, True), []
    # A row whose key is not whole counts, but is in no part.
    whole_key = reduce(lambda x, y: x & y, [F.col(c).isNotNull() for c in TOKEN])
    names = F.coalesce(F.filter("features", lambda f: f.isNotNull()), F.array().cast("array<string>"))
    dealt = named.where(whole_key).select(key.alias("order"), names.alias("features"), "target")
    dealt = dealt.select(F.pmod(F.xxhash64("order"), F.lit(parts)).cast("int").alias("part"), "order", "features", "target")
    # Each part is one row of arrays from here on: passes read it where it lies, only weights move.
    packed = written(dealt.groupBy("part").applyInArrow(_packed_part, PACKED), "packed")
    each = packed.select("part", F.explode("names").alias("feature")).join(vocab, "feature")
    needed = written(each.select("part", "idx"), "needed")
    known = needed.groupBy("part").agg(F.array_sort(F.collect_list("idx")).alias("idx"))
    # Names are numbered in their order, so the numbers of a part lie as its names do.
    examples = written(packed.drop("names").join(known, "part", "left"), "examples")
    discard(packed)
    few = vocab.limit(FEW_WEIGHTS // k + 1).count() <= FEW_WEIGHTS // k

    def with_weights(weights: DataFrame) -> DataFrame:
        """The parts with the weights that they need: all of them where they are few."""
        rows = F.collect_list(F.struct("idx", "w")).alias("weights")
        if few:
            return examples.crossJoin(F.broadcast(weights.agg(rows)))
        held = needed.join(weights, "idx").groupBy("part").agg(rows)
        return examples.join(held, "part", "left")

    def per_part(weights: DataFrame, bias: np.ndarray, rates: list[float]) -> DataFrame:
        """Rows (idx, n, kept, w) of each part after passes with ``rates``; the row of the bias carries the loss
        before them."""

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for piece in (batch.slice(i, 1) for batch in batches for i in range(batch.num_rows)):
                held = piece.column("weights").flatten()
                numbers = held.field("idx").to_numpy() if len(held) else np.zeros(0, np.int64)
                cells = held.field("w").flatten().to_numpy(zero_copy_only=False).reshape(-1, k) if len(held) else np.zeros((0, k))
                at, ends, y, idx = (
                    piece.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("at", "ends", "target", "idx")
                )
                by_number = np.argsort(numbers)
                w = np.ascontiguousarray(cells[by_number[np.searchsorted(numbers, idx, sorter=by_number)]].T)
                part = Part(at.astype(np.intp), ends, y.reshape(-1, k))
                scores = part.sums(w, 0, len(ends)).T + bias
                top = scores.max(axis=1)
                total = top + np.log(np.exp(scores - top[:, None]).sum(axis=1))
                loss = float((total * part.y.sum(axis=1) - (part.y * scores).sum(axis=1)).sum())
                b = bias
                if rates:
                    w, b = descend(part, w, bias, rates, reg, batch_rows)
                kept = float(np.prod([(1.0 - 2.0 * reg * r) ** -(-len(ends) // batch_rows) for r in rates]))
                out = np.concatenate([w.T, b[None]]).ravel()
                losses = np.zeros(len(idx) + 1)
                losses[-1] = loss
                columns = [
                    pa.array(np.append(idx, BIAS), pa.int64()),
                    pa.array(np.full(len(idx) + 1, len(ends)), pa.int64()),
                    pa.array(np.full(len(idx) + 1, kept)),
                    pa.array(losses),
                    list_array(out, np.full(len(idx) + 1, k), pa.float64()),
                ]
                if not rates:  # only the loss is asked for
                    columns = [c.slice(len(idx)) for c in columns]
                yield pa.RecordBatch.from_arrays(columns, ["idx", "n", "kept", "loss", "w"])

        schema = "idx long, n long, kept double, loss double, w array<double>"
        return with_weights(weights).mapInArrow(work, schema)

    def loss_of(weights: DataFrame, bias: np.ndarray) -> float:
        data = per_part(weights, bias, []).where(F.col("idx") == BIAS).agg(F.sum("loss")).first()[0]
        norm = weights.agg(F.sum(_dot("w", "w"))).first()[0] or 0.0
        return data / n_rows + reg * norm

    epoch, losses = 0, []
    done = False
    while epoch < max_epochs and not done:
        rates = [eta / i**0.1 for i in range(epoch + 1, epoch + 1 + check_every)]
        results = written(per_part(weights, bias, rates), "part_weights")
        sums = results.groupBy("idx").agg(
            F.array(*[F.sum(F.col("w")[i] * F.col("n")) for i in range(k)]).alias("sum"),
            F.sum(F.col("n") * F.col("kept")).alias("met"),
        )
        ends = results.where(F.col("idx") == BIAS)
        all_kept = ends.agg(F.sum(F.col("n") * F.col("kept"))).first()[0]
        mean = sums.where(F.col("idx") == BIAS).first()["sum"]
        met = F.coalesce("met", F.lit(0.0))
        joined = weights.join(sums.where(F.col("idx") != BIAS), "idx", "left")
        average = F.zip_with(
            "w", F.coalesce("sum", _zeros(k)), lambda a, s: (s + a * (F.lit(all_kept) - met)) / F.lit(float(n_rows))
        )
        # Where every part met the feature nothing is left over but a rounding error.
        whole = F.transform("sum", lambda s: s / F.lit(float(n_rows)))
        after = written(joined.select("idx", F.when(met >= F.lit(all_kept), whole).otherwise(average).alias("w")), "weights")
        for old in (weights, results):
            discard(old)
        weights, bias = after, np.array(mean) / n_rows
        epoch += check_every
        losses.append((epoch, loss_of(weights, bias)))
        done = stopped([x for _, x in losses], improvement)
    model = _packed(vocab, weights, bias, tags)
    for old in (weights, examples, needed):
        discard(old)
    return Trained(model, losses[-1][1], epoch, float("nan"), done), losses


def class_shares(probs: DataFrame, tags: list[str]) -> DataFrame:
    """Per class: how many rows have it as ``tag``, its mean probability, how often it comes out."""
    each = probs.select("tag", argmax(F.col("p")).alias("best"), F.posexplode("p").alias("class_id", "p"))
    own = F.element_at(F.array(*[F.lit(t) for t in tags]), F.col("class_id") + 1)
    return each.groupBy("class_id").agg(
        F.sum((F.col("tag") == own).cast("long")).alias("n"),
        F.avg("p").alias("mean_p"),
        F.sum((F.col("best") == F.col("class_id")).cast("long")).alias("n_best"),
    )
