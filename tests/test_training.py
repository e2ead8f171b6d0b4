import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqlab.operators import linear, training

TAGS = ["A", "B", "C"]


def examples(seed, n=300, words=30):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        w = rng.randrange(words)
        tag = TAGS[w % 3] if rng.random() < 0.8 else rng.choice(TAGS)
        out.append((i // 5, 0, i % 5, [f"w={w}", f"s={w % 4}", "flag"] + (["odd"] if w % 2 else []), tag))
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "src_id long, seg int, pos int, features array<string>, tag string")


def dense(rows):
    names = sorted({f for r in rows for f in r[3]})
    x = np.zeros((len(rows), len(names)))
    for i, r in enumerate(rows):
        x[i, [names.index(f) for f in r[3]]] = 1.0
    y = np.array([[float(r[4] == t) for t in TAGS] for r in rows])
    return names, x, y


def loss_and_gradient(x, y, w, b, reg):
    z = x @ w + b
    z -= z.max(axis=1, keepdims=True)
    p = np.exp(z)
    p /= p.sum(axis=1, keepdims=True)
    gap = (p - y) / len(x)
    return -(y * np.log(p)).sum() / len(x) + reg * (w**2).sum(), x.T @ gap + 2 * reg * w, gap.sum(axis=0)


def weights_of(model, names):
    found = {r.feature: list(r.w) for r in model.weights.collect()}
    return np.array([found.get(f, [0.0] * len(TAGS)) for f in names])


def test_lbfgs_finds_the_optimum(spark):
    rows = examples(1)
    names, x, y = dense(rows)
    out = training.lbfgs(linear.hard_targets(frame(spark, rows), TAGS), TAGS, 0.3)
    assert out.converged and out.gradient <= 1e-6
    loss, gw, gb = loss_and_gradient(x, y, weights_of(out.model, names), np.array(out.model.bias), 0.3)
    assert max(abs(gw).max(), abs(gb).max()) < 2e-6  # by hand, from the returned weights
    assert loss == pytest.approx(out.loss, abs=1e-12)


def test_lbfgs_goes_on_from_weights_when_the_vocabulary_grows(spark, heavy):
    near = {"reg": 0.1, "tolerance": 1e-3}
    first = training.lbfgs(linear.hard_targets(frame(spark, examples(1)), TAGS), TAGS, **near)
    rows = examples(1) + [(100 + i, 0, 0, [f"new{i % 7}", "flag"], TAGS[i % 3]) for i in range(20)]
    warm = training.lbfgs(linear.hard_targets(frame(spark, rows), TAGS), TAGS, start=first.model, **near)
    names, x, y = dense(rows)
    _, gw, gb = loss_and_gradient(x, y, weights_of(warm.model, names), np.array(warm.model.bias), 0.1)
    assert warm.converged and max(abs(gw).max(), abs(gb).max()) < 1.1e-3
    again = training.lbfgs(linear.hard_targets(frame(spark, rows), TAGS), TAGS, start=warm.model, **near)
    assert again.steps == 0


def test_lbfgs_with_soft_targets_and_odd_rows(spark):
    rows = frame(spark, examples(2, 60)).drop("tag")
    soft = rows.withColumn("target", F.array(F.lit(0.2), F.lit(0.5), F.lit(0.3)))
    bare = soft.withColumn("features", F.array().cast("array<string>"))
    out = training.lbfgs(bare.union(soft), TAGS, 0.5, tolerance=1e-4)
    assert np.exp(out.model.bias) / np.exp(out.model.bias).sum() == pytest.approx([0.2, 0.5, 0.3], abs=1e-2)
    assert abs(weights_of(out.model, ["flag", "odd"])).max() < 1e-2
    none = training.lbfgs(soft.limit(0), TAGS, 0.1)
    assert none.steps == 0 and none.model.weights.count() == 0


def plain_epochs(rows, reg, eta, batch, order, epochs):
    """Mini-batch descent on dense arrays, the penalty applied to every weight at every batch."""
    names, x, y = dense(rows)
    x, y = x[order], y[order]
    w, b = np.zeros((len(names), len(TAGS))), np.zeros(len(TAGS))
    for i in range(1, epochs + 1):
        rate = eta / i**0.1
        for a in range(0, len(x), batch):
            xs, ys = x[a : a + batch], y[a : a + batch]
            z = xs @ w + b
            p = np.exp(z - z.max(axis=1, keepdims=True))
            gap = ys - p / p.sum(axis=1, keepdims=True)
            w = w * (1 - 2 * reg * rate) + rate * xs.T @ gap / len(xs)
            b = b + rate * gap.mean(axis=0)
        w -= w.mean(axis=1, keepdims=True)
        b -= b.mean()
    return names, w, b


def seeded_order(spark, rows):
    from seqlab.functions.draws import draw_key

    keys = frame(spark, rows).select(draw_key(123, F.col("src_id"), F.col("seg"), F.col("pos")).alias("k")).collect()
    return np.argsort([r.k for r in keys], kind="stable")


def test_epochs_on_one_part_are_plain_descent(spark):
    rows = examples(3)
    out, losses = training.epochs(linear.hard_targets(frame(spark, rows), TAGS), TAGS, 0.01, 1.0, 0.001, batch=40, max_epochs=20)
    names, w, b = plain_epochs(rows, 0.01, 1.0, 40, seeded_order(spark, rows), 20)
    assert [e for e, _ in losses] == [10, 20]
    assert np.allclose(weights_of(out.model, names), w, atol=1e-10) and np.allclose(out.model.bias, b, atol=1e-10)
    _, x, y = dense(rows)
    assert losses[-1][1] == pytest.approx(loss_and_gradient(x, y, w, b, 0.01)[0], abs=1e-10)


def test_epochs_stop_near_the_optimum(spark):
    """The stop rule of the losses, here taken after every epoch; the last is near the best."""
    rows = linear.hard_targets(frame(spark, examples(4, 150, 9)), TAGS)
    out, losses = training.epochs(rows, TAGS, 0.05, 0.5, 0.02, batch=150, check_every=1)
    assert out.converged and out.steps == losses[-1][0] >= 11
    values = [x for _, x in losses]
    stops = [k for k in range(11, len(values) + 1) if values[k - 1] * 1.02 > np.mean(values[k - 10 : k - 1])]
    assert stops[0] == len(values)
    names, x, y = dense(examples(4, 150, 9))
    loss, gw, _ = loss_and_gradient(x, y, weights_of(out.model, names), np.array(out.model.bias), 0.05)
    assert loss == pytest.approx(out.loss, abs=1e-9) and abs(gw).max() < 0.05


def test_epochs_in_parts(spark):
    """Several parts, features that only some of them have, and a warm start."""
    rows = linear.hard_targets(frame(spark, examples(5)), TAGS)
    first, _ = training.epochs(rows, TAGS, 0.01, 0.5, 0.001, part_rows=60, max_epochs=10)
    _, losses = training.epochs(rows, TAGS, 0.01, 0.5, 0.001, start=first.model, part_rows=60, max_epochs=20)
    assert first.loss > losses[0][1] > losses[1][1]
    assert training.epochs(rows.limit(0), TAGS, 0.01, 0.5, 0.001)[1] == []


def test_epochs_with_few_and_with_many_weights(spark, monkeypatch):
    """Weights that reach each part whole, or as far as it needs them; rows without features count as they did."""
    rows = linear.hard_targets(frame(spark, examples(6, 200) + [(900 + i, 0, 0, [], TAGS[i % 3]) for i in range(5)]), TAGS)
    settings = {"part_rows": 40, "max_epochs": 20, "batch": 16}
    few, losses = training.epochs(rows, TAGS, 0.01, 0.5, 0.001, **settings)
    monkeypatch.setattr(training, "FEW_WEIGHTS", 10)
    many, same = training.epochs(rows, TAGS, 0.01, 0.5, 0.001, **settings)
    names = sorted(r.feature for r in few.model.weights.collect())
    assert np.allclose(weights_of(few.model, names), weights_of(many.model, names), atol=1e-12)
    assert np.allclose([x for _, x in losses], [x for _, x in same], atol=1e-12)


def test_descent_reads_flat_rows():
    """A large part takes seconds: there is no loop over its rows."""
    import time

    rng = np.random.default_rng(7)
    n, per, width = 20_000, 20, 500
    at = np.sort(rng.integers(0, width, (n, per)), axis=1).ravel()
    part = training.Part(at, np.arange(1, n + 1) * per, np.eye(3)[rng.integers(0, 3, n)])
    began = time.process_time()
    w, b = training.descend(part, np.zeros((3, width)), np.zeros(3), [0.5] * 10, 0.001, 100)
    assert time.process_time() - began < 2.0
    assert np.allclose(w.mean(axis=0), 0.0, atol=1e-12) and abs(b.mean()) < 1e-12
