import math

import numpy as np
import pytest

from seqlab.llm import cover_tree

SCHEMA = "vec_id long, embedding array<float>, rank string"


def brute(rows, every=50, k=5):
    good = {}
    for v, e, _ in rows:
        e = [np.float32(c) if c is not None else None for c in e or []]
        if v is not None and e and all(c is not None and np.isfinite(c) for c in e):
            good.setdefault(v, []).append([math.floor(256 * float(c)) for c in e])
    out = []
    for q in good:
        if q % every == 0:
            scores = {}
            for v in good:
                if v != q:
                    for a in good[q]:
                        for b in good[v]:
                            if len(a) == len(b):
                                s = max(-cover_tree.LONG, min(cover_tree.LONG, sum(x * y for x, y in zip(a, b))))
                                scores[v] = max(s, scores.get(v, s))
            best = sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:k]
            out += [(q, r + 1, v, s) for r, (v, s) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("data_block,query_block", [(16, 4), (512, 128)])
def test_brute_force(spark, monkeypatch, data_block, query_block):
    monkeypatch.setattr(cover_tree, "DATA_BLOCK", data_block)
    monkeypatch.setattr(cover_tree, "QUERY_BLOCK", query_block)
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(12, 8))
    rows = [
        (k, [float(c) for c in centres[rng.integers(12)] + rng.normal(size=8) * 0.1], "x") for k in range(600)
    ]
    rows += [(1000 + k, rows[50][1], "x") for k in range(12)] + [(50, rows[51][1], "x"), (50, rows[50][1], "x")]
    rows += [
        (700, None, "x"), (None, rows[1][1], "x"), (701, [float("nan")] * 8, "x"), (702, [None] * 8, "x"),
        (703, [], "x"), (750, [0.5, 0.5], "x"), (751, [0.25, -1.0], "x"), (800, [0.0] * 8, "x"),
        (900, [1e30] * 8, "x"), (850, [-1.0] * 8, "x"),
    ]
    got = cover_tree.top_k(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(tuple(r) for r in got) == brute(rows)


@pytest.mark.parametrize("copies,data_block,query_block", [(2, 16, 4), (7, 16, 4), (2, 512, 128)])
def test_repeated_rows(spark, monkeypatch, copies, data_block, query_block):
    """Every row several times over, and ids with several vectors."""
    monkeypatch.setattr(cover_tree, "DATA_BLOCK", data_block)
    monkeypatch.setattr(cover_tree, "QUERY_BLOCK", query_block)
    rng = np.random.default_rng(copies)
    centres = rng.normal(size=(6, 8))
    rows = [(k % 150, [float(c) for c in centres[k % 6] + rng.normal(size=8) * 0.1], "x") for k in range(200)]
    docs = spark.createDataFrame(rows * copies, SCHEMA)
    assert sorted(tuple(r) for r in cover_tree.top_k(docs).collect()) == brute(rows)


def test_empty(spark):
    assert cover_tree.top_k(spark.createDataFrame([], SCHEMA)).count() == 0
