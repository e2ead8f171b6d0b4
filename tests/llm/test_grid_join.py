import numpy as np

from seqlab.llm import grid_join
from seqlab.llm.components import Forest

SCHEMA = "vec_id long, embedding array<float>, label int, n_links string"


def brute(rows, threshold=0.93):
    n = len(rows)
    units = []
    for v, e, label, _ in rows:
        x = np.array([np.nan if c is None else c for c in (e or [])], np.float32).astype(float)
        good = v is not None and label is not None and len(x) and np.isfinite(x).all() and x.any()
        units.append(x / np.linalg.norm(x) if good else None)
    forest, links = Forest(n), [0] * n
    for i in range(n):
        for j in range(i):
            a, b = units[i], units[j]
            if a is not None and b is not None and rows[i][2] == rows[j][2] and len(a) == len(b) and a @ b >= threshold:
                links[i] += 1
                links[j] += 1
                forest.union(i, j)
    least = {}
    for i in range(n):
        if rows[i][0] is not None:
            least[forest.find(i)] = min(rows[i][0], least.get(forest.find(i), rows[i][0]))
    out = []
    for i, (v, *_) in enumerate(rows):
        c = None if v is None else least[forest.find(i)]
        out.append((v, links[i], c, v == c))
    return sorted(out, key=repr)


def test_brute_force(spark, monkeypatch):
    monkeypatch.setattr(grid_join, "BLOCK", 16)
    monkeypatch.setattr(grid_join, "LEAF", 4)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 12))
    rows = []
    for k in range(320):
        x = centres[rng.integers(40)] * rng.choice([1, 3]) + rng.normal(size=12) * rng.choice([0, 0.15, 0.3, 2])
        rows.append((k, [float(np.float32(c)) for c in x], int(rng.integers(3)), "x"))
    rows += [(400 + k, rows[7][1], rows[7][2], "x") for k in range(20)]
    rows += [
        (500, None, 1, "x"), (501, [0.0] * 12, 1, "x"), (502, [float("nan")] * 12, 1, "x"),
        (503, [None] + [1.0] * 11, 1, "x"), (504, rows[3][1], None, "x"), (None, rows[3][1], rows[3][2], "x"),
        (505, [], 1, "x"), (506, [1.0, 1.0], 1, "x"), (507, [2.0, 2.0], 1, "x"), (508, [3e38, 3e38], 1, "x"),
    ]
    got = grid_join.near(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(rows)


def test_empty(spark):
    assert grid_join.near(spark.createDataFrame([], SCHEMA)).count() == 0
