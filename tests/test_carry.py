import heapq
import random

import pytest

from seqlab.operators.carry import best_with_carry


def brute(scores, n):
    heap, out = [], []
    for i, s in enumerate(scores):
        heapq.heappush(heap, (-round(s, 9), i))
        if (i + 1) % n == 0:
            out.append(heapq.heappop(heap)[1])
    return out


def picks(spark, scores, n, block):
    rows = [(i // 7, i % 7, s, "x") for i, s in enumerate(scores)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "a int, b int, score double, at string")
    got = best_with_carry(df, ["a", "b"], "score", n, block).orderBy("pick").collect()
    assert [r.pick for r in got] == list(range(len(got)))
    return [r.a * 7 + r.b for r in got]


SERIES = {
    "falling": lambda rng, i: 1000.0 - i,
    "rising": lambda rng, i: float(i),
    "ties": lambda rng, i: float(rng.randint(0, 3)),
    "waves": lambda rng, i: float((i // 40) % 3 * 5 + rng.random()),
}


@pytest.mark.parametrize("kind,n,block", [("falling", 3, 16), ("rising", 3, 16), ("ties", 2, 16), ("waves", 3, 4)])
def test_blocks_give_what_one_heap_gives(spark, kind, n, block):
    rng = random.Random(len(kind))
    scores = [SERIES[kind](rng, i) for i in range(200)]
    assert picks(spark, scores, n, block) == brute(scores, n)


def test_heavy_groups(spark, heavy):
    rng = random.Random(2)
    scores = [rng.random() for _ in range(120)]
    assert picks(spark, scores, 4, 10) == brute(scores, 4)


def test_few_rows(spark):
    assert picks(spark, [1.0, 2.0], 3, 4) == []
    assert picks(spark, [1.0, 3.0, 2.0, 0.0], 1, 2) == [0, 1, 2, 3]
