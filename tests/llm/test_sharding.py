import random
import zlib
from collections import Counter, defaultdict

import pytest

from seqlab.llm import sharding
from seqlab.session import work_path


def sized(text):
    return len((text or "").encode()) + 1


def frame(spark, rows):
    return spark.createDataFrame(
        [(t, d, i, "x") for i, (d, t) in enumerate(rows)], "text string, doc_id long, shard int, `doc.slot` string"
    )


def placed(spark, rows, n=16, **settings):
    """(shard, slot, size, doc_id, text) of every row, checked for whole slots and rows."""
    out = sharding.shards(frame(spark, rows), n, **settings)
    got = out.selectExpr("shard", "slot", "size", "doc.doc_id", "doc.text", "doc.`doc.slot` AS x").collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter(rows)
    slots = defaultdict(list)
    for r in got:
        assert r.size == sized(r.text) and r.x == "x" and 0 <= r.shard < n
        slots[r.shard].append(r.slot)
    for own in slots.values():
        assert sorted(own) == list(range(len(own)))
    return got


def sizes(got, n=16):
    out = [0] * n
    for r in got:
        out[r.shard] += r.size
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    texts = ["é" * rng.randint(0, 40) + str(k) for k in range(3000)]
    many = [(k, texts[k % 2000]) for k in range(3000)]
    many += [(3000 + k, "the same text in a third of all rows") for k in range(1500)]
    rng.shuffle(many)
    return many


@pytest.mark.parametrize("part_bytes", [32 << 20, 700])
def test_bytes_are_near_equal(spark, rows, part_bytes):
    got = placed(spark, rows, part_bytes=part_bytes)
    total = sum(sized(t) for _, t in rows)
    ideal, largest = total / 16, max(sized(t) for _, t in rows)
    for own in sizes(got):
        assert abs(own - ideal) <= 2 * 0.01 * ideal + largest
    # Only groups across a splitter are cut, and only such as the tolerance cannot pass over.
    homes, group = defaultdict(set), Counter(t for _, t in rows)
    for r in got:
        homes[r.text].add(r.shard)
    cut = [t for t, s in homes.items() if len(s) > 1]
    assert all(group[t] * sized(t) > 0.01 * ideal for t in cut) and len(cut) <= 15
    order = sorted((r.shard, r.slot) for r in got)
    key = {(r.shard, r.slot): r for r in got}
    texts = [key[o].text for o in order]
    assert sum(a != b for a, b in zip(texts, texts[1:])) + 1 == len(set(texts))  # equal ones adjoin


def test_odd_rows(spark):
    rows = [(None, None), (None, "a"), (5, None), (5, ""), (5, "a"), (5, "a"), (6, "z" * 100_000)]
    rows += [(-(1 << 63), "a"), ((1 << 63) - 1, "a"), (0, "tie"), (0, "tie")]
    got = placed(spark, rows, 4)
    assert max(sizes(got, 4)) >= 100_001
    # One text in every row, told apart by doc_id alone; and rows that nothing tells apart.
    got = placed(spark, [(k, "same") for k in range(-400, 400)], 8)
    assert sizes(got, 8) == [500] * 8
    placed(spark, [(7, "same")] * 40, 8)
    assert sharding.shards(frame(spark, rows).limit(0)).count() == 0


def test_written_shards(spark, rows):
    path = work_path(spark, "shards")
    sharding.write_shards(frame(spark, rows), path, 4, part_bytes=2000)
    back = spark.read.parquet(path)
    assert back.count() == len(rows)
    own = back.where("shard = 2").select("slot", "doc.text").collect()
    assert sorted(r.slot for r in own) == list(range(len(own)))
    want = {(r.shard, r.slot): zlib.crc32(r.text.encode()) for r in placed(spark, rows, 4, part_bytes=2000)}
    assert all(want[(2, r.slot)] == zlib.crc32(r.text.encode()) for r in own)
