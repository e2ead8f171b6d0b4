import random
import re

import numpy as np
import pytest

from seqlab.llm import signature_tree
from seqlab.llm.components import Forest, components


def shingles(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[k : k + n]) for k in range(max(1, len(words) - n + 1)))


def brute(rows, n, percent):
    sets = [shingles(t, n) for _, t in rows]
    forest = Forest(len(rows))
    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            linked = a and b and 100 * len(a & b) >= percent * len(a | b)
            if rows[i][0] is not None and rows[j][0] is not None and (linked or rows[i][0] == rows[j][0]):
                forest.union(i, j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[forest.find(i)] = min(d, least.get(forest.find(i), d))
    return sorted(
        ((d, len(s), None if d is None else least[forest.find(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets))),
        key=repr,
    )


def corpus(rng, n, vocabulary):
    out = []
    for _ in range(n):
        if out and rng.random() < 0.7:
            words = list(rng.choice(out))
            for _ in range(rng.randint(0, max(1, len(words) // 25))):
                at = rng.randint(0, len(words))
                words[at : at + rng.randint(0, 2)] = [rng.choice(vocabulary) for _ in range(rng.randint(0, 2))]
        else:
            words = [rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 8, 30, 120, 300]))]
        out.append(words)
    return [" ".join(w) for w in out]


@pytest.mark.parametrize("n,percent", [(4, 85), (5, 80), (1, 50)])
def test_brute_force(spark, monkeypatch, n, percent):
    rng = random.Random(n)
    rows = list(enumerate(corpus(rng, 220, [f"w{k}" for k in range(400)])))
    rows += [(None, rows[3][1]), (None, None), (500, None), (501, " "), (502, rows[0][1].upper()), (7, rows[7][1])]
    rng.shuffle(rows)
    monkeypatch.setattr(signature_tree, "LEAF", 4)  # so that groups have many leaves
    docs = spark.createDataFrame([(t, d, 1) for d, t in rows], "text string, doc_id long, n_shingles int")
    got = sorted((tuple(r) for r in signature_tree.similar(docs, n, percent).collect()), key=repr)
    assert got == brute(rows, n, percent)


def test_whole_table_doubled(spark, monkeypatch):
    """Each text links with its two halves, which share no segment; every row stands twice."""
    rows = []
    for g in range(20):
        words = [f"g{g}w{k}" for k in range(40)]
        rows += enumerate((" ".join(w) for w in (words, words[:20], words[20:])), 3 * g)
    monkeypatch.setattr(signature_tree, "LEAF", 1)
    docs = spark.createDataFrame(rows * 2, "doc_id long, text string")
    got = sorted((tuple(r) for r in signature_tree.similar(docs, 1, 50).collect()), key=repr)
    assert got == brute(rows * 2, 1, 50)


def test_repeated_rows_do_not_hide_holders(spark, monkeypatch):
    """Segments held by {1, 2} and by {1, 3}, every row twice: both stay."""
    sets = {1: list(range(40)), 2: list(range(20)), 3: list(range(20, 40))}
    salted = spark.createDataFrame(
        [(d, 9, 2, s) for d, s in sets.items()] * 2, "doc long, cluster long, salts int, members array<long>"
    )
    held = [(5, 1, 1), (5, 2, 2), (6, 1, 1), (6, 3, 3)] * 2
    keys = spark.createDataFrame(held, "key long, doc long, known long")
    monkeypatch.setattr(signature_tree, "_keys_of", lambda rows, percent: keys)
    first = spark.createDataFrame([], "a long, b long")
    found = signature_tree._remaining(salted, first, 50).collect()
    assert {(min(r), max(r)) for r in found if r.a != r.b} == {(1, 2), (1, 3)}


def test_linked_sets_share_a_prefix_key():
    rng = np.random.default_rng(6)
    sizes = signature_tree.Sizes(85)
    body = rng.integers(1, 1 << 60, 90).astype(np.uint64)
    sets = []
    for own in list(range(0, 24, 2)) * 8:
        kept = rng.permutation(body)[: 90 - own // 2 - rng.integers(0, 4)]
        sets.append(np.unique(np.concatenate([kept, rng.integers(1, 1 << 60, own // 2).astype(np.uint64)])))
    counts = np.array([len(s) for s in sets])
    hashes, text = np.concatenate(sets), np.repeat(np.arange(len(sets)), counts)
    _, at, n = np.unique(hashes, return_inverse=True, return_counts=True)
    keys, owner, most = signature_tree.prefix_keys(hashes, text, counts, np.minimum(n[at], 255).astype(np.uint8), 85)
    sent = [dict(zip(keys[owner == i].tolist(), most[owner == i].tolist())) for i in range(len(sets))]
    linked = 0
    for i in range(len(sets)):
        for j in range(i):
            if len(np.intersect1d(sets[i], sets[j])) >= sizes.least_overlap(counts[i], counts[j]):
                linked += 1
                assert any(sent[i][k] >= counts[j] and sent[j][k] >= counts[i] for k in sent[i].keys() & sent[j].keys())
    assert linked > 100


def test_members_too_far_apart_do_not_meet(spark, monkeypatch):
    """160 sets with a common body, of which 140 link with nothing: the rows that meet do not grow with their square."""
    body, rng, sets = list(range(1, 101)), random.Random(3), []
    for k in range(160):
        own = 2 if k < 20 else 25
        sets.append(sorted(rng.sample(body, 100 - own) + [1000 * (k + 1) + x for x in range(own)]))
    salted = spark.createDataFrame(
        [(k, 9, 2, s) for k, s in enumerate(sets)], "doc long, cluster long, salts int, members array<long>"
    )
    met, links = [], signature_tree._links_of

    def counted(rows, percent):
        met.append(rows.where("pair IS NOT NULL").count())
        return links(rows, percent)

    monkeypatch.setattr(signature_tree, "LEAF", 8)
    monkeypatch.setattr(signature_tree, "_links_of", counted)
    first = spark.createDataFrame([], "a long, b long")
    found = signature_tree._remaining(salted, first, 85)
    assert sorted(r.id for r in components(found).where("component = 0").collect()) == list(range(20))
    assert components(found).count() == 20
    assert met[0] <= 4 * len(sets)


def test_document_with_several_texts(spark):
    a = " ".join(f"a{k}" for k in range(60))
    b = " ".join(f"b{k}" for k in range(60))
    docs = spark.createDataFrame([(1, a), (2, b), (3, a), (3, b)], "doc_id long, text string")
    assert {r.component_id for r in signature_tree.similar(docs).collect()} == {1}


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert signature_tree.similar(docs).count() == 0


def test_tree_finds_what_connects():
    rng = np.random.default_rng(4)
    sizes = signature_tree.Sizes(80)
    base = [np.unique(rng.integers(0, 1 << 60, rng.integers(1, 200)).astype(np.uint64)) for _ in range(60)]
    sets = sorted(base + [s[rng.random(len(s)) > 0.08] for s in base if len(s) > 5], key=len)
    forest, want = Forest(len(sets)), Forest(len(sets))
    signature_tree.connect(sets, forest, sizes)
    for i in range(len(sets)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                want.union(i, j)
    assert [forest.find(i) for i in range(len(sets))] == [want.find(i) for i in range(len(sets))]


def test_components(spark):
    rng = random.Random(8)
    pairs = [(k, k + 1) for k in range(200)] + [(rng.randint(300, 500), rng.randint(300, 500)) for _ in range(120)]
    pairs += [(600, 600), (601, None)]
    got = {r.id: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    forest = Forest(700)
    for a, b in pairs:
        if b is not None:
            forest.union(a, b)
    assert got == {i: forest.find(i) for p in pairs if p[1] is not None for i in p}
