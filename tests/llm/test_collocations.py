import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from seqlab.llm import collocations, phrase_trie


def brute(rows, longest, at_least, first):
    counts, totals = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        own = counts.setdefault(lang, Counter())
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in range(1, longest + 1):
                own.update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        often = {p for p, a in f.items() if len(p) > 1 and a >= at_least}
        inside = set()
        for p in often:
            for i in range(len(p)):
                for j in range(i + 2, len(p) + 1):
                    if j - i < len(p) and 100 * f[p] >= 100 * f[p[i:j]]:
                        inside.add(p[i:j])
        rows_ = []
        for p in often - inside:
            a, n = f[p], totals[lang]
            score, k = min((1000 * a * n // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            rows_.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]], n))
        for rank, (s, a, phrase, l, r, n) in enumerate(sorted(rows_)[:first], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, n, -s))
    return sorted(out)


def corpus(seed, n=400):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(30)] + ["É", "ß", "naïve", "The", "x-y", "'s"]
    phrases = [[rng.choice(words) for _ in range(rng.randint(2, 6))] for _ in range(12)]
    rows = []
    for _ in range(n):
        out = []
        for _ in range(rng.randint(0, 12)):
            out += rng.choice(phrases) if rng.random() < 0.6 else [rng.choice(words)]
            out.append(rng.choice(["", "", "", ".", ",\n", "\t", "\r"]))
        rows.append((rng.choice(["en", "de", None]), " ".join(out)))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, "x", lang, text, 1.0) for i, (lang, text) in enumerate(rows)],
                                 "doc_id long, rank string, lang string, text string, score double")


def found(spark, rows, longest=5, at_least=4, first=2000):
    got = collocations.collocations(frame(spark, rows), longest, at_least, first)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(map(tuple, got.collect()))


@pytest.mark.parametrize("longest,at_least,first", [(5, 4, 2000), (3, 2, 10), (2, 1, 50)])
def test_brute_force(spark, longest, at_least, first):
    rows = corpus(1)
    rows += rows[:130]  # copies
    assert found(spark, rows, longest, at_least, first) == brute(rows, longest, at_least, first)


def test_bursting_and_spilling(spark, monkeypatch):
    """Small containers and tries, many prefix partitions: the same counts."""
    rows = corpus(2)
    monkeypatch.setattr(collocations, "PART_WORDS", 200)
    assert found(spark, rows, 4, 3) == brute(rows, 4, 3, 2000)
    rng = np.random.default_rng(0)
    ids = rng.integers(0, 40, (5000, 3)).astype(np.uint64)
    want = Counter(map(tuple, ids.tolist()))
    monkeypatch.setattr(phrase_trie, "BURST", 50)
    monkeypatch.setattr(phrase_trie, "HOLD", 900)
    trie, runs = phrase_trie.PhraseTrie(3, 5), []
    for k in range(0, 5000, 100):
        runs += list(trie.add(ids[k : k + 100]))
    assert runs and trie.root.children  # it has burst and spilled
    runs += list(trie.rest())
    table, got = pa.Table.from_batches(runs), Counter()
    for part in set(table.column("part").to_pylist()):
        own = table.filter(pa.array([p == part for p in table.column("part").to_pylist()]))
        for p, n in zip(*phrase_trie.merge_runs(1)(own).to_pydict().values()):
            assert tuple(p) not in got  # a phrase lies in one partition
            got[tuple(p)] = n
    assert got == want


def test_odd_rows(spark):
    assert found(spark, [], 5, 1) == []
    rows = [(None, None), ("en", ""), ("en", " .,; "), (None, "a b"), ("und", "A\tb"), ("en", "a " * 5000), ("", "a b")]
    rows += [("en", "long" * 5000 + " tail")] * 3
    assert found(spark, rows, 5, 2) == brute(rows, 5, 2, 2000)


def test_products_beyond_64_bits(spark):
    rows = [(1, 10**13, 10**13)]
    out = spark.createDataFrame(rows, "k int, a long, n long")
    out = out.withColumn("top", collocations._whole("a") * collocations._whole("n") * 1000).selectExpr("top div 7 AS x").first()
    # The quotient must be a 64-bit number, the product need not be one.
    assert collocations._whole("a") is not None and out.x is not None


def test_bitmap_has_every_name(spark):
    ids = spark.range(0, 200_000).selectExpr("xxhash64(id) AS id")
    bits = collocations.bitmap(ids)
    names = ids.toArrow()["id"].to_numpy().view(np.uint64)
    assert collocations._in_bitmap(bits, names).all()
    other = np.random.default_rng(1).integers(0, 1 << 63, 10_000).astype(np.uint64)
    assert collocations._in_bitmap(bits, other).mean() < 0.03
