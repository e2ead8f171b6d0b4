import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from seqlab.llm import spelling


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute_words(rows, min_length=5, min_count=3):
    counts = Counter()
    for d, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 97 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= min_length and n >= min_count}


def brute_groups(words):
    form, out = {}, []
    near = {a: [b for b in words if one_edit(a, b)] for a in words}
    for a, bs in near.items():
        best = min(bs, key=lambda b: (-words[b], b), default=None)
        form[a] = best if best is not None and words[best] >= 2 * words[a] else None
    for a in words:
        root = a
        while form[root] is not None:
            root = form[root]
        out.append((a, words[a], len(near[a]), form[a], words[form[a]] if form[a] else None, root))
    return sorted(out, key=repr)


def got(rows):
    assert rows.columns == ["word", "n", "n_near", "form", "form_n", "root"]
    return sorted(map(tuple, rows.collect()), key=repr)


def grouped(spark, words):
    return got(spelling.group(spark.createDataFrame(list(words.items()), "word string, n long")))


def vocabulary(rng, n, letters, low=5, high=12):
    words = {"".join(rng.choice(letters) for _ in range(rng.randint(low, high))) for _ in range(n)}
    for w in list(words):
        for _ in range(rng.randint(0, 3)):
            k = rng.randrange(len(w) + 1)
            w = w[:k] + rng.choice(["", rng.choice(letters)]) + w[k + rng.randint(0, 1) :]
            if len(w) >= low:
                words.add(w)
    return {w: int(3 + rng.paretovariate(0.7)) for w in words}


@pytest.mark.parametrize("letters,each", [("abcdefghijé", 4), ("abcdé", 0)])
def test_groups_by_brute_force(spark, monkeypatch, letters, each):
    """Where few pairs may meet, crowded chunks are cut down to single letters."""
    monkeypatch.setattr(spelling, "PAIRS_EACH", each)
    words = vocabulary(random.Random(len(letters)), 300, letters, 5 if each else 1)
    assert grouped(spark, words) == brute_groups(words)


def test_a_common_beginning(spark):
    """Many words that differ at one end only: none is lost, and no chunk brings all of them together."""
    rng = random.Random(4)
    words = {"somelongbeginning" + "".join(rng.choice("abcdefgh") for _ in range(4)): 3 + k % 50 for k in range(700)}
    assert grouped(spark, words) == brute_groups(words)


def test_chain_of_forms(spark):
    words = {"a" * 5 + "b" * k: 3 * 2**k for k in range(20)}
    rows = grouped(spark, words)
    assert rows == brute_groups(words) and {r[5] for r in rows} == {"a" * 5 + "b" * 19}


def test_words_of_documents(spark):
    rng = random.Random(9)
    pool = ["Straße", "Éclair", "éclair", "hello", "hallo", "world", "x×y÷zz", "ab", "LONGWORD" * 30, "naïve"]
    rows = [(k, " ".join(rng.choice(pool) + rng.choice(["", ".", "1", "\n"]) for _ in range(40))) for k in range(400)]
    rows += [(5, rows[5][1])] * 3 + [(None, rows[1][1]), (None, None), (7, None), (8, ""), (9, "word" * 20_000)]
    docs = spark.createDataFrame([(t, d, "x", i) for i, (d, t) in enumerate(rows)], "text string, doc_id long, word string, n int")
    want = brute_words(rows)
    assert {r.word: r.n for r in spelling.words(docs).collect()} == want
    assert got(spelling.group(spelling.words(docs))) == brute_groups(want)
    runs = {re.sub("[A-Z]", lambda m: m[0].lower(), r) for p in pool for r in re.findall("[A-Za-zÀ-ÿ]+", p)}
    assert set(want) - runs  # some words have lost a letter


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert got(spelling.group(spelling.words(docs))) == []


def test_checksums_put_together():
    rng = random.Random(1)
    pairs = [(bytes(rng.randrange(256) for _ in range(rng.randint(0, 9))), bytes(rng.randrange(256) for _ in range(k))) for k in range(spelling.TABLED + 1)]
    first, second = (np.array([zlib.crc32(x) for x in side], np.uint32) for side in zip(*pairs))
    got = spelling.joined_crc(first, second, np.array([len(b) for _, b in pairs]))
    assert got.tolist() == [zlib.crc32(a + b) for a, b in pairs]
