import random
import re

from seqlab.llm import lz_dedup


def brute(rows, window):
    """{row: (n_words, n_removed, kept)} with ids and rows of one id in the order of texts."""
    order = sorted((d, t or "", i) for i, (d, t) in enumerate(rows) if d is not None)
    seen, out = set(), {}
    for _, text, i in order:
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        gone = set()
        for k in range(len(words) - window + 1):
            w = tuple(words[k : k + window])
            if w in seen:
                gone |= set(range(k, k + window))
            seen.add(w)
        kept = [w for k, w in enumerate(words) if k not in gone]
        out[i] = (len(words), len(gone), " ".join(kept))
    for i, (d, text) in enumerate(rows):
        if d is None:
            words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
            out[i] = (len(words), 0, " ".join(words))
    return out


def texts(rng, n, words):
    base = [[rng.choice(words) for _ in range(rng.randint(0, 90))] for _ in range(n)]
    for b in base:
        if rng.random() < 0.6:
            other = rng.choice(base)
            k = rng.randint(0, len(other))
            at = rng.randint(0, len(b))
            b[at:at] = other[k : k + rng.randint(1, 60)]
    seps = [" ", "\n", "  ", "\t "]
    return ["".join(w + rng.choice(seps) for w in b) for b in base]


def check(spark, rows, window=20):
    docs = spark.createDataFrame(
        [(d, t, "extra") for d, t in rows], "doc_id long, text string, copy string"
    )
    got = sorted(tuple(r) for r in lz_dedup.remove(docs, window).collect() if r.doc_id is not None)
    none = sorted(tuple(r)[1:] for r in lz_dedup.remove(docs, window).collect() if r.doc_id is None)
    want = brute(rows, window)
    assert got == sorted((rows[i][0], *w) for i, w in want.items() if rows[i][0] is not None)
    assert none == sorted(w for i, w in want.items() if rows[i][0] is None)


def test_brute_force(spark):
    rng = random.Random(5)
    rows = list(enumerate(texts(rng, 150, [f"w{k}é" for k in range(300)])))
    rng.shuffle(rows)
    check(spark, rows)


def test_few_words_and_ties(spark):
    rng = random.Random(6)
    rows = list(enumerate(texts(rng, 40, ["a", "b"])))
    rows += [(3, rows[3][1]), (3, rows[9][1]), (None, rows[1][1]), (None, rows[1][1]), (90, None), (91, "")]
    rows += [(200 + k, "x " * 50) for k in range(30)]
    check(spark, rows)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert lz_dedup.remove(docs).count() == 0
