import random

from seqlab.llm import line_dedup


def brute(rows, window=3):
    order = sorted((d, t or "", i) for i, (d, t) in enumerate(rows) if d is not None)
    seen, out = set(), {i: t for i, (d, t) in enumerate(rows)}
    for _, text, i in order:
        lines = text.split("\n")
        full = [k for k, x in enumerate(lines) if x.strip(" \t\n\v\f\r")]
        gone = set()
        for k in range(len(full) - window + 1):
            at = full[k : k + window]
            w = tuple(lines[j].strip(" \t\n\v\f\r") for j in at)
            if w in seen:
                gone |= set(at)
            seen.add(w)
        if gone:
            out[i] = "\n".join(x for k, x in enumerate(lines) if k not in gone)
    return out


def test_brute_force(spark):
    rng = random.Random(2)
    pool = ["a", "b", " é b ", "", "long line here", "\r", "z\t"]
    rows = [(k, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 14)))) for k in range(60)]
    pool = [f"line {k}" for k in range(40)] + ["", " "]
    rows += [(k, "\n".join(rng.choice(pool) for _ in range(9))) for k in range(60, 100)]
    for k in range(100, 200):
        rows.append((k, rng.choice(rows[:100])[1] + "\n" + rng.choice(rows[:100])[1]))
    rows += [(5, rows[5][1]), (5, rows[7][1]), (None, rows[3][1]), (None, rows[3][1]), (300, None), (301, "")]
    docs = spark.createDataFrame(
        [(t, d, k, "x") for k, (d, t) in enumerate(rows)], "text string, doc_id long, place int, n_lines string"
    )
    got = line_dedup.dedup(docs)
    assert got.columns == ["text", "doc_id", "place", "n_lines", "n_removed"]
    want = brute(rows)
    for r in got.collect():
        if r.doc_id == 5:
            continue
        assert r.text == want[r.place], r
    five = sorted(r.text for r in got.where("doc_id = 5").collect())
    assert five == sorted(want[i] for i, (d, _) in enumerate(rows) if d == 5)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert line_dedup.dedup(docs).count() == 0
