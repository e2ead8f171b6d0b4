from pyspark.sql import functions as F

from seqlab.llm import mixing

SCHEMA = "doc_id long, text string, rate string"


def make(spark, extra=()):
    a, b = "alpha amber acorn apple", "river rose robin rain"
    rows = [(k, a if k % 4 else b, "x") for k in range(200)]
    rows += [(200 + k, f"{a} {b}", "x") for k in range(20)]
    return spark.createDataFrame([*rows, *extra], SCHEMA)


def labels(spark):
    rows = [(k, "a" if k % 4 else "b") for k in range(80)] + [(None, "a"), (81, "other"), (999, "b"), (5, "a")]
    return spark.createDataFrame(rows, "doc_id long, domain string")


def test_targets_are_met(spark):
    mixed = mixing.mix(make(spark), labels(spark), {"a": 0.4, "b": 0.6})
    p = {d: F.col(f"p_{d}") / (F.col("p_a") + F.col("p_b")) for d in "ab"}
    y = mixed.agg(
        *[F.sum(F.col("rate") * F.col("n_tokens") * p[d]).alias(d) for d in "ab"], F.sum("n_tokens").alias("n")
    ).first()
    assert abs(y.a / y.n - 0.4) < 1e-3 and abs(y.b / y.n - 0.6) < 1e-3
    assert mixed.where("rate < 0").count() == 0
    soft = mixed.where("doc_id >= 200").first()
    assert 0 < soft.p_a < 1000 and 0 < soft.p_b < 1000


def test_same_as_plain_descent(spark):
    mixed = mixing.mix(make(spark), labels(spark), {"a": 0.9, "b": 0.1}, steps=7).orderBy("doc_id").collect()
    p = [[r.p_a / (r.p_a + r.p_b), r.p_b / (r.p_a + r.p_b)] for r in mixed]
    n = [r.n_tokens for r in mixed]
    one = [sum(c * q[d] for c, q in zip(n, p)) for d in (0, 1)]
    target = [0.9 * sum(one), 0.1 * sum(one)]
    rate = [1.0] * len(n)
    for _ in range(7):
        y = [sum(r * c * q[d] for r, c, q in zip(rate, n, p)) for d in (0, 1)]
        g = [(y[d] - target[d]) / one[d] for d in (0, 1)]
        rate = [max(0.0, r - sum(q[d] * g[d] for d in (0, 1))) for r, q in zip(rate, p)]
    assert max(abs(r.rate - x) for r, x in zip(mixed, rate)) < 1e-9


def test_odd_rows(spark):
    extra = [(500, None, "x"), (501, "", "x"), (None, "alpha", "x"), (None, "rose", "x"), (3, "apple", "x")]
    docs = make(spark, extra)
    mixed = mixing.mix(docs, labels(spark), {"a": 1.0, "b": 1.0, "none": 0.5})
    got = {r.doc_id: r for r in mixed.collect()}
    assert len(got) == 223 and got[500].n_tokens == 0 and got[501].rate == got[500].rate
    assert got[None].n_tokens == 2 and got[3].n_tokens == 5
    out = mixing.apply_rates(docs, mixed)
    assert out.columns == docs.columns
    times = out.groupBy("doc_id").count().where("doc_id < 200 AND doc_id <> 3").collect()
    assert all(int(got[r.doc_id].rate) <= r["count"] <= int(got[r.doc_id].rate) + 1 for r in times)


def test_empty(spark):
    docs = make(spark).limit(0)
    mixed = mixing.mix(docs, labels(spark), {"a": 1.0, "b": 1.0})
    assert mixed.count() == 0 and mixing.apply_rates(docs, mixed).count() == 0
    unlabelled = mixing.mix(make(spark), labels(spark).limit(0), {"a": 1.0, "b": 1.0})
    assert unlabelled.count() == 220
