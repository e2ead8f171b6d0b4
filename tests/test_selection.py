import collections

import pytest
from pyspark.sql import functions as F

from seqlab.functions.draws import uniform
from seqlab.operators import sampling, scale, selection
from seqlab.operators.ngram import fit, trigram_counts
from seqlab.plans import rounds
from tests.conftest import make_sentences


def test_batches_cover_all_rows_once(spark):
    rows = selection.minibatches(spark.range(20), ["id"], 1, 3).collect()
    sizes = collections.Counter(r.batch for r in rows)
    assert [sizes[b] for b in range(7)] == [3, 3, 3, 3, 3, 3, 2]
    assert sorted(r.id for r in rows) == list(range(20))


def test_batch_iterator_golden(spark):
    pool = spark.createDataFrame([(0, ["a", "b"]), (1, ["c", "d"])], "id long, words array<string>")
    cycled = selection.cycle(pool, ["id"], None, 6).withColumn("len", F.size("words"))
    later = selection.budget_batches(cycled, ["draw"], [2, 2, 6])
    first = spark.createDataFrame([(0, ["a", "b"]), (0, ["a", "b"])], "batch long, words array<string>")
    rows = first.union(later.select(F.col("batch") + 1, "words"))
    got = selection.running_unique(rows).orderBy("batch").collect()
    assert [(r.n_tokens, r.n_words) for r in got] == [(4, 2), (6, 2), (8, 4), (14, 4)]
    order = [r.words for r in later.orderBy("draw").collect()]
    assert order == [["a", "b"], ["c", "d"], ["a", "b"], ["c", "d"], ["a", "b"]]


def test_budget_batches_carry_no_words(spark, monkeypatch):
    """Words are written once; the steps that find the batches pass on order and length only."""
    seen, keep = [], selection.written
    monkeypatch.setattr(selection, "written", lambda df, name: seen.append((name, df.columns)) or keep(df, name))
    # Two rows share an id, and each comes back once with its own words.
    rows = spark.createDataFrame([(0, ["a"]), (1, ["b", "c"]), (1, ["d", "e"]), (2, None)], "id long, words array<string>")
    got = selection.budget_batches(rows.withColumn("len", F.size("words")), ["id"], [1], then=2).collect()
    assert sorted((r.id, r.words or []) for r in got) == [(0, ["a"]), (1, ["b", "c"]), (1, ["d", "e"]), (2, [])]
    assert [name for name, columns in seen if "words" in columns] == ["kept"]


def test_cycle_counts_passes(spark):
    rows = selection.cycle(spark.range(3), ["id"], 5, 4).orderBy("draw").collect()
    assert [r["pass"] for r in rows] == [0, 0, 0, 1]
    assert sorted(r.id for r in rows[:3]) == [0, 1, 2] and rows[3].id == rows[0].id


def test_early_stop(spark):
    series = [10.0 - i for i in range(9)] + [1.0] * 12
    df = spark.createDataFrame([("r", i, v) for i, v in enumerate(series)], "run string, step int, loss double")
    got = selection.early_stop(df, 0.001).first()
    want = next(
        i for i in range(len(series)) if i + 1 > 10 and series[i] * 1.001 > sum(series[i - 9 : i]) / 9
    )
    assert got.stop_step == want and got.last_step == len(series) - 1


def test_weighted_draw_proportions(spark):
    counts = spark.createDataFrame([("a", 1), ("b", 2)], "word string, n long")
    asked = spark.range(2**14).withColumn("u", uniform(1, F.col("id")))
    got = {r.element: r["count"] for r in sampling.weighted_draw(asked, counts, "word").groupBy("element").count().collect()}
    assert sum(got.values()) == 2**14
    assert got["b"] / 2**14 == pytest.approx(2 / 3, abs=0.01)


def test_guide_finds_what_a_scan_finds(spark):
    counts = spark.createDataFrame([(f"w{i:03d}", 1 + (i * 7919) % 97 * (1000 if i == 50 else 1)) for i in range(200)], "word string, n long")
    asked = spark.range(3000).withColumn("u", uniform(2, F.col("id")))
    drawn = {r.id: r.element for r in sampling.weighted_draw(asked, counts, "word").collect()}
    us = {r.id: r.u for r in asked.collect()}
    total, cum, table = sum(r.n for r in counts.collect()), 0, []
    for r in counts.orderBy("word").collect():
        table.append((cum / total, (cum + r.n) / total, r.word))
        cum += r.n
    assert drawn == {i: next(w for lo, hi, w in table if lo <= u < hi) for i, u in us.items()}


def test_proportional_weights_never_favour_overdrawn_words(spark):
    counts = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "word string, n long")
    used = spark.createDataFrame([("a", 5), ("b", 3), ("c", 4)], "word string, used long")
    got = {r.word: r.weight for r in selection.proportional_weights(counts, used, 1.1).collect()}
    assert got["a"] == 0 and got["c"] > 0
    fresh = selection.proportional_weights(counts, used.limit(0), 1.1).collect()
    assert {r.word: r.weight for r in fresh} == {"a": 1.0, "b": 2.0, "c": 3.0}


def test_lookup_with_heavy_keys_is_a_left_join(spark, heavy):
    left = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}") for i in range(300)] + [(999, None)], "id long, k string")
    right = spark.createDataFrame([("hot", 1), ("k0", 2), ("k3", 3)], "k string, v long")
    freq = left.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    got = sorted((r.id, r.k, r.v) for r in scale.lookup(left, right, ["k"], freq).collect())
    want = sorted((r.id, r.k, r.v) for r in left.join(right, "k", "left").collect())
    assert got == want


@pytest.mark.parametrize("parts", [1, 8])
def test_running_sum_with_heavy_groups(spark, heavy, parts):
    rows = [(g, i, (i * 31) % 7) for g, n in (("hot", 500), ("b", 5), ("c", 1)) for i in range(n)]
    df = spark.createDataFrame(rows, "g string, i long, v long").repartition(parts)
    got = scale.running_sum(df, ["g"], ["i"], F.floor(F.col("i") / 16), F.col("v"), "s").collect()
    want, seen = {}, collections.Counter()
    for g, i, v in rows:
        seen[g] += v
        want[g, i] = seen[g]
    assert {(r.g, r.i): r.s for r in got} == want


def test_numbers_over_the_whole_table(spark):
    words = spark.createDataFrame([(w,) for w in ["b", "a", "é", "abc", "abd", "Z", "", "ab"]], "word string")
    got = [r.word for r in scale.number_rows(words, [], ["word"], scale.text_bucket("word"), "n").orderBy("n").collect()]
    assert got == sorted(r.word for r in words.collect())


@pytest.fixture(scope="module")
def lm(spark):
    sents = [["a", "b", "c"], ["a", "c"], ["b", "a", "b"], ["c", "c", "a", "b"], ["a", "b"]]
    model = fit(trigram_counts(make_sentences(spark, [[(w, "X") for w in s] for s in sents])))
    return model, sampling.sampler(model)


def test_lm_samples(spark, lm):
    model, s = lm
    a = {r.id: r.words for r in sampling.lm_sample(spark.range(40), s, 0.4, 0.5, 5, 3).collect()}
    b = {r.id: r.words for r in sampling.lm_sample(spark.range(40).repartition(1), s, 0.4, 0.5, 5, 3).collect()}
    assert a == b and sorted(a) == list(range(40))
    assert all(1 <= len(w) <= 5 and set(w) <= {"a", "b", "c"} for w in a.values())
    starts = collections.Counter(w[0] for w in a.values())
    assert starts["a"] > starts["c"]


def test_beam_keeps_its_limits(spark, lm):
    model, s = lm
    plain = sampling.WordScorer(None, lambda p: F.lit(0.0))
    b = sampling.BeamSettings(0.4, 0.5, 50.0, 2, 3, 1, 5)
    rows = sampling.beam_sentences(spark.range(6), s, model, plain, b, 4).collect()
    assert sorted(r.id for r in rows) == list(range(6))
    assert all(r.words is None or 2 <= len(r.words) <= 4 for r in rows)
    assert sum(r.words is not None for r in rows) >= 5


def test_strategies_are_the_known_ones(spark):
    assert len(rounds.STRATEGIES) == 15


def test_best_n(spark):
    df = spark.createDataFrame([(i, float(i % 5)) for i in range(10)], "id long, s double")
    assert [r.id for r in selection.best_n(df, "s", ["id"], 3).orderBy("rank").collect()] == [4, 9, 3]
    assert selection.best_share(df, "s", ["id"], 4).count() == 2


def test_ranks_with_most_scores_equal(spark):
    rows = [(i, 0.5 if i % 3 else -i / 7.0) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, s double")
    got = [(r.id, r["rank"]) for r in selection.ranked_by_score(df, "s", ["id"]).orderBy("rank").collect()]
    assert got == [(i, k) for k, (i, _) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])))]


def test_filter_and_grid(spark):
    sents = make_sentences(spark, [[("a", "X")], [("a", "X"), ("b", "X")]])
    ok, bad = rounds.split_by_filter(sents, F.size("words") < 2)
    assert ok.count() == 1 and bad.count() == 1
    # 0.9 goes with neither: both sums reach 1.
    work = rounds.with_grid(sents, {"l1": [0.5, 0.9], "l2": [0.1, 0.2]}, F.col("l1") + F.col("l2") < 1)
    assert sorted((r.l1, r.l2) for r in work.collect()) == [(0.5, 0.1)] * 2 + [(0.5, 0.2)] * 2


def test_batches_of_a_run_share_no_sentence(spark):
    """A source that is not used up goes on where the batch before ended."""
    from seqlab.plans import rounds
    from tests.conftest import make_sentences

    train = make_sentences(spark, [[(f"w{k}", "X"), (f"v{k}", "X")] for k in range(60)])
    counts = spark.createDataFrame([(f"w{k}", 1) for k in range(60)], "word string, n long")
    nothing = spark.createDataFrame([], "word string, used long")
    ctx = rounds.Context(train, counts, nothing, None, None, None, length=5)
    for name in ("FROM_TRAIN_SET", "SEQUENTIAL"):
        first, asked = rounds._fill(name, ctx, 20, 2.0 if name == "FROM_TRAIN_SET" else 5.0, 0)
        second, _ = rounds._fill(name, ctx._replace(start=asked), 20, 2.0 if name == "FROM_TRAIN_SET" else 5.0, 1)
        a, b = ({tuple(r.words) for r in x.collect()} for x in (first, second))
        assert len(a) >= 4 and len(b) >= 4 and not a & b


def test_budget_beyond_the_source_is_an_error(spark):
    import pytest

    from seqlab.plans import rounds
    from tests.conftest import make_sentences

    train = make_sentences(spark, [])
    counts = spark.createDataFrame([], "word string, n long")
    nothing = spark.createDataFrame([], "word string, used long")
    ctx = rounds.Context(train, counts, nothing, None, None, None)
    with pytest.raises(ValueError):
        rounds._fill("FROM_TRAIN_SET", ctx, 20, 2.0, 0)


def budgets(lengths, sizes):
    """Batch of each sentence, one after another."""
    out, batch, left = [], 0, sizes[0]
    for n in lengths:
        out.append(batch)
        left -= n
        if left <= 0:
            batch += 1
            left = sizes[min(batch, len(sizes) - 1)]
    return out


def test_budget_batches_to_the_end(spark):
    import random

    rng = random.Random(7)
    for sizes in ([13, 6], [5], [3, 200, 9], [10_000, 5]):
        lengths = [rng.choice([1, 1, 2, 3, 5, 20]) for _ in range(120)]
        rows = spark.createDataFrame(list(enumerate(lengths)), "id long, len int")
        got = selection.budget_batches(rows, ["id"], sizes[:-1], then=sizes[-1]).orderBy("id").collect()
        assert [r.batch for r in got] == budgets(lengths, sizes)
        assert [r.upto for r in got] == [sum(lengths[: i + 1]) for i in range(120)]


def test_first_rows(spark, monkeypatch):
    from seqlab.operators import scale

    monkeypatch.setattr(scale, "FEW", 5)
    monkeypatch.setattr(scale, "CELLS", 7)
    keys = [None, None, 0.5, 3.0, 3.0, 3.0, 3.0, 3.0, 3.0, 1e12] + [float(k * k) for k in range(40)]
    rows = spark.createDataFrame(list(enumerate(keys)), "id long, k double").repartition(3)
    order = sorted(range(len(keys)), key=lambda i: (keys[i] is not None, keys[i] or 0.0, i))
    for n in (0, 1, 2, 9, 25, 49, 50, 99):
        got = sorted(r.id for r in scale.first_rows(rows, ["k", "id"], n, scale.F.col("k")).collect())
        assert got == sorted(order[:n])


@pytest.mark.parametrize("most", [2, 100])
def test_requests_and_prefixes_are_not_broadcast(spark, monkeypatch, most):
    """What grows with the ids never goes through the driver: only a short guide of draws is broadcast."""
    from seqlab.operators.linear import LinearModel

    monkeypatch.setattr(sampling, "MAX_HEAVY", most, raising=False)
    counts = spark.createDataFrame([("a", 1), ("b", 2), ("c", 5)], "word string, n long")
    asked = spark.range(40).withColumn("u", F.col("id") / 40.0)
    drawn = sampling.weighted_draw(asked, counts, "word")
    assert [r.element for r in drawn.orderBy("id").collect()] == ["a"] * 5 + ["b"] * 10 + ["c"] * 25
    plan = drawn._jdf.queryExecution().optimizedPlan().toString()
    assert ("strategy=broadcast" in plan) == (most == 100) and ("strategy=merge" in plan) == (most == 2)
    weights = spark.createDataFrame([("word=a", [1.0, 0.0]), ("prev_word=a", [0.0, 2.0])], "feature string, w array<double>")
    scorer = sampling.WordScorer(LinearModel(["X", "Y"], weights, [0.0, 0.0]), lambda p: p[0])
    rows = drawn.select("id", F.array("element", "element").alias("words"), F.array().cast("array<string>").alias("tags"))
    scored = sampling.score_last_word(rows, scorer, ["id"])
    assert scored.count() == 40
    assert "rightHint=(strategy=merge)" in scored._jdf.queryExecution().optimizedPlan().toString()
