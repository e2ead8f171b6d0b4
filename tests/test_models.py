import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqlab.operators import agreement, features, hmm, linear, ngram, tagging
from seqlab.operators.features import feature_vocab
from seqlab.sources import models
from seqlab.sources.corpora import pack, tokens
from tests.conftest import make_sentences

CORPUS = [
    [("a", "X"), ("b", "Y"), ("a", "X")],
    [("b", "Y")],
    [("c", "X"), ("a", "Y"), ("b", "X"), ("c", "Y")],
    [("a", "Y"), ("c", "X")],
]


@pytest.mark.parametrize("unigram_of", ["target", "oldest"])
@pytest.mark.parametrize("words", [["a"], ["a", "b"], ["c", "b", "a"], ["a", "unseen", "c", "b"]])
def test_viterbi_against_all_paths(spark, words, unigram_of):
    l1, l2 = 0.5, 0.3
    train = make_sentences(spark, CORPUS)
    counts = hmm.train(train, tokens(train))
    test = tokens(make_sentences(spark, [[(w, "X") for w in words]]))
    got = hmm.viterbi(test, counts, [(l1, l2)], unigram_of).orderBy("pos").collect()

    tri, bi, uni, emit, per_tag, total = {}, {}, {}, {}, {}, 0
    for s in CORPUS:
        tags = ["<START>", "<START>"] + [t for _, t in s] + ["<STOP>"]
        total += len(s) + 1
        for t in tags[1:]:
            uni[t] = uni.get(t, 0) + 1
        for p in zip(tags, tags[1:]):
            bi[p] = bi.get(p, 0) + 1
        for p in zip(tags, tags[1:], tags[2:]):
            tri[p] = tri.get(p, 0) + 1
        for w, t in s:
            emit[w, t] = emit.get((w, t), 0) + 1
            per_tag[t] = per_tag.get(t, 0) + 1

    def q(a, b, c):
        one = c if unigram_of == "target" else a
        p = (1 - l1 - l2) * uni[one] / total
        p += l2 * bi.get((b, c), 0) / uni[b]
        return p + (l1 * tri[a, b, c] / bi[a, b] if (a, b, c) in tri else 0)

    known = {w for w, _ in emit}

    def e(w, t):
        return emit.get((w, t), 0) / per_tag[t] if w in known else per_tag[t] / sum(per_tag.values())

    def score(path):
        full = ["<START>", "<START>", *path, "<STOP>"]
        p = math.prod(q(*x) for x in zip(full, full[1:], full[2:]))
        p *= math.prod(e(w, t) for w, t in zip(words, path))
        return math.log(p) if p > 0 else -math.inf

    best = max(score(p) for p in itertools.product("XY", repeat=len(words)))
    assert got[0].score == pytest.approx(best, abs=1e-9)
    assert score([r.pred for r in got]) == pytest.approx(best, abs=1e-9)
    assert [r.unseen for r in got] == [w not in known for w in words]


def test_ngram_counts_and_perplexity(spark):
    sents = make_sentences(spark, [[("a", "X"), ("b", "X"), ("a", "X")], [("a", "X")]])
    counts = ngram.trigram_counts(sents)
    row = ngram.count_checks(sents, counts).first()
    assert (row.n_tokens, row.tri_total, row.bi_total, row.uni_total) == (6, 6, 6, 6)
    assert (row.n_sentences, row.tri_starts, row.bi_starts) == (2, 2, 2)
    model = ngram.fit(counts)
    l1, l2, l3 = 0.4, 0.5, 0.1
    # <s><s>a twice, <s>ab, ab a, ba</s>, <s>a</s>
    p = [l1 * 1 + l2 * 1 + l3 * 3 / 6, l1 / 2 + l2 / 3 + l3 / 6, l1 + l2 + l3 * 3 / 6, l1 + l2 * 2 / 3 + l3 * 2 / 6]
    p += [p[0], l1 / 2 + l2 * 2 / 3 + l3 * 2 / 6]
    want = 2 ** (-sum(map(math.log2, p)) / 4)
    got = ngram.perplexity(ngram.distinct_probs(sents, model), [(l1, l2)]).first()
    assert got.perplexity == pytest.approx(want)
    assert got.perplexity_with_stop == pytest.approx(2 ** (-sum(map(math.log2, p)) / 6))


def test_cdf_makes_its_counts_once(spark):
    """Sums, totals and the search for heavy contexts read written counts, not the corpus again."""
    counts = spark.createDataFrame([("a", "x", 1), ("a", "y", 3), ("b", "x", 2)], "w2 string, w3 string, n long")
    out = ngram.cdf(counts, ["w2"], "w3")
    assert [tuple(r) for r in out.orderBy("w2", "w3").collect()] == [
        ("a", "x", 1, 2, 0.0, 0.25), ("a", "y", 3, 2, 0.25, 1.0), ("b", "x", 2, 1, 0.0, 1.0)
    ]
    files = out.inputFiles()
    assert files and all("/seqlab/counts-" in f for f in files)


def descent(x, y, reg, steps=20000, eta=0.5):
    w, b = np.zeros((x.shape[1], y.shape[1])), np.zeros(y.shape[1])
    for _ in range(steps):
        z = x @ w + b
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        w = w * (1 - 2 * reg * eta) + eta * x.T @ (y - p) / len(x)
        b = b + eta * (y - p).mean(0)
    return w, b


@pytest.mark.parametrize("kind", ["hard", "soft", "absent"])
def test_training_matches_descent(spark, kind):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 2, (300, 6))
    k = 3
    if kind == "soft":
        y = rng.dirichlet(np.ones(k), 300)
    else:
        label = rng.integers(0, 2 if kind == "absent" else k, 300)
        y = np.eye(k)[label]
    rows = spark.createDataFrame(
        [(i, 0, 0, "train", [f"f{j}" for j in range(6) if r[j]], t.tolist()) for i, (r, t) in enumerate(zip(x, y))],
        "src_id long, seg int, pos int, split string, features array<string>, target array<double>",
    )
    model = linear.train_softmax(rows, feature_vocab(rows), ["A", "B", "C"], 0.01, 500)
    got = {r.feature: np.array(r.w) for r in model.weights.collect()}
    assert all(len(v) == k for v in got.values()) and len(model.bias) == k
    if kind == "absent":
        probs = linear.predict_proba(rows, model, ["src_id"]).collect()
        assert max(r.p[2] for r in probs) < 1e-3
        return
    w, b = descent(x, y, 0.01)
    for j in range(6):
        assert got[f"f{j}"] - got[f"f{j}"].mean() == pytest.approx(w[j] - w[j].mean(), abs=1e-4)
    assert np.array(model.bias) - np.mean(model.bias) == pytest.approx(b - b.mean(), abs=1e-4)


def test_table_descent_matches_numpy(spark):
    rng = np.random.default_rng(5)
    x = rng.integers(0, 2, (60, 4))
    x[:, 0] = 1
    y = np.eye(2)[rng.integers(0, 2, 60)]
    rows = spark.createDataFrame(
        [(i, 0, 0, [f"f{j}" for j in range(4) if r[j]], t.tolist()) for i, (r, t) in enumerate(zip(x, y))],
        "src_id long, seg int, pos int, features array<string>, target array<double>",
    )
    model = linear.gradient_steps(rows, ["A", "B"], 3, 0.5, 0.01)
    w, b = descent(x, y, 0.01, 3, 0.5)
    got = {r.feature: r.w for r in model.weights.collect()}
    assert [got[f"f{j}"] for j in range(4)] == [pytest.approx(list(r)) for r in w]
    assert model.bias == pytest.approx(list(b))


@pytest.fixture(scope="module")
def small(spark):
    sents = make_sentences(spark, CORPUS * 3)
    rows = features.examples(sents)
    tags = tagging.tag_list(rows)
    return sents, rows, linear.count_weights(rows, tags)


def test_decoding_once_per_content_changes_nothing(spark, small):
    sents, _, model = small
    key = ["src_id", "seg", "pos"]
    a = linear.greedy_decode(sents, model, True).select(*key, "pred", "p").orderBy(*key).collect()
    b = linear.greedy_decode(sents, model, False).select(*key, "pred", "p").orderBy(*key).collect()
    assert [r.pred for r in a] == [r.pred for r in b]
    assert np.allclose([r.p for r in a], [r.p for r in b])


def test_greedy_tags_are_the_argmax_given_their_own_history(spark, small):
    sents, _, model = small
    rows = linear.greedy_decode(sents, model)
    again = features.examples(pack(rows.select("src_id", "seg", "pos", "split", "word", "tag", "pred"), tags="pred"))
    probs = linear.predicted(linear.predict_proba(again, model), model.tags)
    assert probs.where("pred <> tag").count() == 0


def test_save_and_load(spark, small, tmp_path):
    _, _, model = small
    models.save_model(model, str(tmp_path / "m"))
    back = models.load_model(spark, str(tmp_path / "m"))
    assert back.tags == model.tags and back.bias == pytest.approx(model.bias)
    assert agreement.weight_stats(agreement.weights_compare(model, back)).first().l2_distance == pytest.approx(0)
    broken = linear.LinearModel(model.tags[:-1], model.weights, model.bias[:-1])
    models.save_model(broken, str(tmp_path / "broken"))
    with pytest.raises(ValueError):
        models.load_model(spark, str(tmp_path / "broken"))


def test_centering_keeps_predictions(spark, small):
    _, rows, model = small
    pairs = agreement.paired(linear.predict_proba(rows, model), linear.predict_proba(rows, linear.center(model)))
    got = agreement.agreement(pairs).first()
    assert got.accuracy == 1.0 and got.kl_rows == pytest.approx(0, abs=1e-9)


def test_unknown_tag_is_an_error(spark):
    rows = spark.createDataFrame([("Q",)], "tag string")
    with pytest.raises(Exception, match="unknown tag"):
        tagging.encode_tags(rows, ["A"]).collect()


def test_scores(spark):
    from seqlab.functions import vectors

    df = spark.createDataFrame([([0.5, 0.5],), ([1.0, 0.0],), ([0.7, 0.2, 0.1],)], "p array<double>")
    got = df.select(*[f(F.col("p")).alias(n) for n, f in vectors.SCORES.items()]).collect()
    assert [r.entropy for r in got] == pytest.approx([math.log(2), 0, 0.8018185525433372])
    assert [r.margin for r in got] == pytest.approx([0, -1, -0.5])
    assert [r.gradient for r in got] == pytest.approx([-0.5, -1, -0.54])
    assert [r.constant for r in got] == [0, 0, 0]


def test_model_and_corpus_counted_together(spark):
    """One pass gives the model and the scored trigrams that two passes give."""
    train = make_sentences(spark, [[(w, "X") for w in s] for s in (["a", "b", "a"], ["a"], ["a", "b", None])])
    dev = make_sentences(spark, [[(w, "X") for w in s] for s in (["a", "b", "c"], ["a"], ["b", None])], "dev")
    other = make_sentences(spark, [[("z", "X")]], "test")
    rows = train.union(dev).union(other)
    old = ngram.fit(ngram.trigram_counts(train))
    for scored, part in ((None, rows), (F.col("split") == "dev", dev)):
        model, grams = ngram.fit_within(rows, F.col("split") == "train", scored)
        for a, b in zip(model, old):
            assert sorted(a.collect(), key=repr) == sorted(b.select(a.columns).collect(), key=repr)
        got, want = ngram.backoff(grams, model), ngram.distinct_probs(part, old)
        assert sorted(got.collect(), key=repr) == sorted(want.select(got.columns).collect(), key=repr)
        # The trigrams are counted already: only pairs and words are joined.
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Join LeftOuter") == 4


def in_pieces(spark, empty_piece=False):
    """Sentences in pieces, with a null word, a copy in another piece and ids that repeat or are null."""
    said = [
        (1, 0, "train", ["a", "b", "a"]), (1, 1, "train", ["a"]), (2, 0, "train", ["a", "b", None]), (2, 0, "train", ["a", "b", None]),
        (3, 0, "dev", ["a", "b", "c"]), (3, 1, "dev", ["é", "b"]), (None, 0, "dev", ["a"]), (None, 0, "train", ["b", "a", "b"]),
        (4, 0, "test", ["z"]), (4, 1, None, ["a", "b"]), (5, 0, "dev", ["c"]),
    ]
    rows = [(i, g, s, w, i and 7 * i % 5 or 0) for i, g, s, w in said]
    return spark.createDataFrame(rows, "src_id long, seg int, split string, words array<string>, piece int")


def exchanged(df):
    """The keys by which rows are shuffled."""
    import re

    return re.findall(r"hashpartitioning\((\w+)#", df._jdf.queryExecution().executedPlan().toString())


def near(rows):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows), key=repr)


def test_sentences_are_scored_in_their_pieces(spark):
    """Pieces give what joins give, and no token or trigram is shuffled."""
    rows = in_pieces(spark)
    model, grams = ngram.fit_within(rows, F.col("split") == "train")
    got = ngram.sentence_loglik(rows, model, 0.4, 0.5, grams)
    old = ngram.fit(ngram.trigram_counts(rows.where("split = 'train'")))
    want = ngram.sentence_loglik(rows.drop("piece"), old, 0.4, 0.5)
    assert near(got.collect()) == near(want.select(got.columns).collect())
    assert {*exchanged(got)} <= {"piece", "bucket", "src_id"}
    for a, b in zip(model, old):
        assert sorted(a.collect(), key=repr) == sorted(b.select(a.columns).collect(), key=repr)


def test_pieces_know_what_is_joined(spark):
    """The distinct trigrams of pieces come with all counts: nothing is joined, and no row of words is shuffled."""
    rows = in_pieces(spark)
    old = ngram.fit(ngram.trigram_counts(rows.where("split = 'train'")))
    for scored, part in ((None, rows), (F.col("split") == "dev", rows.where("split = 'dev'")), (F.lit(False), rows.limit(0))):
        model, grams = ngram.fit_within(rows, F.col("split") == "train", scored)
        got, want = ngram.backoff(grams, model), ngram.distinct_probs(part.drop("piece"), old)
        assert near(got.collect()) == near(want.select(got.columns).collect())
        assert {*exchanged(got)} <= {"piece", "bucket"}
        assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_counts_move_packed(spark, monkeypatch):
    """Trigrams, pairs and words are counted as by rows, with nulls and in several messages a task; no row of words is shuffled."""
    from seqlab.operators import packed

    monkeypatch.setattr(packed, "HELD", 5)
    rows = in_pieces(spark).select("words").repartition(2)
    tri = ngram.trigram_counts(rows)
    want = ngram.trigram_rows(rows).groupBy(*ngram.GRAM).agg(F.count(F.lit(1)).alias("n"))
    assert near(tri.collect()) == near(want.collect())
    bi = ngram.lower_order(tri, "w2", "w3")
    assert near(bi.collect()) == near(want.groupBy("w2", "w3").agg(F.sum("n")).collect())
    assert {*exchanged(tri)} | {*exchanged(bi)} == {"bucket"}


@pytest.mark.parametrize("opened", [1, 1 << 20])
def test_shares_of_contexts_read_in_parts(spark, monkeypatch, opened):
    from seqlab.operators import packed

    monkeypatch.setattr(packed, "OPENED", opened)
    rows = [("a", "b", f"w{i}", i + 1) for i in range(50)] + [("a", "é", "x", 3), (None, "b", "x", 1), ("", "b", "x", 2), ("a", "b", None, 5)]
    # The same row twice stays twice, and counts twice in its context.
    counts = spark.createDataFrame([*rows, rows[0]], "w1 string, w2 string, w3 string, n long").repartition(3)
    got = ngram.conditional(counts, ["w1", "w2"], "p")
    total = {}
    for a, b, _, n in [*rows, rows[0]]:
        total[a, b] = total.get((a, b), 0) + n
    want = [(a, b, c, n, None if a is None else round(n / total[a, b], 9)) for a, b, c, n in [*rows, rows[0]]]
    assert near(got.collect()) == sorted(want, key=repr)
    assert {*exchanged(got)} == {"bucket"}
