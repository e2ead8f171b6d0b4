"""Language-model queries: counts, probabilities, perplexity, draws."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqlab.functions.draws import uniform
from seqlab.operators import hmm, ngram, sampling
from seqlab.operators.vocab import vocab_count
from seqlab.plans.fragments import L1, L2, prob_sql, uniform_sql
from seqlab.plans.registry import big, query, r6
from seqlab.sources.corpora import KEY, seq, tok, tok_numbered, tok_pieces, tokens

GRID = [(a, b) for a in (0.1, 0.2, 0.3, 0.4) for b in (0.4, 0.5, 0.6) if a + b < 1]


def trained(spark, d) -> ngram.NGramModel:
    return ngram.fit(ngram.trigram_counts(tok_pieces(spark, d).where("split = 'train'")))


def probs(spark, d, split=None):
    """Back-off columns of the distinct trigrams of a split, or of the whole corpus, under the train-split model."""
    scored = None if split is None else F.col("split") == split
    model, grams = ngram.fit_within(tok_numbered(spark, d), F.col("split") == "train", scored)
    return ngram.backoff(grams, model)


_COUNTS = (
    "SELECT 3 AS ord, w1, w2, w3, count(*) AS n FROM tok_grams GROUP BY ALL UNION ALL "
    "SELECT 2, '', w2, w3, count(*) FROM tok_grams GROUP BY ALL UNION ALL SELECT 1, '', '', w3, count(*) FROM tok_grams GROUP BY ALL"
)


@query("ngram_counts", f"SELECT CAST(ord AS BIGINT) AS ord, w1, w2, w3, n FROM ({_COUNTS})")
def ngram_counts(spark, d):
    tri = ngram.trigram_counts(tok_pieces(spark, d))
    bi = ngram.lower_order(tri, "w2", "w3")
    uni = ngram.lower_order(bi, "w3")
    none = F.lit("")
    parts = [
        tri.select(big(F.lit(3)).alias("ord"), "w1", "w2", "w3", "n"),
        bi.select(big(F.lit(2)).alias("ord"), none.alias("w1"), "w2", "w3", "n"),
        uni.select(big(F.lit(1)).alias("ord"), none.alias("w1"), none.alias("w2"), "w3", "n"),
    ]
    return parts[0].union(parts[1]).union(parts[2])


@query("ngram_window", "SELECT src_id, CAST(seg AS BIGINT) AS seg, CAST(pos AS BIGINT) AS pos, w1, w2, w3 FROM seq_grams")
def ngram_window(spark, d):
    rows = seq(spark, d)
    n = F.size("words")
    with_pos = rows.select(*KEY, "words", F.sequence(F.lit(0), n).alias("pos"))
    begin = F.array(F.lit(ngram.BEGIN))
    z = with_pos.select(
        *KEY, "pos",
        F.concat(begin, begin, F.slice("words", F.lit(1), n - 1)).alias("w1"),
        F.concat(begin, "words").alias("w2"),
        F.concat("words", F.array(F.lit(ngram.STOP))).alias("w3"),
    )
    out = z.select(*KEY, F.inline(F.arrays_zip("pos", "w1", "w2", "w3")))
    return out.select("src_id", big("seg").alias("seg"), big("pos").alias("pos"), "w1", "w2", "w3")


@query(
    "ngram_invariants",
    "SELECT n_tokens, n_sentences, n_tokens AS tri_total, n_tokens AS bi_total, n_tokens AS uni_total, n_sentences AS tri_starts, n_sentences AS bi_starts FROM "
    "(SELECT count(*) AS n_tokens, count(DISTINCT (src_id, seg)) AS n_sentences FROM tok_grams)",
)
def ngram_invariants(spark, d):
    rows = tok_pieces(spark, d)
    checks = ngram.count_checks(rows, ngram.trigram_counts(rows))
    return checks.select(*[big(c).alias(c) for c in checks.columns])


@query(
    "conditional_distribution",
    "SELECT CAST(3 AS BIGINT) AS ord, w1, w2, w3, round(p3, 6) AS p FROM tok_tri UNION ALL SELECT 2, '', w2, w3, round(p2, 6) FROM tok_bi "
    "UNION ALL SELECT 1, '', '', w3, round(p1, 6) FROM tok_uni",
)
def conditional_distribution(spark, d):
    m = trained(spark, d)
    none = F.lit("")
    tri = ngram.conditional(m.tri, ["w1", "w2"], "p3")
    bi = ngram.conditional(m.bi, ["w2"], "p2")
    uni = ngram.conditional(m.uni, [], "p1")
    parts = [
        tri.select(big(F.lit(3)).alias("ord"), "w1", "w2", "w3", r6("p3").alias("p")),
        bi.select(big(F.lit(2)).alias("ord"), none.alias("w1"), "w2", "w3", r6("p2").alias("p")),
        uni.select(big(F.lit(1)).alias("ord"), none.alias("w1"), none.alias("w2"), "w3", r6("p1").alias("p")),
    ]
    return parts[0].union(parts[1]).union(parts[2])


@query(
    "backoff_lookup",
    "SELECT w1, w2, w3, count(*) AS m, max(coalesce(n3, 0)) AS n3, max(coalesce(n2, 0)) AS n2, max(coalesce(n1, 0)) AS n1 FROM tok_probs GROUP BY w1, w2, w3",
)
def backoff_lookup(spark, d):
    return probs(spark, d).select("w1", "w2", "w3", "m", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("n3", "n2", "n1")])


@query(
    "interpolated_prob",
    f"SELECT w1, w2, w3, count(*) AS m, round(max({prob_sql()}), 6) AS p FROM tok_probs GROUP BY w1, w2, w3",
)
def interpolated_prob(spark, d):
    return probs(spark, d).select("w1", "w2", "w3", "m", r6(ngram.interpolate(L1, L2)).alias("p"))


@query(
    "sentence_loglik",
    f"SELECT src_id, CAST(seg AS BIGINT) AS seg, round(sum(log2({prob_sql()})), 6) AS log2_likelihood, count(*) FILTER (p1 IS NULL) AS n_unseen FROM tok_probs GROUP BY 1, 2",
)
def sentence_loglik(spark, d):
    sentences = tok_numbered(spark, d)
    model, grams = ngram.fit_within(sentences, F.col("split") == "train")
    rows = ngram.sentence_loglik(sentences, model, L1, L2, grams)
    return rows.select("src_id", big("seg").alias("seg"), r6("log2_likelihood").alias("log2_likelihood"), "n_unseen")


def _perplexity_sql(source: str, grid: list[tuple[float, float]]) -> str:
    pairs = ", ".join(f"({a}::DOUBLE, {b}::DOUBLE)" for a, b in grid)
    p = prob_sql("l1", "l2")
    return (
        f"SELECT l1, l2, count(*) FILTER (p1 IS NOT NULL AND w3 <> '</s>') AS n_words, count(*) FILTER (p1 IS NULL) AS n_unseen, "
        f"round(pow(2.0, -sum(log2({p})) / count(*) FILTER (p1 IS NOT NULL AND w3 <> '</s>')), 6) AS perplexity, "
        f"round(pow(2.0, -sum(log2({p})) / count(*) FILTER (p1 IS NOT NULL)), 6) AS perplexity_with_stop "
        f"FROM {source}, (VALUES {pairs}) g(l1, l2) GROUP BY l1, l2"
    )


def _rounded(rows):
    return rows.select(
        "l1", "l2", "n_words", "n_unseen", r6("perplexity").alias("perplexity"),
        r6("perplexity_with_stop").alias("perplexity_with_stop"),
    )


@query("perplexity", _perplexity_sql("tok_dev", [(L1, L2)]))
def perplexity(spark, d):
    return _rounded(ngram.perplexity(probs(spark, d, "dev"), [(L1, L2)]))


@query("perplexity_events", _perplexity_sql("seq_probs", [(L1, L2)]))
def perplexity_events(spark, d):
    rows = seq(spark, d)
    model = ngram.fit(ngram.trigram_counts(rows.where("split = 'train'")))
    return _rounded(ngram.perplexity(ngram.distinct_probs(rows.where("split = 'dev'"), model), [(L1, L2)]))


@query("lm_tune", _perplexity_sql("tok_dev", GRID))
def lm_tune(spark, d):
    return _rounded(ngram.perplexity(probs(spark, d, "dev"), GRID))


@query(
    "best_params",
    f"SELECT l1, l2, perplexity FROM ({_perplexity_sql('tok_dev', GRID)}) ORDER BY perplexity, l1, l2 LIMIT 1",
)
def best_params(spark, d):
    """The first best pair of the tuning grid."""
    tried = _rounded(ngram.perplexity(probs(spark, d, "dev"), GRID)).withColumn("better", -F.col("perplexity"))
    return hmm.first_best(tried, "better", ["l1", "l2"]).select("l1", "l2", "perplexity")


@query(
    "cdf",
    "SELECT w2, w3, n, round((sum(n) OVER (PARTITION BY w2 ORDER BY w3) - n) / sum(n) OVER (PARTITION BY w2), 6) AS lo, "
    "round(sum(n) OVER (PARTITION BY w2 ORDER BY w3) / sum(n) OVER (PARTITION BY w2), 6) AS hi FROM tok_bi",
)
def cdf(spark, d):
    bi = ngram.lower_order(ngram.trigram_counts(tok_pieces(spark, d).where("split = 'train'")), "w2", "w3")
    return ngram.cdf(bi, ["w2"], "w3").select("w2", "w3", "n", r6("lo").alias("lo"), r6("hi").alias("hi"))


_CDF_WORDS = (
    "c AS (SELECT word, (sum(n) OVER (ORDER BY word) - n) / sum(n) OVER () AS lo, sum(n) OVER (ORDER BY word) / sum(n) OVER () AS hi "
    "FROM (SELECT word, count(*) AS n FROM {source} WHERE split = 'train' GROUP BY word))"
)


@query(
    "weighted_draw",
    "WITH " + _CDF_WORDS.format(source="tok") + ", r AS (SELECT src_id, seg, " + uniform_sql(11, "src_id", "seg") + " AS u FROM tok_sent) "
    "SELECT src_id, CAST(seg AS BIGINT) AS seg, word FROM r JOIN c ON u >= lo AND u < hi",
)
def weighted_draw(spark, d):
    rows = tok(spark, d)
    counts = vocab_count(tokens(rows.where("split = 'train'")))
    requests = rows.select(*KEY, uniform(11, F.col("src_id"), F.col("seg")).alias("u"))
    drawn = sampling.weighted_draw(requests, counts, "word")
    return drawn.select("src_id", big("seg").alias("seg"), F.col("element").alias("word"))


@query("lm_sample")
def lm_sample(spark, d):
    """One sentence of up to 12 words per sequence, from a model of the event words."""
    rows = seq(spark, d)
    s = sampling.sampler(ngram.fit(ngram.trigram_counts(rows.where("split = 'train'"))))
    ids = rows.select(F.concat_ws("-", "src_id", "seg").alias("id"))
    out = sampling.lm_sample(ids, s, L1, L2, 12, 5)
    return out.select("id", F.array_join("words", " ").alias("sentence"))


@query("beam_sentences")
def beam_sentences(spark, d):
    """Beam search for one sentence per dev sequence: train-split model, all-data validator."""
    rows = seq(spark, d)
    generator = sampling.sampler(ngram.fit(ngram.trigram_counts(rows.where("split = 'train'"))))
    validator = ngram.fit(ngram.trigram_counts(rows))
    ids = rows.select(F.concat_ws("-", "src_id", "seg").alias("id"))
    trivial = sampling.WordScorer(None, lambda p: F.lit(0.0))
    b = sampling.BeamSettings(L1, L2, 200.0, 3, 3, 3, 7)
    out = sampling.beam_sentences(ids, generator, validator, trivial, b, 9)
    return out.select("id", F.array_join("words", " ").alias("sentence"), "score")

