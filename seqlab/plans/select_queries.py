"""Orders, budgets, batches, draws and series."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqlab.operators import sampling, selection
from seqlab.operators.vocab import vocab_count
from seqlab.plans.fragments import key_sql, uniform_sql
from seqlab.plans.linear_queries import all_rows, teacher_student
from seqlab.plans.lm_queries import _CDF_WORDS
from seqlab.plans.registry import big, query, r6
from seqlab.sources.corpora import KEY, seq, seq_tokens, table, tok, tokens

SEED = 123
_SEG = "CAST(seg AS BIGINT) AS seg"
_SEQ_SENT = "(SELECT src_id, seg, split, count(*) AS len FROM seq GROUP BY ALL)"
_KEY = key_sql(SEED, "src_id", "seg")
CARRY = 20


@query(
    "seeded_shuffle",
    f"SELECT src_id, {_SEG}, split, row_number() OVER (PARTITION BY split ORDER BY {_KEY}, src_id, seg) - 1 AS rank FROM tok_sent",
)
def seeded_shuffle(spark, d):
    rows = selection.seeded_shuffle(tok(spark, d).select(*KEY, "split"), KEY, SEED, ["split"])
    return rows.select("src_id", big("seg").alias("seg"), "split", "rank")


@query(
    "random_subset",
    f"SELECT vec_id, CAST(label AS BIGINT) AS label FROM embeddings QUALIFY row_number() OVER (ORDER BY {key_sql(SEED, 'vec_id')}, vec_id) <= (SELECT count(*) // 2 FROM embeddings)",
)
def random_subset(spark, d):
    """A random half of the vectors."""
    rows = table(spark, d, "embeddings").select("vec_id", "label")
    half = selection.random_subset(rows, ["vec_id"], SEED, rows.count() // 2)
    return half.select("vec_id", big("label").alias("label"))


@query("minibatches", f"SELECT vec_id, (row_number() OVER (ORDER BY {key_sql(SEED, 'vec_id')}) - 1) // 32 AS batch FROM embeddings")
def minibatches(spark, d):
    return selection.minibatches(table(spark, d, "embeddings").select("vec_id"), ["vec_id"], SEED, 32).select("vec_id", "batch")


@query(
    "running_unique",
    f"WITH s AS (SELECT src_id, seg, (row_number() OVER (ORDER BY {_KEY}, src_id, seg) - 1) // 20 AS batch FROM {_SEQ_SENT}), "
    "t AS (SELECT batch, word FROM seq JOIN s USING (src_id, seg)), f AS (SELECT min(batch) AS batch, word FROM t GROUP BY word) "
    "SELECT batch, CAST(sum(n) OVER (ORDER BY batch) AS BIGINT) AS n_tokens, CAST(sum(k) OVER (ORDER BY batch) AS BIGINT) AS n_words FROM "
    "(SELECT batch, count(*) AS n, coalesce((SELECT count(*) FROM f WHERE f.batch = t.batch), 0) AS k FROM t GROUP BY batch)",
)
def running_unique(spark, d):
    batches = selection.minibatches(seq(spark, d), KEY, SEED, 20)
    rows = selection.running_unique(batches.select("batch", "words"))
    return rows.select("batch", big("n_tokens").alias("n_tokens"), big("n_words").alias("n_words"))


@query(
    "token_budget",
    f"SELECT src_id, {_SEG}, len FROM (SELECT src_id, seg, len(words) AS len, sum(len(words)) OVER (ORDER BY {_KEY}, src_id, seg ROWS UNBOUNDED PRECEDING) AS upto FROM tok_sent) WHERE upto - len < 100000",
)
def token_budget(spark, d):
    rows = tok(spark, d).select(*KEY, F.size("words").cast("bigint").alias("len"))
    return selection.token_budget(rows, KEY, SEED, 100000).select("src_id", big("seg").alias("seg"), "len")


@query(
    "cycle_sentences",
    f"WITH r AS (SELECT src_id, seg, row_number() OVER (ORDER BY {_KEY}, src_id, seg) - 1 AS rank, count(*) OVER () AS size FROM {_SEQ_SENT}), "
    "p AS (SELECT unnest(range(0, (SELECT 2 * max(size) + max(size) // 2 FROM r))) AS draw) "
    f"SELECT draw, draw // size AS pass, src_id, {_SEG} FROM p JOIN r ON draw % size = rank",
)
def cycle_sentences(spark, d):
    """Two and a half passes over the shuffled sequences."""
    rows = seq(spark, d)
    n = rows.count()
    out = selection.cycle(rows, KEY, SEED, 2 * n + n // 2)
    return out.select("draw", "pass", "src_id", big("seg").alias("seg"))


_CHUNK_KEY = "CASE WHEN pass = 0 THEN word ELSE md5(CAST(pass + 7 AS VARCHAR) || '|' || word) END"


@query(
    "vocab_chunks",
    "WITH w AS (SELECT DISTINCT word FROM tok), e AS (SELECT word, unnest([0, 1]) AS pass FROM w), "
    f"r AS (SELECT *, row_number() OVER (PARTITION BY pass ORDER BY {_CHUNK_KEY}, word) - 1 AS place FROM e) "
    "SELECT CAST(pass AS BIGINT) AS pass, place // 25 AS chunk, string_agg(word, ' ' ORDER BY place) AS words FROM r GROUP BY 1, 2",
)
def vocab_chunks(spark, d):
    rows = selection.vocab_chunks(tokens(tok(spark, d)), 25, 2, 7)
    return rows.select(big("pass").alias("pass"), big("chunk").alias("chunk"), F.array_join("words", " ").alias("words"))


@query(
    "proportional_draw",
    "WITH f AS (SELECT word, count(*) AS f FROM tok WHERE split = 'train' GROUP BY word), c AS (SELECT word, count(*) AS c FROM tok WHERE split = 'dev' GROUP BY word), "
    "x AS (SELECT word, f, coalesce(c, 0) AS c, (SELECT sum(f) FROM f) AS tf, (SELECT sum(c) FROM c WHERE word IN (SELECT word FROM f)) AS d FROM f LEFT JOIN c USING (word)) "
    "SELECT word, f AS n, c AS used, round(CASE WHEN tf - 1.05 * f = 0 THEN 0 ELSE greatest((1.05 * d * f - tf * c) / (tf - 1.05 * f), 0) END::DOUBLE, 6) AS weight FROM x",
)
def proportional_draw(spark, d):
    rows = tokens(tok(spark, d))
    counts = vocab_count(rows.where("split = 'train'"))
    used = vocab_count(rows.where("split = 'dev'")).withColumnRenamed("n", "used")
    out = selection.proportional_weights(counts, used, 1.05)
    return out.select("word", "n", "used", r6("weight").alias("weight"))


@query(
    "least_used_words",
    "SELECT w.word, CASE WHEN v.word IS NULL THEN 0 ELSE -coalesce(u.n, 0) END AS score FROM (SELECT DISTINCT word FROM tok) w "
    "LEFT JOIN (SELECT DISTINCT word FROM tok WHERE split = 'train') v USING (word) LEFT JOIN (SELECT word, count(*) AS n FROM tok WHERE split = 'test' GROUP BY word) u ON u.word = w.word",
)
def least_used_words(spark, d):
    rows = tokens(tok(spark, d))
    vocab = rows.where("split = 'train'").select("word").distinct()
    return selection.usage_scores(rows, rows.where("split = 'test'"), vocab)


@query(
    "select_best_of_n",
    f"WITH s AS (SELECT src_id, seg, avg(s) AS score FROM (SELECT src_id, seg, pos, sum(CASE WHEN p > 0 THEN -p * ln(p) ELSE 0 END) AS s FROM student_pa GROUP BY 1, 2, 3) GROUP BY 1, 2) "
    f"SELECT src_id, {_SEG}, round(score, 6) AS score FROM (SELECT *, row_number() OVER (ORDER BY round(score, 9) DESC, src_id, seg) - 1 AS rank, count(*) OVER () AS size FROM s) WHERE rank < size // 4",
)
def select_best_of_n(spark, d):
    """The quarter of the sequences the student is least sure of."""
    from seqlab.functions.vectors import entropy
    from seqlab.operators.linear import predict_proba
    from seqlab.session import written

    _, student, every = all_rows(spark, d)
    scored = predict_proba(every, student).groupBy(*KEY).agg(F.avg(entropy(F.col("p"))).alias("score"))
    best = selection.best_share(written(scored, "scores"), "score", KEY, 4)
    return best.select("src_id", big("seg").alias("seg"), r6("score").alias("score"))


@query(
    "best_of_n_carry",
    "RECURSIVE WITH s AS (SELECT src_id, seg, avg(s) AS score FROM (SELECT src_id, seg, pos, sum(CASE WHEN p > 0 THEN -p * ln(p) ELSE 0 END) AS s FROM student_pa GROUP BY 1, 2, 3) GROUP BY 1, 2), "
    "r AS MATERIALIZED (SELECT src_id, seg, round(score, 9) AS score, row_number() OVER (ORDER BY src_id, seg) - 1 AS place FROM s), "
    "p AS (SELECT -1::BIGINT AS pick, -1::BIGINT AS place, []::BIGINT[] AS taken UNION ALL "
    "SELECT pick + 1, x.best, list_append(taken, x.best) FROM (SELECT p.pick, any_value(p.taken) AS taken, min_by(r.place, (-r.score, r.place)) AS best FROM p JOIN r "
    f"ON r.place < (p.pick + 2) * {CARRY} AND NOT list_contains(p.taken, r.place) WHERE (p.pick + 2) * {CARRY} <= (SELECT count(*) FROM r) GROUP BY p.pick) x) "
    f"SELECT pick, src_id, {_SEG}, round(score, 6) AS score FROM p JOIN r USING (place)",
)
def best_of_n_carry(spark, d):
    """One pick for every ``CARRY`` sequences that come in: the one of those not yet taken that the student is
    least sure of."""
    from seqlab.functions.vectors import entropy
    from seqlab.operators.carry import best_with_carry
    from seqlab.operators.linear import predict_proba
    from seqlab.session import written

    _, student, every = all_rows(spark, d)
    scored = predict_proba(every, student).groupBy(*KEY).agg(F.avg(entropy(F.col("p"))).alias("score"))
    picks = best_with_carry(written(scored, "scores"), KEY, "score", CARRY)
    return picks.select("pick", "src_id", big("seg").alias("seg"), r6("score").alias("score"))


@query(
    "greedy_sentences",
    "WITH " + _CDF_WORDS.format(source="seq") + ", i AS (SELECT DISTINCT src_id FROM seq), a AS (SELECT src_id AS id, unnest(range(25)) AS place FROM i), "
    "u AS (SELECT id, place, " + uniform_sql(SEED, "id", "place", 0) + " AS u FROM a) "
    "SELECT id, string_agg(word, ' ' ORDER BY place) AS sentence FROM u JOIN c ON u >= lo AND u < hi GROUP BY id",
)
def greedy_sentences(spark, d):
    """One 25-word unigram sentence per source; all draws score the same."""
    rows = seq_tokens(spark, d)
    counts = vocab_count(rows.where("split = 'train'"))
    ids = rows.select(F.col("src_id").alias("id")).distinct()
    plain = sampling.WordScorer(None, lambda p: F.lit(0.0))
    out = sampling.greedy_sentences(ids, counts, 25, plain, 1, SEED)
    return out.select("id", F.array_join("words", " ").alias("sentence"))


@query("greedy_sentences_entropy")
def greedy_sentences_entropy(spark, d):
    """One 4-word sentence per source; at each place the draw the student is least sure of."""
    from seqlab.functions.vectors import entropy
    from seqlab.session import written

    _, student, _ = teacher_student(spark, d)
    student = student._replace(weights=written(student.weights, "student"))
    rows = seq_tokens(spark, d)
    counts = written(vocab_count(rows.where("split = 'train'")), "counts")
    ids = rows.select(F.col("src_id").alias("id")).distinct()
    out = sampling.greedy_sentences(ids, counts, 4, sampling.WordScorer(student, entropy), 5, SEED)
    return out.select("id", F.array_join("words", " ").alias("sentence"))


BUDGETS = [10_000, 5_000]


@query(
    "token_budget_batches",
    "RECURSIVE WITH s AS MATERIALIZED (SELECT len(words) AS n, sum(len(words)) OVER (ORDER BY src_id, seg) AS upto FROM tok_sent), "
    f"b AS (SELECT 0::BIGINT AS batch, 0::HUGEINT AS lo, min(upto) AS hi FROM s WHERE upto >= {BUDGETS[0]} UNION ALL "
    f"SELECT b.batch + 1, b.hi, (SELECT min(upto) FROM s WHERE upto >= b.hi + {BUDGETS[1]}) FROM b WHERE b.hi IS NOT NULL) "
    "SELECT batch, count(*) AS n_sentences, sum(n)::BIGINT AS n_tokens, max(upto)::BIGINT AS tokens_so_far FROM s JOIN b ON upto > lo AND (hi IS NULL OR upto <= hi) GROUP BY batch",
)
def token_budget_batches(spark, d):
    """The whole corpus in order: 10,000 tokens first, then 5,000 a batch; each ends with the sentence that crosses."""
    rows = tok(spark, d).select(*KEY, F.size("words").alias("len"))
    cut = selection.budget_batches(rows, KEY, BUDGETS[:1], then=BUDGETS[1])
    return cut.groupBy("batch").agg(
        F.count(F.lit(1)).alias("n_sentences"), F.sum("len").alias("n_tokens"), F.max("upto").alias("tokens_so_far")
    )


@query(
    "budgeted_unique_words",
    "RECURSIVE WITH s AS MATERIALIZED (SELECT src_id, seg, words, sum(len(words)) OVER (ORDER BY src_id, seg) AS upto FROM tok_sent), "
    f"b AS (SELECT 0::BIGINT AS batch, 0::HUGEINT AS lo, min(upto) AS hi FROM s WHERE upto >= {BUDGETS[0]} UNION ALL "
    f"SELECT b.batch + 1, b.hi, (SELECT min(upto) FROM s WHERE upto >= b.hi + {BUDGETS[1]}) FROM b WHERE b.hi IS NOT NULL), "
    "t AS (SELECT batch, unnest(words) AS word FROM s JOIN b ON upto > lo AND (hi IS NULL OR upto <= hi)), "
    "f AS (SELECT min(batch) AS batch, word FROM t GROUP BY word), k AS (SELECT batch, count(*) AS k FROM f GROUP BY batch), n AS (SELECT batch, count(*) AS n FROM t GROUP BY batch) "
    "SELECT batch, CAST(sum(n) OVER (ORDER BY batch) AS BIGINT) AS n_tokens, CAST(sum(coalesce(k, 0)) OVER (ORDER BY batch) AS BIGINT) AS n_words FROM n LEFT JOIN k USING (batch)",
)
def budgeted_unique_words(spark, d):
    """Tokens and distinct words so far after each budgeted batch of the whole corpus."""
    rows = tok(spark, d).select(*KEY, "words", F.size("words").alias("len"))
    cut = selection.budget_batches(rows, KEY, BUDGETS[:1], then=BUDGETS[1])
    out = selection.running_unique(cut.select("batch", "words"))
    return out.select("batch", big("n_tokens").alias("n_tokens"), big("n_words").alias("n_words"))


# Series

_SERIES = (
    "s AS (SELECT run, v, row_number() OVER (PARTITION BY run ORDER BY h) AS step FROM "
    "(SELECT event_type AS run, date_trunc('hour', ts) AS h, round(avg(value), 4) AS v FROM events GROUP BY 1, 2))"
)


def hourly(spark, d, value):
    """A series per event type: the mean value of each hour, numbered."""
    from pyspark.sql import Window as W

    hour = F.substring(F.col("ts").cast("string"), 1, 13)
    rows = table(spark, d, "events").groupBy(F.col("event_type").alias("run"), hour.alias("h")).agg(F.round(F.avg("value"), 4).alias(value))
    step = F.row_number().over(W.partitionBy("run").orderBy("h")).cast("bigint")
    return rows.select("run", step.alias("step"), value)


@query(
    "early_stop",
    "WITH " + _SERIES + ", m AS (SELECT run, step, v, row_number() OVER w AS seen, avg(v) OVER (PARTITION BY run ORDER BY step ROWS BETWEEN 9 PRECEDING AND 1 PRECEDING) AS before "
    "FROM s WINDOW w AS (PARTITION BY run ORDER BY step)) SELECT run, min(step) FILTER (seen > 10 AND v * 1.001 > before) AS stop_step, max(step) AS last_step FROM m GROUP BY run",
)
def early_stop(spark, d):
    return selection.early_stop(hourly(spark, d, "loss"), 0.001)


@query(
    "lr_schedule",
    "WITH " + _SERIES + ", m AS (SELECT run, step, v, max(v) OVER (PARTITION BY run ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best, lag(v) OVER (PARTITION BY run ORDER BY step) AS prev FROM s) "
    "SELECT run, step, round(2.0 / pow(step, 0.1), 6) AS decayed, round(2.0 * pow(0.8, sum(CASE WHEN v <= best AND prev > v THEN 1 ELSE 0 END) OVER (PARTITION BY run ORDER BY step)), 6) AS shrunk FROM m",
)
def lr_schedule(spark, d):
    rows = selection.rate_schedule(hourly(spark, d, "accuracy"), 2.0)
    return rows.select("run", "step", r6("decayed").alias("decayed"), r6("shrunk").alias("shrunk"))


@query("skip_warmup", "WITH " + _SERIES + " SELECT run, step, v AS value FROM s WHERE step >= 5")
def skip_warmup(spark, d):
    return selection.skip_warmup(hourly(spark, d, "value"))
