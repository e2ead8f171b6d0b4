"""Rounds, stores, bundles and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqlab.operators import ngram, sampling, tagging
from seqlab.operators.vocab import vocab_count
from seqlab.plans import rounds
from seqlab.plans.fragments import MIN_FREQ, key_sql, uniform_sql
from seqlab.plans.linear_queries import all_rows, seq_examples, teacher_student, walk_sql
from seqlab.plans.registry import big, query, r6
from seqlab.session import work_path, written
from seqlab.sources import committed
from seqlab.sources.corpora import document_sentences, pack, seq, seq_tokens, tokens
from seqlab.sources.models import append_metrics
from seqlab.streaming import jobs, totals


def saved(model):
    return model._replace(weights=written(model.weights, "model"))


def context(spark, d, student, language_model=False) -> rounds.Context:
    rows = seq_tokens(spark, d).where("split = 'train'")
    sentences = written(pack(rows), "train")
    counts = written(vocab_count(rows), "counts")
    generator = validator = None
    if language_model:
        validator = ngram.fit(ngram.trigram_counts(sentences))
        generator = sampling.sampler(validator)
    nothing = spark.createDataFrame([], "word string, used bigint")
    return rounds.Context(sentences, counts, nothing, generator, validator, student, length=10, lm_length=10,
                          beam=sampling.BeamSettings(0.4, 0.55, 200.0, 3, 3, 2, 5))


@query(
    "label_batch",
    walk_sql("seq_ctx", "seq_feats", "teacher") + " SELECT src_id, CAST(seg AS BIGINT) AS seg, CAST(pos AS BIGINT) AS pos, t1 AS tag, "
    "round(exp(z) / total, 6) AS p_best FROM g WHERE pos >= 0",
)
def label_batch(spark, d):
    """Training rows for all sequences: the tag and the probability that the teacher gives."""
    teacher, _, _ = all_rows(spark, d)
    rows = rounds.label_batch(seq(spark, d), saved(teacher))
    return rows.select("src_id", big("seg").alias("seg"), big("pos").alias("pos"), "tag", r6(F.array_max("p")).alias("p_best"))


@query(
    "accumulate_labels",
    "SELECT CASE split WHEN 'train' THEN 0 ELSE 1 END::BIGINT AS batch, split, tag, count(*) AS n FROM seq GROUP BY 1, 2, 3",
)
def accumulate_labels(spark, d):
    """Two batches in one store; the second is written twice, as after a failed attempt."""
    rows = seq_examples(spark, d)
    store = work_path(spark, "labels")
    rounds.append_labels(rows.where("split = 'train'"), store, 0)
    for _attempt in range(2):
        rounds.append_labels(rows.where("split <> 'train'"), store, 1)
    return rounds.stored_labels(spark, store).groupBy(big("batch").alias("batch"), "split", "tag").agg(F.count(F.lit(1)).alias("n"))


@query(
    "metrics_sink",
    "SELECT event_type AS run, metric, CAST(1 AS BIGINT) AS step, round(value, 6) AS value FROM (SELECT event_type, unnest(['tokens', 'mean']) AS metric, "
    "unnest([CAST(count(*) AS DOUBLE), avg(value)]) AS value FROM events GROUP BY event_type)",
)
def metrics_sink(spark, d):
    events = spark.read.parquet(f"{d}/events.parquet")
    path = work_path(spark, "metrics")
    for metric, value in (("tokens", F.count(F.lit(1)).cast("double")), ("mean", F.avg("value"))):
        rows = events.groupBy(F.col("event_type").alias("run")).agg(value.alias("value"))
        for _attempt in range(2):  # the second one, as after a failed round, adds nothing
            append_metrics(rows.select("run", F.lit(metric).alias("metric"), F.lit(1).alias("step"), "value"), path, metric)
    return committed.read(spark, path).select("run", "metric", "step", r6("value").alias("value"))


@query("train_to_target")
def train_to_target(spark, d):
    """Accuracy on dev of each setting tried."""
    rows = seq_examples(spark, d)
    tags = tagging.tag_list(rows)
    _, tried = rounds.train_to_target(rows.where("split = 'train'"), rows.where("split = 'dev'"), tags, [(0.01, 20), (0.001, 20)])
    return spark.createDataFrame(tried, "reg double, max_iter int, accuracy double")


@query(
    "corpus_bundle",
    "SELECT 'full' AS version, word, count(*) AS n FROM seq_pre GROUP BY word UNION ALL SELECT 'narrow', word, count(*) FROM seq_allow GROUP BY word",
)
def corpus_bundle(spark, d):
    """Word counts of the full and of the 60-word version of the corpus."""
    b = rounds.corpus_bundle(seq_tokens(spark, d), MIN_FREQ, 60)
    parts = [rows.groupBy("word").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("version"), "word", "n")
             for name, rows in (("full", b.full), ("narrow", b.narrow))]
    return parts[0].union(parts[1])


@query("corpus_bundle_models")
def corpus_bundle_models(spark, d):
    """Dev perplexity of the full and the narrow model of the bundle."""
    b = rounds.corpus_bundle(seq_tokens(spark, d), MIN_FREQ, 60)
    out = []
    for name, rows, model in (("full", b.full, b.full_lm), ("narrow", b.narrow, b.narrow_lm)):
        probs = ngram.distinct_probs(pack(rows.where("split = 'dev'")), model)
        out.append(ngram.perplexity(probs, [(0.4, 0.55)]).withColumn("version", F.lit(name)))
    return out[0].unionByName(out[1])


SEED = rounds.Context._field_defaults["seed"]
LENGTH = rounds.Context._field_defaults["length"]
_TRAIN = "SELECT src_id, seg, string_agg(word, ' ' ORDER BY pos) AS sentence FROM seq WHERE split = 'train' GROUP BY src_id, seg"
_WORDS = "SELECT word, count(*) AS n FROM seq WHERE split = 'train' GROUP BY word"


def _drawn_sql(weights: str) -> str:
    """As many sentences of drawn words as there are training sequences."""
    return (
        f"WITH n AS (SELECT word, {weights} AS n FROM ({_WORDS})), "
        "c AS (SELECT word, (sum(n) OVER (ORDER BY word) - n) / sum(n) OVER () AS lo, sum(n) OVER (ORDER BY word) / sum(n) OVER () AS hi FROM n), "
        f"a AS (SELECT unnest(range((SELECT count(*) FROM ({_TRAIN})))) AS id), p AS (SELECT id, unnest(range({LENGTH})) AS place FROM a), "
        f"u AS (SELECT id, place, {uniform_sql(SEED, 'id', 'place', 0)} AS u FROM p) "
        "SELECT id AS src_id, string_agg(word, ' ' ORDER BY place) AS sentence FROM u JOIN c ON u >= lo AND u < hi GROUP BY id"
    )


def _strategy(spark, d, name, n=None):
    """All sentences that a strategy gives in one batch."""
    ctx = context(spark, d, None)._replace(length=LENGTH)
    rows = rounds.choose(name, ctx, n(ctx) if n else ctx.train.count(), 1)
    return rows.select("src_id", F.array_join("words", " ").alias("sentence"))


@query(
    "strategy_from_train_set",
    f"SELECT row_number() OVER (ORDER BY {key_sql(SEED, 'src_id', 'seg')}, src_id, seg) - 1 AS src_id, sentence FROM ({_TRAIN})",
)
def strategy_from_train_set(spark, d):
    """Every training sequence in seeded order."""
    return _strategy(spark, d, "FROM_TRAIN_SET")


@query("strategy_unigrams", _drawn_sql(f"CAST(ceil(n / (SELECT max(n) FROM ({_WORDS})) * 4294967296.0::DOUBLE) AS BIGINT)"))
def strategy_unigrams(spark, d):
    """Words in proportion to their counts; nothing has been used before."""
    return _strategy(spark, d, "UNIGRAMS")


@query("strategy_iid_words", _drawn_sql("1"))
def strategy_iid_words(spark, d):
    return _strategy(spark, d, "IID_WORDS")


@query(
    "strategy_sequential",
    f"WITH w AS (SELECT word, pass, row_number() OVER (PARTITION BY pass ORDER BY CASE pass WHEN 0 THEN word ELSE md5(CAST({SEED} + pass AS VARCHAR) || '|' || word) END) - 1 AS k, "
    f"count(*) OVER (PARTITION BY pass) AS size FROM ({_WORDS}), (SELECT unnest([0, 1]) AS pass)) "
    f"SELECT pass * CAST(ceil(size / {LENGTH}.0) AS BIGINT) + k // {LENGTH} AS src_id, string_agg(word, ' ' ORDER BY k) AS sentence FROM w GROUP BY 1",
)
def strategy_sequential(spark, d):
    """The word list in chunks, twice round."""
    return _strategy(spark, d, "SEQUENTIAL", lambda ctx: 2 * -(-ctx.counts.count() // LENGTH))


FAST = ["FROM_TRAIN_SET_MAX_ENTROPY", "FROM_TRAIN_SET_MAX_GRADIENT"]


def _chosen(spark, d, names, n, language_model=False):
    _, student, _ = teacher_student(spark, d)
    ctx = context(spark, d, saved(student), language_model)
    parts = [
        rounds.choose(name, ctx, n, 1).select(F.lit(name).alias("strategy"), "src_id", F.array_join("words", " ").alias("sentence"))
        for name in names
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _tenth(spark, d) -> int:
    return max(1, seq(spark, d).where("split = 'train'").count() // 10)


@query("selection_strategies")
def selection_strategies(spark, d):
    """Sentences that the strategies choose from the corpus by the student's uncertainty."""
    return _chosen(spark, d, FAST, _tenth(spark, d))


@query("selection_strategies_lm")
def selection_strategies_lm(spark, d):
    """Sentences drawn from the language model, as they come and the best of ten."""
    names = ["LANGUAGE_MODEL", "MAX_ENTROPY_LANGUAGE_MODEL", "MAX_GRADIENT_LANGUAGE_MODEL"]
    return _chosen(spark, d, names, _tenth(spark, d), True)


@query("active_learning_round")
def active_learning_round(spark, d):
    """Two rounds on labels: uniform words, then the sequences the student is least sure of."""
    return _rounds(spark, d, "FROM_TRAIN_SET_MAX_ENTROPY", False)


@query("full_information_round")
def full_information_round(spark, d):
    """Two rounds on probability rows: uniform words, then sequences in shuffled order."""
    return _rounds(spark, d, "FROM_TRAIN_SET", True)


def _rounds(spark, d, strategy, soft):
    teacher, _, _ = teacher_student(spark, d)
    ctx = context(spark, d, None)
    n = ctx.train.agg(F.sum(F.size("words"))).first()[0]
    dev = seq(spark, d).where("split = 'dev'")
    done = rounds.run_rounds(strategy, strategy, ctx, saved(teacher), dev, [n // 8, n // 8], 0.001, soft=soft)
    return committed.read(spark, done.metrics)


# Streams


@query("stream_vocab", "SELECT word, count(*) AS n FROM tok GROUP BY word")
def stream_vocab(spark, d):
    docs = jobs.stream_table(spark, d, "documents")
    return jobs.running_vocab(tokens(stream_sentences(docs)), work_path(spark, "stream-vocab"))


def stream_sentences(docs):
    return document_sentences(docs)


@query("stream_unique_words", "SELECT count(*) AS n_words FROM (SELECT DISTINCT word FROM tok)")
def stream_unique_words(spark, d):
    docs = jobs.stream_table(spark, d, "documents")
    rows = jobs.unique_words(tokens(stream_sentences(docs)), work_path(spark, "stream-unique"))
    return rows.agg(F.count(F.lit(1)).alias("n_words"))


ARRIVALS = 4
_ARRIVAL = f"(strpos('0123456789abcdef', substr(md5(CAST(src_id AS VARCHAR)), 1, 1)) - 1) // {16 // ARRIVALS}"


@query(
    "stream_running_totals",
    f"WITH a AS (SELECT {_ARRIVAL} AS batch, word FROM tok), f AS (SELECT min(batch) AS batch, word FROM a GROUP BY word), "
    "n AS (SELECT batch, count(*) AS n FROM a GROUP BY batch), k AS (SELECT batch, count(*) AS k FROM f GROUP BY batch) "
    "SELECT batch, CAST(sum(n) OVER (ORDER BY batch) AS BIGINT) AS n_tokens, CAST(sum(coalesce(k, 0)) OVER (ORDER BY batch) AS BIGINT) AS n_words FROM n LEFT JOIN k USING (batch)",
)
def stream_running_totals(spark, d):
    """Documents that arrive in four parts; the stream is stopped and started again between them."""
    docs = spark.read.parquet(f"{d}/documents.parquet")
    digit = F.conv(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 1), 16, 10).cast("int")
    arriving, out = work_path(spark, "arriving"), work_path(spark, "stream-totals")
    for part in range(ARRIVALS):
        docs.where(F.floor(digit / (16 // ARRIVALS)) == part).write.mode("append").parquet(arriving)
        stream = spark.readStream.schema(docs.schema).parquet(arriving)
        totals.add_totals(tokens(stream_sentences(stream)), out)
    return totals.totals(spark, out)


@query(
    "stream_label_append",
    walk_sql("bench_ctx", "bench_feats", "teacher") + " SELECT src_id, CAST(seg AS BIGINT) AS seg, CAST(pos AS BIGINT) AS pos, t1 AS tag, "
    "round(exp(z) / total, 6) AS p_best FROM g WHERE pos >= 0",
)
def stream_label_append(spark, d):
    """Label benchmark sentences as they arrive with a model of the event tags."""
    teacher, _, _ = teacher_student(spark, d)
    teacher = saved(teacher)
    items = jobs.stream_table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), "text", F.lit("").alias("lang"))
    rows = jobs.label_append(stream_sentences(items), lambda df: rounds.label_batch(df, teacher), work_path(spark, "stream-labels"))
    return rows.select("src_id", big("seg").alias("seg"), big("pos").alias("pos"), "tag", r6(F.array_max("p")).alias("p_best"))
