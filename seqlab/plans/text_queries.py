"""Corpora, vocabularies, rare-word classes and the most-frequent-tag model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqlab.functions import text as tx
from seqlab.operators import selection, tagging, vocab
from seqlab.plans.fragments import MIN_FREQ, TOP_N
from seqlab.plans.registry import big, query, r6
from seqlab.session import work_path, written
from seqlab.sources import files
from seqlab.sources.corpora import (
    KEY, benchmark_sentences, conversation_tokens, document_sentences, not_empty, seq, seq_tokens,
    table, tok, tokens,
)


def sentences(spark: SparkSession, d: str) -> DataFrame:
    """The documents' sentences, cut once and written for the several passes over their tokens."""
    return written(tok(spark, d), "sentences", compression="zstd")


def processed(spark: SparkSession, d: str, packed: DataFrame | None = None) -> DataFrame:
    rows = tokens(sentences(spark, d) if packed is None else packed)
    return vocab.preprocess(rows, vocab.word_norms(rows, MIN_FREQ))


def allowed_words(spark: SparkSession, d: str, packed: DataFrame | None = None) -> DataFrame:
    return vocab.top_words(processed(spark, d, packed).where("split = 'train'"), TOP_N)


def narrow(spark: SparkSession, d: str) -> DataFrame:
    packed = sentences(spark, d)
    rows = tokens(packed)
    return vocab.preprocess(rows, vocab.allowlist_norms(rows, allowed_words(spark, d, packed)))


# Sources and sinks


def sentence_counts(rows):
    """How often each sentence, with its tags, was read."""
    return files.sentences(rows).groupBy("words", "tags").agg(F.count(F.lit(1)).alias("n"))


def _sentence_counts_sql(source):
    return (
        "SELECT words, tags, count(*) AS n FROM (SELECT string_agg(word, ' ' ORDER BY pos) AS words, string_agg(tag, ' ' ORDER BY pos) AS tags "
        f"FROM {source} GROUP BY src_id, seg) GROUP BY words, tags"
    )


@query("read_conll", _sentence_counts_sql("seq"))
def read_conll(spark, d):
    path = work_path(spark, "conll")
    files.write_conll(seq(spark, d), path)
    return sentence_counts(files.read_conll(spark, path))


@query("read_docs", _sentence_counts_sql("tok"))
def read_docs(spark, d):
    path = work_path(spark, "docs")
    files.write_docs(tok(spark, d), path)
    return sentence_counts(files.read_docs(spark, path))


@query(
    "read_vocab_table",
    "SELECT word, count(*) AS n, round(count(*) / (SELECT count(*) FROM tok), 6) AS freq FROM tok GROUP BY word",
)
def read_vocab_table(spark, d):
    counts = vocab.vocab_count(tokens(tok(spark, d)))
    total = counts.agg(F.sum("n")).scalar()
    path = work_path(spark, "vocab")
    files.write_vocab_table(counts.withColumn("freq", F.col("n") / total), path)
    return files.read_vocab_table(spark, path).select("word", "n", r6("freq").alias("freq"))


@query("tokens_from_documents", "SELECT src_id, CAST(seg AS BIGINT) AS seg, CAST(pos AS BIGINT) AS pos, word, tag, split FROM tok")
def tokens_from_documents(spark, d):
    return tokens(tok(spark, d)).select("src_id", big("seg").alias("seg"), big("pos").alias("pos"), "word", "tag", "split")


@query("sequences_from_events", "SELECT src_id, CAST(seg AS BIGINT) AS seg, CAST(pos AS BIGINT) AS pos, word, tag, split FROM seq")
def sequences_from_events(spark, d):
    return seq_tokens(spark, d).select("src_id", big("seg").alias("seg"), big("pos").alias("pos"), "word", "tag", "split")


@query("sequences_from_conversations", "SELECT src_id, CAST(seg AS BIGINT) AS seg, CAST(pos AS BIGINT) AS pos, word, tag, split FROM conv")
def sequences_from_conversations(spark, d):
    rows = conversation_tokens(table(spark, d, "conversations"))
    return rows.select("src_id", big("seg").alias("seg"), big("pos").alias("pos"), "word", "tag", "split")


_LOG_SQL = """
SELECT run, metric, step, round(value, 6) AS value FROM (
  SELECT event_type AS run, row_number() OVER (PARTITION BY event_type ORDER BY day) - 1 AS step,
         unnest(['accuracies', 'Single word queries amounts']) AS metric, unnest([v, CAST(n AS DOUBLE)]) AS value
  FROM (SELECT event_type, CAST(ts AS DATE) AS day, round(avg(value), 6) AS v, count(*) AS n FROM events GROUP BY 1, 2))
WHERE run <> 'error'
"""


def daily(spark: SparkSession, d: str) -> DataFrame:
    """Mean value and rows per event type and day: a short series per run."""
    events = table(spark, d, "events").select("event_type", "value", F.to_date("ts").alias("day"))
    return events.groupBy("event_type", "day").agg(F.round(F.avg("value"), 6).alias("v"), F.count(F.lit(1)).alias("n"))


@query("parse_run_logs", _LOG_SQL)
def parse_run_logs(spark, d):
    days = daily(spark, d).groupBy(F.col("event_type").alias("run")).agg(
        F.array_sort(F.collect_list(F.struct("day", "v", F.col("n").cast("double").alias("n")))).alias("s")
    )
    done = F.col("run") != "error"
    pairs = F.array(
        F.struct(F.lit("accuracies").alias("metric"), F.col("s.v").alias("values")),
        F.struct(F.lit("Single word queries amounts").alias("metric"), F.col("s.n").alias("values")),
    )
    series = days.select("run", done.alias("done"), F.lit("[0.0]").alias("stale"), F.inline(pairs))
    path = work_path(spark, "logs")
    files.write_run_logs(series, path)
    rows = files.parse_run_logs(spark, path)
    run = F.regexp_extract("file", "run=([^/]+)", 1)
    return rows.select(run.alias("run"), "metric", big("step").alias("step"), r6("value").alias("value"))


@query(
    "parse_run_name",
    "SELECT user_id, CAST(user_id AS VARCHAR) AS words, '0.01' AS l2, '0.001' AS improvement, event_type AS method, "
    "event_type || ',impr=0.001,reg=0.01' AS title, count(*) AS n FROM events GROUP BY user_id, event_type",
)
def parse_run_name(spark, d):
    events = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    name = F.format_string("logs/words%s_l2_weight0.01_lossimpr0.001_run100_%s.txt", F.col("user_id").cast("string"), "event_type")
    named = events.withColumn("name", name)
    parsed = files.parse_run_name(named, "name")
    return parsed.join(named.select("name", "user_id", "n"), "name").drop("name")


# Projections and word functions


@query("untag", "SELECT src_id, CAST(seg AS BIGINT) AS seg, array_to_string(words, ' ') AS sentence FROM tok_sent")
def untag(spark, d):
    return tok(spark, d).select("src_id", big("seg").alias("seg"), F.array_join("words", " ").alias("sentence"))


@query("invert_mapping", "SELECT n, max(word) AS word FROM (SELECT word, count(*) AS n FROM tok GROUP BY word) GROUP BY n")
def invert_mapping(spark, d):
    return vocab.invert_mapping(vocab.vocab_count(tokens(tok(spark, d))), "word", "n", "word").select("n", "word")


@query(
    "invert_permutation",
    "SELECT p AS position, row_number() OVER (ORDER BY word) - 1 AS id FROM "
    "(SELECT word, row_number() OVER (ORDER BY md5('7|' || word), word) - 1 AS p FROM (SELECT DISTINCT word FROM tok))",
)
def invert_permutation(spark, d):
    ids = vocab.vocab_ids(tokens(tok(spark, d)))
    shuffled = selection.seeded_shuffle(ids, ["word"], 7)
    return vocab.invert_mapping(shuffled.select("id", "rank"), "id", "rank", "id").select(F.col("rank").alias("position"), "id")


@query("tag_codec", "SELECT CAST(t.class_id AS BIGINT) AS class_id, t.tag, count(*) AS n FROM seq JOIN seq_tags t USING (tag) GROUP BY 1, 2")
def tag_codec(spark, d):
    rows = seq_tokens(spark, d)
    tags = tagging.tag_list(rows)
    coded = tagging.encode_tags(rows.select("tag"), tags).select("class_id")
    back = tagging.decode_tags(coded, tags, "class_id", "tag")
    return back.groupBy(big("class_id").alias("class_id"), "tag").agg(F.count(F.lit(1)).alias("n"))


@query("rare_word_class", "SELECT word, n, as_first, as_later FROM tok_norm")
def rare_word_class(spark, d):
    return vocab.word_norms(tokens(tok(spark, d)), MIN_FREQ).select("word", "n", "as_first", "as_later")


@query(
    "token_shape_flags",
    "SELECT word, CAST(regexp_matches(word, '[0-9]') AS BIGINT) AS has_digit, CAST(regexp_matches(word, '[a-zA-Z]') AS BIGINT) AS has_letter, "
    "CAST(regexp_matches(word, '^[A-Z][.]$') AS BIGINT) AS is_initial FROM (SELECT DISTINCT word FROM tok)",
)
def token_shape_flags(spark, d):
    w = F.col("word")
    flags = [big(tx.has_digit(w)).alias("has_digit"), big(tx.has_letter(w)).alias("has_letter"), big(tx.is_initial(w)).alias("is_initial")]
    return tokens(tok(spark, d)).select("word").distinct().select("word", *flags)


@query(
    "preprocess_corpus",
    "SELECT src_id, CAST(seg AS BIGINT) AS seg, CAST(pos AS BIGINT) AS pos, word, tag, CAST(replaced AS BIGINT) AS replaced FROM tok_pre",
)
def preprocess_corpus(spark, d):
    return processed(spark, d).select(
        "src_id", big("seg").alias("seg"), big("pos").alias("pos"), "word", "tag", big("replaced").alias("replaced")
    )


@query("replaced_rate", "SELECT split, count(*) AS n_tokens, round(avg(CAST(replaced AS DOUBLE)), 6) AS rate FROM tok_pre GROUP BY split")
def replaced_rate(spark, d):
    return processed(spark, d).groupBy("split").agg(
        F.count(F.lit(1)).alias("n_tokens"), r6(F.avg(F.col("replaced").cast("double"))).alias("rate")
    )


@query("preprocess_allowlist", "SELECT split, word, count(*) AS n FROM tok_narrow GROUP BY split, word")
def preprocess_allowlist(spark, d):
    return narrow(spark, d).groupBy("split", "word").agg(F.count(F.lit(1)).alias("n"))


@query(
    "drop_empty_sentences",
    "SELECT src_id, count(*) AS n_all, count(*) FILTER (len(words) > 0) AS n_kept FROM tok_all GROUP BY src_id",
)
def drop_empty_sentences(spark, d):
    everything = document_sentences(table(spark, d, "documents"), keep_empty=True)
    return everything.groupBy("src_id").agg(
        F.count(F.lit(1)).alias("n_all"), F.count(F.when(not_empty(), 1)).alias("n_kept")
    )


@query("pad_sentence", "SELECT src_id, CAST(seg AS BIGINT) AS seg, '<s> <s> ' || array_to_string(words, ' ') || ' </s>' AS padded FROM tok_sent")
def pad_sentence(spark, d):
    from seqlab.operators.ngram import padded

    return tok(spark, d).select("src_id", big("seg").alias("seg"), F.array_join(padded(F.col("words")), " ").alias("padded"))


@query(
    "sentence_filter",
    "SELECT src_id, CAST(seg AS BIGINT) AS seg, CAST(len(words) AS BIGINT) AS n, "
    "CASE WHEN len(words) <= 40 THEN 'accepted' ELSE 'rejected' END AS verdict FROM tok_sent",
)
def sentence_filter(spark, d):
    from seqlab.plans.rounds import split_by_filter

    accepted, rejected = split_by_filter(tok(spark, d), F.size("words") <= 40)
    both = accepted.withColumn("verdict", F.lit("accepted")).unionByName(rejected.withColumn("verdict", F.lit("rejected")))
    return both.select("src_id", big("seg").alias("seg"), big(F.size("words")).alias("n"), "verdict")


@query(
    "allowed_window4",
    "SELECT src_id, CAST(seg AS BIGINT) AS seg, CAST(sum(CASE WHEN a AND coalesce(lag1, true) AND coalesce(lag2, true) AND coalesce(nxt, true) THEN 1 ELSE 0 END) AS BIGINT) AS n_allowed FROM ("
    "SELECT src_id, seg, a, lag(a) OVER w AS lag1, lag(a, 2) OVER w AS lag2, lead(a) OVER w AS nxt FROM ("
    "SELECT t.src_id, t.seg, t.pos, k.word IS NOT NULL AS a FROM tok t LEFT JOIN tok_top k USING (word)) "
    "WINDOW w AS (PARTITION BY src_id, seg ORDER BY pos)) GROUP BY 1, 2",
)
def allowed_window4(spark, d):
    packed = sentences(spark, d)
    rows = vocab.allowed_windows(packed, allowed_words(spark, d, packed))
    return rows.select("src_id", big("seg").alias("seg"), big("n_allowed").alias("n_allowed"))


@query(
    "truncate_split",
    "WITH s AS (SELECT DISTINCT src_id, seg, split FROM seq), r AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY src_id, seg) AS k, count(*) OVER (PARTITION BY split) AS size FROM s) "
    "SELECT src_id, CAST(seg AS BIGINT) AS seg, split FROM r WHERE split = 'test' OR (split = 'train' AND k <= size // 2) OR (split = 'dev' AND k <= 5)",
)
def truncate_split(spark, d):
    """Half of the training sequences and five of dev."""
    rows = seq(spark, d)
    half = rows.where("split = 'train'").count() // 2
    return selection.first_of_splits(rows, {"train": half, "dev": 5}, KEY).select("src_id", big("seg").alias("seg"), "split")


# Joins


@query("vocab_lookup", "SELECT src_id, CAST(seg AS BIGINT) AS seg, CAST(sum(v.total) AS BIGINT) AS total FROM tok JOIN tok_vocab v USING (word) GROUP BY 1, 2")
def vocab_lookup(spark, d):
    from seqlab.operators.scale import lookup

    rows = tokens(tok(spark, d))
    counts = written(vocab.vocab_count(rows), "counts")
    found = lookup(rows, counts.withColumnRenamed("n", "total"), ["word"], counts)
    return found.groupBy("src_id", big("seg").alias("seg")).agg(F.sum("total").alias("total"))


_MFT = (
    "mft AS (SELECT word, tag AS pred FROM (SELECT word, tag, row_number() OVER (PARTITION BY word ORDER BY count(*) DESC, tag) AS k "
    "FROM {source} WHERE split = 'train' GROUP BY word, tag) WHERE k = 1)"
)


@query(
    "tag_by_lookup",
    "WITH " + _MFT.format(source="seq") + " SELECT src_id, CAST(seg AS BIGINT) AS seg, CAST(pos AS BIGINT) AS pos, word, tag, pred "
    "FROM seq LEFT JOIN mft USING (word)",
)
def tag_by_lookup(spark, d):
    rows = seq_tokens(spark, d)
    model = tagging.most_frequent_tag(rows.where("split = 'train'"))
    found = tagging.predict_by_lookup(rows, model)
    return found.select("src_id", big("seg").alias("seg"), big("pos").alias("pos"), "word", "tag", "pred")


@query(
    "anti_sentences",
    "WITH a AS (SELECT array_to_string(words, ' ') AS sentence, split FROM tok_sent UNION ALL SELECT array_to_string(words, ' '), 'train' FROM bench_sent) "
    "SELECT sentence, count(*) AS copies FROM a WHERE split <> 'dev' AND sentence NOT IN (SELECT sentence FROM a WHERE split = 'dev') GROUP BY sentence",
)
def anti_sentences(spark, d):
    docs = tok(spark, d)
    pool = docs.where("split <> 'dev'").unionByName(benchmark_sentences(table(spark, d, "benchmark")))
    return vocab.sentences_not_in(pool, docs.where("split = 'dev'"))


@query(
    "align_sentences",
    "SELECT src_id, count(*) AS n_tokens, count(*) FILTER (orig <> word) AS n_changed, CAST(0 AS BIGINT) AS n_missing FROM tok_pre GROUP BY src_id",
)
def align_sentences(spark, d):
    packed = sentences(spark, d)
    pairs = vocab.align(tokens(packed), processed(spark, d, packed))
    return pairs.groupBy("src_id").agg(
        F.count(F.lit(1)).alias("n_tokens"),
        F.count(F.when(F.col("a_word") != F.col("b_word"), 1)).alias("n_changed"),
        F.count(F.when(F.col("missing"), 1)).alias("n_missing"),
    )


# Aggregates


@query("vocab_count", "SELECT word, count(*) AS n FROM tok GROUP BY word")
def vocab_count(spark, d):
    return vocab.vocab_count(tokens(tok(spark, d)))


@query("word_tag_marginals", "SELECT 'word' AS kind, word AS key, count(*) AS n FROM tok GROUP BY word UNION ALL SELECT 'tag', tag, count(*) FROM tok GROUP BY tag")
def word_tag_marginals(spark, d):
    return vocab.word_tag_marginals(tokens(tok(spark, d)))


@query("most_frequent_tag", "WITH " + _MFT.format(source="tok") + " SELECT word, pred FROM mft")
def most_frequent_tag(spark, d):
    return tagging.most_frequent_tag(tokens(tok(spark, d)).where("split = 'train'"))


@query("tag_ambiguity", "SELECT round(sum(n * k) / sum(n), 6) AS ambiguity FROM (SELECT word, count(*) AS n, count(DISTINCT tag) AS k FROM tok GROUP BY word)")
def tag_ambiguity(spark, d):
    return tagging.tag_ambiguity(tokens(tok(spark, d))).select(r6("ambiguity").alias("ambiguity"))


@query(
    "token_accuracy",
    "WITH " + _MFT.format(source="tok_pre") + " SELECT split, count(*) AS n_tokens, count(*) FILTER (pred IS NULL) AS n_unseen, "
    "round(avg(CASE WHEN pred = tag THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM tok_pre LEFT JOIN mft USING (word) GROUP BY split",
)
def token_accuracy(spark, d):
    rows = processed(spark, d)
    model = tagging.most_frequent_tag(rows.where("split = 'train'"))
    scored = tagging.accuracy(tagging.predict_by_lookup(rows, model), ["split"])
    return scored.withColumn("accuracy", r6("accuracy"))


@query(
    "accuracy_on_replaced",
    "WITH " + _MFT.format(source="tok_pre") + " SELECT split, count(*) AS n_tokens, count(*) FILTER (pred IS NULL) AS n_unseen, "
    "round(avg(CASE WHEN pred = tag THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM tok_pre LEFT JOIN mft USING (word) WHERE orig <> word GROUP BY split",
)
def accuracy_on_replaced(spark, d):
    rows = processed(spark, d)
    model = tagging.most_frequent_tag(rows.where("split = 'train'"))
    changed = rows.where("orig <> word")
    scored = tagging.accuracy(tagging.predict_by_lookup(changed, model), ["split"])
    return scored.withColumn("accuracy", r6("accuracy"))


@query("top_words", "SELECT word, n FROM tok_top")
def top_words(spark, d):
    return allowed_words(spark, d)


# Set operations


@query(
    "concat_corpora",
    "SELECT corpus, src_id, CAST(seg AS BIGINT) AS seg, CAST(len(words) AS BIGINT) AS n FROM "
    "(SELECT 'documents' AS corpus, src_id, seg, words FROM tok_sent UNION ALL SELECT 'benchmark', src_id, seg, words FROM bench_sent)",
)
def concat_corpora(spark, d):
    a = tok(spark, d).withColumn("corpus", F.lit("documents"))
    b = benchmark_sentences(table(spark, d, "benchmark")).withColumn("corpus", F.lit("benchmark"))
    return a.unionByName(b).select("corpus", "src_id", big("seg").alias("seg"), big(F.size("words")).alias("n"))


@query(
    "vocab_with_specials",
    "SELECT word, row_number() OVER (ORDER BY word) - 1 AS id FROM (SELECT word FROM tok UNION SELECT '<s>' UNION SELECT '</s>')",
)
def vocab_with_specials(spark, d):
    return vocab.with_specials(tokens(tok(spark, d)))


@query(
    "subset_check",
    "SELECT n_words, n_outside FROM (SELECT count(DISTINCT word) AS n_words, count(DISTINCT word) FILTER (word NOT IN (SELECT word FROM tok_top)) AS n_outside FROM tok_narrow)",
)
def subset_check(spark, d):
    packed = sentences(spark, d)
    allowed = written(allowed_words(spark, d, packed), "allowed")
    rows = tokens(packed)
    words = written(vocab.preprocess(rows, vocab.allowlist_norms(rows, allowed)).select("word").distinct(), "words")
    missing = vocab.outside(words, allowed)
    return words.agg(F.count(F.lit(1)).alias("n_words")).select("n_words", missing.agg(F.count(F.lit(1))).scalar().alias("n_outside"))
