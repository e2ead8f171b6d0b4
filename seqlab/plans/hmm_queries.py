"""Hidden-Markov tagger queries on the event sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqlab.operators import hmm, tagging
from seqlab.operators.scale import number_rows
from seqlab.plans.fragments import HMM_L1, HMM_L2, MIN_FREQ
from seqlab.plans.registry import big, query, r6
from seqlab.session import written
from seqlab.sources.corpora import pack, seq, seq_tokens

GRID = [(a, b) for a in (0.97, 0.98, 0.99) for b in (0.005, 0.01, 0.015) if a + b < 1]


def counts(spark, d) -> hmm.HmmCounts:
    rows = seq_tokens(spark, d).where("split = 'train'")
    return hmm.train(pack(rows), rows)


@query(
    "held_out_accuracy",
    "WITH v AS (SELECT word FROM seq WHERE split = 'train' GROUP BY word HAVING count(*) >= 2), m AS (SELECT word, tag AS pred FROM (SELECT word, tag, "
    "row_number() OVER (PARTITION BY word ORDER BY count(*) DESC, tag) AS k FROM seq WHERE split = 'train' AND word IN (SELECT word FROM v) GROUP BY word, tag) WHERE k = 1) "
    "SELECT split, count(*) AS n_tokens, count(*) FILTER (pred IS NULL) AS n_unseen, round(avg(CASE WHEN pred = tag THEN 1.0 ELSE 0.0 END), 6) AS accuracy "
    "FROM seq LEFT JOIN m USING (word) WHERE split <> 'train' GROUP BY split",
)
def held_out_accuracy(spark, d):
    from seqlab.operators import vocab

    rows = seq_tokens(spark, d)
    done = vocab.preprocess(rows, vocab.word_norms(rows, MIN_FREQ))
    model = tagging.most_frequent_tag(done.where("split = 'train'"))
    scored = tagging.accuracy(tagging.predict_by_lookup(done.where("split <> 'train'"), model), ["split"])
    return scored.withColumn("accuracy", r6("accuracy"))


@query(
    "emission_counts",
    "SELECT word, tag, n, NULL::BIGINT AS n_tag FROM hmm_emit UNION ALL SELECT NULL, tag, NULL, CAST(n AS BIGINT) FROM hmm_tag",
)
def emission_counts(spark, d):
    emit = counts(spark, d).emit
    per_tag = emit.groupBy("tag").agg(F.sum("n").alias("n_tag"))
    none = F.lit(None)
    return emit.select("word", "tag", "n", none.cast("bigint").alias("n_tag")).union(
        per_tag.select(none.cast("string").alias("word"), "tag", none.cast("bigint").alias("n"), "n_tag")
    )


@query(
    "transition_counts",
    "SELECT t1, t2, t3, n FROM hmm_tri UNION ALL SELECT '', t2, t3, CAST(n AS BIGINT) FROM hmm_bi UNION ALL SELECT '', '', t3, CAST(n AS BIGINT) FROM hmm_uni",
)
def transition_counts(spark, d):
    c = counts(spark, d)
    none = F.lit("")
    return c.tri.select("t1", "t2", "t3", "n").union(c.bi.select(none, "t2", "t3", "n")).union(c.uni.select(none, none, "t3", "n"))


def _q_sql(unigram: str) -> str:
    return (
        f"SELECT a.t1, a.t2, a.t3, (1 - {HMM_L1} - {HMM_L2}) * u.n / (SELECT n FROM hmm_total) + {HMM_L2} * b.n / c.n + {HMM_L1} * a.n / d.n AS q "
        f"FROM hmm_tri a JOIN hmm_bi b ON b.t2 = a.t2 AND b.t3 = a.t3 JOIN hmm_uni c ON c.t3 = a.t2 "
        f"JOIN hmm_bi d ON d.t2 = a.t1 AND d.t3 = a.t2 JOIN hmm_uni u ON u.t3 = a.{unigram}"
    )


@query(
    "hmm_probs",
    f"SELECT 'target' AS kind, t1, t2, t3, round(q, 6) AS p FROM ({_q_sql('t3')}) UNION ALL SELECT 'oldest', t1, t2, t3, round(q, 6) FROM ({_q_sql('t1')}) "
    "UNION ALL SELECT 'emission', word, '', tag, round(e.n / t.n, 6) FROM hmm_emit e JOIN hmm_tag t USING (tag)",
)
def hmm_probs(spark, d):
    c = counts(spark, d)
    parts = []
    for kind in ("target", "oldest"):
        q = hmm.transition_probs(c, HMM_L1, HMM_L2, kind)
        parts.append(q.select(F.lit(kind).alias("kind"), "t1", "t2", "t3", r6("q").alias("p")))
    e = hmm.emission_probs(c)
    emission = e.select(F.lit("emission").alias("kind"), F.col("word").alias("t1"), F.lit("").alias("t2"), F.col("tag").alias("t3"), r6("e").alias("p"))
    return parts[0].union(parts[1]).union(emission)


# All transitions, also those never seen, then one best score per (sentence, position, last two tags).
_VITERBI = f"""RECURSIVE WITH q AS (SELECT x.t AS t1, y.t AS t2, z.t AS t3,
  ln((1 - {HMM_L1} - {HMM_L2}) * u.n / (SELECT n FROM hmm_total) + {HMM_L2} * coalesce(b.n, 0) / c.n
     + {HMM_L1} * coalesce(a.n / d.n, 0)) AS lq
  FROM (SELECT tag AS t FROM hmm_tag UNION ALL SELECT '<START>') x CROSS JOIN (SELECT tag AS t FROM hmm_tag UNION ALL SELECT '<START>') y
  CROSS JOIN (SELECT tag AS t FROM hmm_tag UNION ALL SELECT '<STOP>') z
  JOIN hmm_uni u ON u.t3 = z.t JOIN hmm_uni c ON c.t3 = y.t LEFT JOIN hmm_bi b ON b.t2 = y.t AND b.t3 = z.t
  LEFT JOIN hmm_bi d ON d.t2 = x.t AND d.t3 = y.t LEFT JOIN hmm_tri a ON a.t1 = x.t AND a.t2 = y.t AND a.t3 = z.t),
seen AS (SELECT DISTINCT word FROM hmm_emit),
em AS (SELECT w.src_id, w.seg, w.pos, t.tag AS t3, ln(CASE WHEN s.word IS NULL THEN t.n / (SELECT sum(n) FROM hmm_tag) ELSE e.n / t.n END) AS le
  FROM seq w CROSS JOIN hmm_tag t LEFT JOIN seen s ON s.word = w.word
  LEFT JOIN hmm_emit e ON e.word = w.word AND e.tag = t.tag WHERE s.word IS NULL OR e.n IS NOT NULL),
v AS (SELECT src_id, seg, -1 AS pos, '<START>' AS t2, '<START>' AS t3, CAST(0.0 AS DOUBLE) AS score, CAST([] AS VARCHAR[]) AS path
  FROM (SELECT DISTINCT src_id, seg FROM seq)
  UNION ALL
  SELECT v.src_id, v.seg, em.pos, v.t3, em.t3, max(v.score + q.lq + em.le), arg_max(list_append(v.path, em.t3), v.score + q.lq + em.le)
  FROM v JOIN em ON em.src_id = v.src_id AND em.seg = v.seg AND em.pos = v.pos + 1 JOIN q ON q.t1 = v.t2 AND q.t2 = v.t3 AND q.t3 = em.t3
  GROUP BY v.src_id, v.seg, em.pos, v.t3, em.t3),
f AS (SELECT v.src_id, v.seg, max(v.score + q.lq) AS score, arg_max(v.path, v.score + q.lq) AS path
  FROM v JOIN q ON q.t1 = v.t2 AND q.t2 = v.t3 AND q.t3 = '<STOP>'
  WHERE v.pos = (SELECT max(pos) FROM seq s WHERE s.src_id = v.src_id AND s.seg = v.seg) GROUP BY v.src_id, v.seg)
SELECT src_id, CAST(seg AS BIGINT) AS seg, round(score, 6) AS score, array_to_string(path, ' ') AS path FROM f"""


def decoded(spark, d, grid):
    rows = seq_tokens(spark, d)
    return hmm.viterbi(rows, counts(spark, d), grid)


@query("viterbi_decode", _VITERBI)
def viterbi_decode(spark, d):
    return paths(decoded(spark, d, [(HMM_L1, HMM_L2)]))


def paths(rows):
    """The tag path of each sequence and its score."""
    path = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "pred"))), lambda x: x["pred"]), " ")
    return rows.groupBy("src_id", "seg").agg(r6(F.first("score")).alias("score"), path.alias("path")).select(
        "src_id", big("seg").alias("seg"), "score", "path"
    )


_USERS = "SELECT src_id, 0 AS seg, row_number() OVER (PARTITION BY src_id ORDER BY seg, pos) - 1 AS pos, word, tag FROM seq"
_VITERBI_USERS = _VITERBI
for _use in ("FROM seq w", "FROM seq)", "FROM seq s"):
    _VITERBI_USERS = _VITERBI_USERS.replace(_use, _use.replace("seq", "useq"))
_VITERBI_USERS = _VITERBI_USERS.replace("WITH q AS", f"WITH useq AS MATERIALIZED ({_USERS}), q AS", 1)


@query("viterbi_users", _VITERBI_USERS)
def viterbi_users(spark, d):
    """All events of a user as one sequence, decoded in chunks of 64 tokens."""
    rows = seq_tokens(spark, d)
    whole = number_rows(rows.withColumnRenamed("pos", "at"), ["src_id"], ["seg", "at"], F.col("seg"), "pos")
    whole = written(whole.select("src_id", F.lit(0).alias("seg"), F.col("pos").cast("int").alias("pos"), "word", "tag", "split"), "users")
    return paths(hmm.viterbi(whole, counts(spark, d), [(HMM_L1, HMM_L2)], chunk=64))


@query("hmm_tune")
def hmm_tune(spark, d):
    """Accuracy on dev per (l1, l2), and that of the best pair on test."""
    rows = seq_tokens(spark, d)
    c = counts(spark, d)
    dev = hmm.tune(rows.where("split = 'dev'"), c, GRID)
    dev = written(dev, "tuned")
    best = hmm.first_best(dev, "accuracy", ["l1", "l2"]).first()
    if best is None:
        raise ValueError("no dev sequences to tune on")
    test = hmm.tune(rows.where("split = 'test'"), c, [(best.l1, best.l2)])
    return dev.withColumn("split", F.lit("dev")).unionByName(test.withColumn("split", F.lit("test")))


@query(
    "param_grid",
    "SELECT split, l1, l2, count(*) AS n_sentences FROM (SELECT DISTINCT src_id, seg, split FROM seq), (VALUES "
    + ", ".join(f"({a}::DOUBLE, {b}::DOUBLE)" for a, b in GRID)
    + ") g(l1, l2) GROUP BY split, l1, l2",
)
def param_grid(spark, d):
    """Every sentence with every admissible pair: the work list of a tuning run."""
    from seqlab.plans.rounds import with_grid

    work = with_grid(seq(spark, d).select("split"), {"l1": [0.97, 0.98, 0.99], "l2": [0.005, 0.01, 0.015]}, F.col("l1") + F.col("l2") < 1)
    return work.groupBy("split", "l1", "l2").agg(F.count(F.lit(1)).alias("n_sentences"))
