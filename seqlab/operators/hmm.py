"""Trigram hidden-Markov tagger: count tables, probabilities, and decoding per sentence."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqlab.operators.chunked_paths import MAX_STATES, decode
from seqlab.operators.scale import checked_small, lookup
from seqlab.operators.tagging import MAX_TAGS
from seqlab.operators.vocab import word_tag_counts
from seqlab.session import written
from seqlab.sources.corpora import KEY, pack

START = "<START>"
END = "<STOP>"
# The dense transition table is K^3 doubles and is sent to every task.
MAX_DENSE_TAGS = 128
#: Tokens above which a sequence is spread over several tasks.
CHUNK = 4096


class HmmCounts(NamedTuple):
    tri: DataFrame  # t1 t2 t3 n
    bi: DataFrame  # t2 t3 n
    uni: DataFrame  # t3 n
    emit: DataFrame  # word tag n


def tag_trigrams(sentences: DataFrame) -> DataFrame:
    n = F.size("tags")
    start = F.array(F.lit(START))
    cut = sentences.select(
        F.concat(start, start, F.slice("tags", F.lit(1), n - 1)).alias("t1"),
        F.concat(start, "tags").alias("t2"),
        F.concat("tags", F.array(F.lit(END))).alias("t3"),
    )
    rows = cut.select(F.inline(F.arrays_zip("t1", "t2", "t3")))
    return rows.groupBy("t1", "t2", "t3").agg(F.count(F.lit(1)).alias("n"))


def train(sentences: DataFrame, tokens: DataFrame) -> HmmCounts:
    """Bigrams include (start, start); unigrams count one start and the stop per sentence."""
    tri = tag_trigrams(sentences)
    pairs = tri.groupBy("t2", "t3").agg(F.sum("n").alias("n"))
    starts = pairs.where(F.col("t2") == START).groupBy("t2").agg(F.sum("n").alias("n"))
    bi = pairs.unionByName(starts.select("t2", F.col("t2").alias("t3"), "n"))
    uni = bi.groupBy("t3").agg(F.sum("n").alias("n"))
    return HmmCounts(tri, bi, uni, word_tag_counts(tokens))


def token_total(counts: HmmCounts) -> DataFrame:
    """Tokens plus one stop per sentence: the start is in the unigrams but not in the total."""
    return counts.uni.where(F.col("t3") != START).agg(F.sum("n").alias("n"))


def transition_probs(counts: HmmCounts, l1: float, l2: float, unigram_of: str = "target") -> DataFrame:
    """Interpolated transition probability of every tag trigram seen.

    ``unigram_of='target'`` backs off to the frequency of the predicted tag;
    ``'oldest'`` to that of the tag two places before it.
    """
    total = token_total(counts).scalar()
    side = "t3" if unigram_of == "target" else "t1"
    bi_ctx = counts.uni.select(F.col("t3").alias("t2"), F.col("n").alias("c2"))
    pair_ctx = counts.bi.select(F.col("t2").alias("t1"), F.col("t3").alias("t2"), F.col("n").alias("c12"))
    pair = counts.bi.select("t2", "t3", F.col("n").alias("c23"))
    one = counts.uni.select(F.col("t3").alias(side), F.col("n").alias("c1"))
    joined = (
        counts.tri.join(pair_ctx, ["t1", "t2"])
        .join(pair, ["t2", "t3"])
        .join(bi_ctx, "t2")
        .join(one, side)
    )
    q = (
        (1 - l1 - l2) * F.col("c1") / total
        + l2 * F.col("c23") / F.col("c2")
        + l1 * F.col("n") / F.col("c12")
    )
    return joined.select("t1", "t2", "t3", q.alias("q"))


def emission_probs(counts: HmmCounts) -> DataFrame:
    per_tag = counts.emit.groupBy("tag").agg(F.sum("n").alias("n_tag"))
    return counts.emit.join(F.broadcast(per_tag), "tag").select(
        "word", "tag", (F.col("n") / F.col("n_tag")).alias("e")
    )


class TagModel(NamedTuple):
    """The part of the model that only depends on the tag set, small enough to send out."""

    tags: list[str]
    prior: list[float]
    tri: np.ndarray  # [K+1, K+1, K+1] counts; index K is start as context, stop as target
    bi: np.ndarray
    uni_target: np.ndarray
    uni_source: np.ndarray
    total: int


def tag_model(counts: HmmCounts) -> TagModel:
    tag_rows = checked_small(
        counts.emit.groupBy("tag").agg(F.sum("n").alias("n")), MAX_TAGS, "tags"
    )
    by_tag = {r.tag: r.n for r in tag_rows}
    tags = sorted(by_tag)
    k = len(tags)
    if k > MAX_DENSE_TAGS:
        raise ValueError(f"{k} tags: a dense transition table is limited to {MAX_DENSE_TAGS}")
    at = {t: i for i, t in enumerate(tags)} | {START: k, END: k}
    tri = np.zeros((k + 1, k + 1, k + 1))
    for r in checked_small(counts.tri, (k + 1) ** 3, "tag trigrams"):
        tri[at[r.t1], at[r.t2], at[r.t3]] = r.n
    n_sents = tri[k, k].sum()
    bi = tri.sum(axis=0)
    uni = bi.sum(axis=0)
    source = uni.copy()
    source[k] = n_sents
    total = int(uni.sum())
    everything = sum(by_tag.values())
    return TagModel(tags, [by_tag[t] / everything for t in tags], tri, bi, uni, source, total)


def log_transitions(m: TagModel, l1: float, l2: float, unigram_of: str = "target") -> np.ndarray:
    """``ln q[t1, t2, t3]`` for all tags, start and stop."""
    if not (l1 >= 0 and l2 >= 0 and l1 + l2 < 1):
        raise ValueError("need l1, l2 >= 0 and l1 + l2 < 1")
    c12 = m.tri.sum(axis=2, keepdims=True)
    c2 = m.uni_source
    with np.errstate(divide="ignore", invalid="ignore"):
        p3 = np.where(c12 > 0, m.tri / c12, 0.0)
        p2 = np.where(c2[:, None] > 0, m.bi / c2[:, None], 0.0)[None, :, :]
        one = m.uni_target if unigram_of == "target" else m.uni_source
        p1 = one / m.total
        p1 = p1[None, None, :] if unigram_of == "target" else p1[:, None, None]
        return np.log((1 - l1 - l2) * p1 + l2 * p2 + l1 * p3)


def emission_vectors(counts: HmmCounts, m: TagModel) -> DataFrame:
    """One row per word: P(word | tag) in tag order."""
    per_tag = counts.emit.groupBy("tag").agg(F.sum("n").alias("n_tag"))
    each = counts.emit.join(F.broadcast(per_tag), "tag").withColumn("e", F.col("n") / F.col("n_tag"))
    cells = [F.sum(F.when(F.col("tag") == t, F.col("e")).otherwise(0.0)) for t in m.tags]
    return each.groupBy("word").agg(F.array(*cells).alias("emit"))


def with_emissions(tokens: DataFrame, counts: HmmCounts, m: TagModel) -> DataFrame:
    """Bring each word's emission vector to its tokens by a join, so that the word table is
    never sent out whole. Words never seen get the tag prior and ``unseen``."""
    found = lookup(tokens, emission_vectors(counts, m), ["word"])
    prior = F.array(*[F.lit(p) for p in m.prior])
    return found.withColumn("unseen", F.col("emit").isNull()).withColumn(
        "emit", F.coalesce("emit", prior)
    )


def best_path(log_emit: np.ndarray, log_q: np.ndarray) -> tuple[np.ndarray, float]:
    """Most probable tag path of one sentence and its log probability."""
    k = log_q.shape[0] - 1
    length = len(log_emit)
    delta = np.full((k + 1, k + 1), -np.inf)
    delta[k, k] = 0.0
    back = np.empty((length, k + 1, k), dtype=np.int16)
    for i in range(length):
        score = delta[:, :, None] + log_q[:, :, :k]
        back[i] = score.argmax(axis=0)
        delta = np.full((k + 1, k + 1), -np.inf)
        delta[:, :k] = score.max(axis=0) + log_emit[i]
    final = delta + log_q[:, :, k]
    u, v = np.unravel_index(final.argmax(), final.shape)
    best = float(final[u, v])
    path = np.empty(length, dtype=np.int64)
    for i in range(length - 1, -1, -1):
        path[i] = v
        u, v = back[i, u, v], u
    return path, best


def viterbi(
    tokens: DataFrame,
    counts: HmmCounts,
    grid: list[tuple[float, float]],
    unigram_of: str = "target",
    chunk: int = CHUNK,
) -> DataFrame:
    """Decode every sentence for every (l1, l2): rows with ``l1 l2 pos word tag pred score``.

    Sentences are decoded in parallel; only tag tables travel to the tasks. A sequence of more than
    ``chunk`` tokens is spread over tasks by chunks, see :mod:`chunked_paths`, if the tag set allows.
    """
    m = tag_model(counts)
    tables = {(a, b): log_transitions(m, a, b, unigram_of) for a, b in grid}
    shared = tokens.sparkSession.sparkContext.broadcast(tables)
    lits = F.inline(F.array(*[F.struct(F.lit(float(a)).alias("l1"), F.lit(float(b)).alias("l2")) for a, b in grid]))
    tags = m.tags
    fits = (len(tags) + 1) ** 2 <= MAX_STATES
    long = tokens.where(F.col("pos") >= chunk).select(*KEY).distinct()
    if not fits or long.isEmpty():
        decoded = _whole(with_emissions(tokens, counts, m), lits, shared, tags)
    else:
        long = written(long, "long_sequences")
        rows = with_emissions(tokens.join(long, KEY, "left_semi"), counts, m)
        row = F.struct("pos", F.col("word").alias("words"), F.col("tag").alias("tags"), "unseen", F.col("emit").alias("emits"))
        part = rows.groupBy(*KEY, "split", F.floor(F.col("pos") / chunk).cast("int").alias("idx"))
        packed = part.agg(F.array_sort(F.collect_list(row)).alias("r"))
        packed = packed.select(*KEY, "split", "idx", "r.words", "r.tags", "r.unseen", "r.emits")
        cut = decode(packed.select("*", lits), shared, tags)
        rest = with_emissions(tokens.join(long, KEY, "left_anti"), counts, m)
        decoded = cut.unionByName(_whole(rest, lits, shared, tags).withColumn("idx", F.lit(0)))
    if "idx" not in decoded.columns:
        decoded = decoded.withColumn("idx", F.lit(0))
    zipped = F.posexplode(F.arrays_zip("words", "tags", "unseen", "preds")).alias("at", "t")
    return decoded.select(*KEY, "split", "l1", "l2", "score", "idx", zipped).select(
        *KEY, (F.col("idx") * chunk + F.col("at")).cast("int").alias("pos"), "split", "l1", "l2", "score",
        F.col("t.words").alias("word"), F.col("t.tags").alias("tag"),
        F.col("t.unseen").alias("unseen"), F.col("t.preds").alias("pred"),
    )


def _whole(rows: DataFrame, lits: Column, shared, tags: list[str]) -> DataFrame:
    """Decode sentences that are one row each."""
    jobs = pack(rows, emits="emit", unseen="unseen").select("*", lits)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            paths, scores = [], []
            for emits, l1, l2 in zip(pdf["emits"], pdf["l1"], pdf["l2"]):
                with np.errstate(divide="ignore"):
                    log_emit = np.log(np.stack(emits))
                path, score = best_path(log_emit, shared.value[(l1, l2)])
                paths.append([tags[i] for i in path])
                scores.append(score)
            yield pdf.drop(columns=["emits"]).assign(preds=paths, score=scores)

    schema = (
        "src_id long, seg int, split string, words array<string>, tags array<string>, "
        "unseen array<boolean>, l1 double, l2 double, preds array<string>, score double"
    )
    return jobs.select(*KEY, "split", "words", "tags", "unseen", "l1", "l2", "emits").mapInPandas(run, schema)


def tune(tokens: DataFrame, counts: HmmCounts, grid: list[tuple[float, float]]) -> DataFrame:
    """Accuracy of each (l1, l2) on the given tokens."""
    decoded = viterbi(tokens, counts, grid)
    hit = (F.col("pred") == F.col("tag")).cast("double")
    return decoded.groupBy("l1", "l2").agg(
        F.count(F.lit(1)).alias("n_tokens"),
        F.count(F.when(F.col("unseen"), 1)).alias("n_unseen"),
        F.avg(hit).alias("accuracy"),
    )


def first_best(scored: DataFrame, value: str, order: list[str]) -> DataFrame:
    """The row with the largest value, the first in ``order`` on ties."""
    return scored.orderBy(F.desc(value), *order).limit(1)
