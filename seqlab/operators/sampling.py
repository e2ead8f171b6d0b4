"""Weighted draws, sentences sampled from a language model, greedy and beam generation.

Draws use a guide table: each context's [0, 1) line is cut into as many slots as it has
elements, and an interval is filed under every slot it touches. A draw joins on (context,
slot) and meets about two intervals, so no draw is compared with a whole distribution.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import count
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from seqlab.functions.draws import uniform
from seqlab.functions.text import UNKNOWN, feature_array
from seqlab.functions.vectors import argmax
from seqlab.operators.linear import LinearModel, predict_proba
from seqlab.operators.ngram import BEGIN, STOP, NGramModel, backoff, cdf, interpolate
from seqlab.operators.scale import MAX_HEAVY, lookup, union_all
from seqlab.session import written


def guide(intervals: DataFrame, context: list[str]) -> DataFrame:
    lo_slot = F.floor(F.col("lo") * F.col("size"))
    hi_slot = F.least(F.col("size") - 1, F.floor(F.col("hi") * F.col("size")))
    slots = F.explode(F.sequence(lo_slot, hi_slot)).alias("slot")
    return intervals.select(*context, "element", "lo", "hi", slots)


def weighted_draw(requests: DataFrame, counts: DataFrame, element: str, u: str = "u") -> DataFrame:
    """Independent draws in proportion to ``n``: adds ``element`` to rows that carry ``u``."""
    intervals = cdf(counts, [], element).withColumnRenamed(element, "element")
    size = counts.agg(F.count(F.lit(1))).scalar()
    asked = requests.withColumn("slot", F.floor(F.col(u) * size))
    hit = (F.col(u) >= F.col("lo")) & (F.col(u) < F.col("hi"))
    # Of the two sides only a short guide may be broadcast, never the requests, however small their files are.
    few = intervals.limit(MAX_HEAVY + 1).count() <= MAX_HEAVY
    slots = guide(intervals, []).hint("broadcast" if few else "merge")
    return asked.join(slots, "slot").where(hit).select(*requests.columns, "element")


class Sampler(NamedTuple):
    """Language model tables arranged for draws, written once and used at every step."""

    sizes: DataFrame  # ord c1 c2 size
    slots: DataFrame  # ord c1 c2 slot element lo hi


def sampler(model: NGramModel) -> Sampler:
    none = F.lit("")
    tri = model.tri.select(F.lit(3).alias("ord"), F.col("w1").alias("c1"), F.col("w2").alias("c2"), F.col("w3").alias("element"), "n")
    bi = model.bi.select(F.lit(2).alias("ord"), none.alias("c1"), F.col("w2").alias("c2"), F.col("w3").alias("element"), "n")
    uni = model.uni.select(F.lit(1).alias("ord"), none.alias("c1"), none.alias("c2"), F.col("w3").alias("element"), "n")
    context = ["ord", "c1", "c2"]
    intervals = written(cdf(union_all([tri, bi, uni]), context, "element"), "intervals")
    sizes = intervals.groupBy(*context).agg(F.max("size").alias("size"))
    return Sampler(written(sizes, "sizes"), written(guide(intervals, context), "slots"))


def next_words(state: DataFrame, s: Sampler, l1: float, l2: float, mode: Column, u: Column) -> DataFrame:
    """Draw the next word after (w1, w2): from trigrams with probability l1, bigrams with l2,
    else unigrams; a context the model has not seen falls to the next order. Adds ``word``."""
    cols = state.columns
    rows = state.withColumn("_mode", mode).withColumn("_u", u)
    three = s.sizes.where("ord = 3").select(F.col("c1").alias("w1"), F.col("c2").alias("w2"), F.col("size").alias("_s3"))
    two = s.sizes.where("ord = 2").select(F.col("c2").alias("w2"), F.col("size").alias("_s2"))
    one = s.sizes.where("ord = 1").agg(F.max("size")).scalar()
    rows = lookup(lookup(rows, three, ["w1", "w2"]), two, ["w2"])
    by3 = (F.col("_mode") < l1) & F.col("_s3").isNotNull()
    by2 = ~by3 & (F.col("_mode") < l1 + l2) & F.col("_s2").isNotNull()
    size = F.when(by3, F.col("_s3")).when(by2, F.col("_s2")).otherwise(one)
    asked = rows.select(
        *cols, "_u",
        F.when(by3, 3).when(by2, 2).otherwise(1).alias("ord"),
        F.when(by3, F.col("w1")).otherwise("").alias("c1"),
        F.when(by3 | by2, F.col("w2")).otherwise("").alias("c2"),
        F.floor(F.col("_u") * size).alias("slot"),
    )
    hit = (F.col("_u") >= F.col("lo")) & (F.col("_u") < F.col("hi"))
    found = asked.join(s.slots, ["ord", "c1", "c2", "slot"]).where(hit)
    return found.select(*cols, F.col("element").alias("word"))


def lm_sample(ids: DataFrame, s: Sampler, l1: float, l2: float, max_length: int, seed: int) -> DataFrame:
    """One sentence per id, drawn word by word to the stop or ``max_length``; an empty
    sentence is drawn again. All sentences advance together, one job per position."""
    begin = F.lit(BEGIN)
    state = ids.select("id", F.array().cast("array<string>").alias("words"), begin.alias("w1"), begin.alias("w2"))
    done = []
    for at in range(max_length):
        attempt, active, moved = 0, state, []
        while True:
            tag = F.lit(f"{at}.{attempt}")
            drawn = written(
                next_words(active, s, l1, l2, uniform(seed, F.col("id"), tag, F.lit("mode")), uniform(seed, F.col("id"), tag, F.lit("word"))),
                "draws",
            )
            moved.append(drawn.where(F.col("word") != STOP))
            stopped = drawn.where(F.col("word") == STOP)
            if at > 0:
                done.append(stopped.select("id", "words"))
                break
            if stopped.isEmpty():
                break
            active, attempt = stopped.drop("word"), attempt + 1
        state = union_all(moved).select(
            "id", F.concat("words", F.array("word")).alias("words"), F.col("w2").alias("w1"), F.col("word").alias("w2")
        )
        if at + 1 < max_length and state.isEmpty():
            break
    return union_all([*done, state.select("id", "words")])


class WordScorer(NamedTuple):
    """A model and a score over its probability row; ``model=None`` scores everything 0."""

    model: LinearModel | None
    score: Callable[[Column], Column]


def _at(array: str, back: int, pad: str) -> Column:
    """The element ``back`` places before the end of an array, or the padding."""
    return F.coalesce(F.get(F.col(array), F.size(array) - 1 - back), F.lit(pad))


def score_last_word(rows: DataFrame, scorer: WordScorer, keys: list[str]) -> DataFrame:
    """Score the last word of each prefix as the model would see it, its successor unknown.

    ``rows`` carry ``words`` and ``tags``, the tags of all words but the last two; the tag of
    the last but one is settled here, now that its successor is known. Adds ``score``.
    Prefixes are as many as ids: their joins are sorted, as a broadcast would bring them to the driver.
    """
    if scorer.model is None:
        return rows.withColumn("score", F.lit(0.0))
    context = {
        "word": _at("words", 1, BEGIN), "next_word": _at("words", 0, BEGIN),
        "prev_word": _at("words", 2, BEGIN), "prevprev_word": _at("words", 3, BEGIN),
        "prev_tag": _at("tags", 0, "*"), "prevprev_tag": _at("tags", 1, "*"),
    }
    older = rows.where(F.size("words") > 1).select(*keys, feature_array(context).alias("features"))
    names = F.array(*[F.lit(t) for t in scorer.model.tags])
    settled = predict_proba(older, scorer.model, keys).select(
        *keys, F.element_at(names, argmax(F.col("p")) + 1).alias("_tag")
    )
    rows = written(
        rows.join(settled.hint("merge"), keys, "left").withColumn(
            "tags", F.when(F.col("_tag").isNull(), F.col("tags")).otherwise(F.concat("tags", F.array("_tag")))
        ).drop("_tag"),
        "prefixes",
    )
    context = {
        "word": _at("words", 0, BEGIN), "next_word": F.lit(UNKNOWN),
        "prev_word": _at("words", 1, BEGIN), "prevprev_word": _at("words", 2, BEGIN),
        "prev_tag": _at("tags", 0, "*"), "prevprev_tag": _at("tags", 1, "*"),
    }
    newest = rows.select(*keys, feature_array(context).alias("features"))
    scored = predict_proba(newest, scorer.model, keys).select(*keys, scorer.score(F.col("p")).alias("score"))
    return rows.join(scored.hint("merge"), keys)


def greedy_sentences(
    ids: DataFrame, weights: DataFrame, length: int, scorer: WordScorer, tries: int, seed: int
) -> DataFrame:
    """For each position draw ``tries`` words by weight and keep the best scored.

    ``weights``: ``word``, ``n``. One job per position when a model scores; a single job when
    the score does not look at earlier words.
    """
    if scorer.model is None:
        # Equal scores: the first draw stays, so one draw per position is enough.
        places = ids.select("id", F.explode(F.sequence(F.lit(0), F.lit(length - 1))).alias("at"))
        asked = places.withColumn("u", uniform(seed, F.col("id"), F.col("at"), F.lit(0)))
        drawn = weighted_draw(asked, weights, "word")
        return drawn.groupBy("id").agg(
            F.transform(F.array_sort(F.collect_list(F.struct("at", "element"))), lambda x: x["element"]).alias("words")
        )
    empty = F.array().cast("array<string>")
    state = ids.select("id", empty.alias("words"), empty.alias("tags"))
    for at in range(length):
        each = state.select("*", F.explode(F.sequence(F.lit(0), F.lit(tries - 1))).alias("try"))
        asked = each.withColumn("u", uniform(seed, F.col("id"), F.lit(at), F.col("try")))
        drawn = weighted_draw(asked, weights, "word")
        cands = written(drawn.select("id", "try", F.concat("words", F.array("element")).alias("words"), "tags"), "candidates")
        scored = score_last_word(cands, scorer, ["id", "try"])
        best = F.min_by(F.struct("words", "tags"), F.struct(-F.col("score"), F.element_at("words", -1), F.col("try")))
        state = written(scored.groupBy("id").agg(best.alias("b")).select("id", "b.words", "b.tags"), "greedy")
    return state.select("id", "words")


class BeamSettings(NamedTuple):
    l1: float
    l2: float
    max_perplexity: float
    beam: int
    tries: int
    min_length: int
    max_length: int
    patience: int = 25


def beam_sentences(
    ids: DataFrame, generator: Sampler, validator: NGramModel, scorer: WordScorer, b: BeamSettings, seed: int
) -> DataFrame:
    """Beam search over sampled words, all ids at once, one round of jobs per position.

    Prefixes whose perplexity under the validating model is too high are dropped once they
    are longer than three words; a stop ends a candidate longer than the minimum; the best
    mean score wins. Ids without a sentence are tried again with new draws until each has one;
    when none of those left finds any in ``patience`` passes running, the validating model is
    taken to refuse them all and the search ends with an error. A group holds
    ``beam * tries`` rows at most.
    """
    pending, found, left, idle = ids.select("id"), [], None, 0
    for attempt in count():
        options = _beam_pass(pending, generator, validator, scorer, b, f"{seed}.{attempt}")
        best = F.max_by("words", F.struct("score", F.array_join("words", " "))).alias("words")
        chosen = written(options.groupBy("id").agg(best, F.max("score").alias("score")), "options")
        found.append(chosen)
        pending = written(pending.join(chosen, "id", "left_anti"), "pending")
        before, left = left, pending.count()
        if not left:
            return union_all(found)
        idle = idle + 1 if left == before else 0
        if idle == b.patience:
            raise ValueError(f"{left} sentences could not be found below perplexity {b.max_perplexity}")


def _beam_pass(ids, generator, validator, scorer, b: BeamSettings, seed: str) -> DataFrame:
    empty = F.array().cast("array<string>")
    begin = F.lit(BEGIN)
    state = ids.select(
        "id", F.lit(0).alias("cand"), empty.alias("words"), empty.alias("tags"), begin.alias("w1"), begin.alias("w2"),
        F.lit(0.0).alias("score_sum"), F.lit(0.0).alias("log2_sum"),
    )
    options = []
    for at in range(b.max_length):
        each = state.select("*", F.explode(F.sequence(F.lit(0), F.lit(b.tries - 1))).alias("try"))
        if at == b.max_length - 1:
            drawn = each.where("try = 0").withColumn("word", F.lit(STOP))
        else:
            ident = (F.lit(seed), F.lit(at), F.col("id"), F.col("cand"), F.col("try"))
            drawn = next_words(each, generator, b.l1, b.l2, uniform(0, *ident, F.lit("mode")), uniform(0, *ident, F.lit("word")))
        scored = backoff(drawn.withColumn("w3", F.col("word")), validator)
        step = F.coalesce(F.log2(interpolate(b.l1, b.l2)), F.lit(float("-inf")))
        rows = scored.withColumn("log2_sum", F.col("log2_sum") + step)
        if at > 2:
            perplexity = F.pow(F.lit(2.0), -F.col("log2_sum") / (F.size("words") + 1))
            rows = rows.where(perplexity <= b.max_perplexity)
        rows = written(rows.select(*drawn.columns, ), "beam-draws")
        ended = rows.where((F.col("word") == STOP) & (F.size("words") > b.min_length))
        options.append(ended.select("id", (F.col("score_sum") / F.size("words")).alias("score"), "words"))
        alive = rows.where(F.col("word") != STOP).withColumn("words", F.concat("words", F.array("word")))
        alive = score_last_word(alive, scorer, ["id", "cand", "try"])
        alive = alive.withColumn("score_sum", F.col("score_sum") + F.col("score"))
        rank = F.row_number().over(
            W.partitionBy("id").orderBy(F.desc("score_sum"), F.desc("log2_sum"), F.desc(F.array_join("words", " ")), "cand", "try")
        )
        state = written(
            alive.withColumn("_rank", rank).where(F.col("_rank") <= b.beam).select(
                "id", (F.col("_rank") - 1).alias("cand"), "words", "tags", F.col("w2").alias("w1"), F.col("word").alias("w2"),
                "score_sum", "log2_sum",
            ),
            "beam",
        )
        if state.isEmpty():
            break
    return union_all(options)
