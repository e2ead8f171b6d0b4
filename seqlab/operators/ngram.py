"""Interpolated trigram language models as count tables."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqlab.operators import packed, pieces
from seqlab.operators.scale import lookup, running_sum, text_bucket
from seqlab.session import written
from seqlab.sources.corpora import KEY

BEGIN = "<s>"
STOP = "</s>"
GRAM = ["w1", "w2", "w3"]


class NGramModel(NamedTuple):
    """Counts ``n`` of each order. The total of a context is the count of that context as a
    gram of the order below (sentence starts apart), so no further table is needed."""

    tri: DataFrame  # w1 w2 w3 n
    bi: DataFrame  # w2 w3 n
    uni: DataFrame  # w3 n


class ModelWithin(NGramModel):
    """The model of some of the ``sentences`` that it is asked about, of those that are ``trained``.

    They come in pieces and are scored piece by piece; see :mod:`pieces`. The tables are made when they are read."""

    sentences: DataFrame
    trained: Column


def padded(words: Column) -> Column:
    return F.concat(F.array(F.lit(BEGIN), F.lit(BEGIN)), words, F.array(F.lit(STOP)))


def trigram_rows(sentences: DataFrame, *keep: str) -> DataFrame:
    """One row per real word and one per stop, with its two predecessors. No shuffle."""
    n = F.size("words")
    cut = sentences.select(
        *keep,
        F.concat(F.array(F.lit(BEGIN), F.lit(BEGIN)), F.slice("words", F.lit(1), n - 1)).alias("w1"),
        F.concat(F.array(F.lit(BEGIN)), "words").alias("w2"),
        F.concat("words", F.array(F.lit(STOP))).alias("w3"),
    )
    return cut.select(*keep, F.inline(F.arrays_zip(*GRAM)))


def trigram_counts(sentences: DataFrame) -> DataFrame:
    """Counted by tasks first, then in buckets of trigrams, which move packed."""
    return packed.merged(packed.trigram_messages(sentences, BEGIN, STOP), GRAM)


def lower_order(counts: DataFrame, *keys: str) -> DataFrame:
    """Counts of a lower order from those of a higher one: the corpus is read once."""
    return packed.summed(counts, [*keys])


def conditional(counts: DataFrame, context: list[str], out: str) -> DataFrame:
    """Add P(last word | context). Contexts with very many continuations are spread."""
    if not context:
        total = counts.agg(F.sum("n")).scalar()
        return counts.withColumn(out, F.col("n") / total)
    (word,) = [c for c in counts.columns if c not in (*context, "n")]
    return packed.shares(counts, context, word, "n", out)


def fit(counts: DataFrame) -> NGramModel:
    """The three orders from trigram counts, each written once: a model is a set of tables."""
    tri = written(counts, "trigrams", compression="zstd")
    bi = written(lower_order(tri, "w2", "w3"), "bigrams", compression="zstd")
    return NGramModel(tri, bi, written(lower_order(bi, "w3"), "unigrams", compression="zstd"))


def fit_within(sentences: DataFrame, trained: Column, scored: Column | None = None) -> tuple[NGramModel, DataFrame]:
    """The model of the ``trained`` sentences, and the distinct trigrams of the ``scored`` ones (all unless given).

    Both are counted in one pass: the trigrams come with their count ``m`` and what the model counts for
    them, ``n3``, so the corpus is shuffled once and the model's trigrams do not move again.
    Sentences that carry their ``piece`` are asked piece by piece, and the trigrams come with all that
    :func:`backoff` looks up.
    """
    if "piece" in sentences.columns:
        tri = trigram_counts(sentences.where(trained))
        bi = lower_order(tri, "w2", "w3")
        model = ModelWithin(tri, bi, lower_order(bi, "w3"))
        model.sentences, model.trained = sentences, trained
        return model, pieces.known_grams(sentences, trained, scored, BEGIN, STOP)
    asked = F.lit(True) if scored is None else F.coalesce(scored, F.lit(False))
    marked = sentences.select(
        "words", F.coalesce(trained, F.lit(False)).cast("int").alias("_trained"), asked.cast("int").alias("_asked")
    )
    rows = trigram_rows(marked.where("_trained + _asked > 0"), "_trained", "_asked")
    sums = rows.groupBy(*GRAM).agg(F.sum("_asked").alias("m"), F.sum("_trained").alias("n"))
    counts = written(sums, "trigrams")
    tri = counts.where("n > 0").select(*GRAM, "n")
    bi = written(lower_order(tri, "w2", "w3"), "bigrams")
    model = NGramModel(tri, bi, written(lower_order(bi, "w3"), "unigrams"))
    # A gram with a null word has no count, as in a join.
    whole = (F.col("n") > 0) & F.col("w1").isNotNull() & F.col("w2").isNotNull() & F.col("w3").isNotNull()
    return model, counts.where("m > 0").select(*GRAM, "m", F.when(whole, F.col("n")).alias("n3"))


def contexts(model: NGramModel) -> tuple[DataFrame, DataFrame]:
    """Totals of bigram contexts (w1, w2, c3) and of unigram contexts (w2, c2).

    Every gram that does not end a sentence is followed by exactly one word, so its count is
    its total as a context. The padding never ends a gram; its total is the sentence count.
    """
    starts = model.bi.where(F.col("w2") == BEGIN).agg(F.sum("n").alias("n"))
    begin = F.lit(BEGIN)
    pairs = model.bi.select(F.col("w2").alias("w1"), F.col("w3").alias("w2"), F.col("n").alias("c3"))
    words = model.uni.select(F.col("w3").alias("w2"), F.col("n").alias("c2"))
    return (
        pairs.union(starts.select(begin, begin, "n")),
        words.union(starts.select(begin, "n")),
    )


def backoff(grams: DataFrame, model: NGramModel) -> DataFrame:
    """Join the three orders to rows of (w1, w2, w3): columns n3 n2 n1 p3 p2 p1.

    Rows that carry ``n3`` already, those of :func:`fit_within`, are not joined to the trigrams, and
    those that carry all counts are joined to nothing.
    """
    if {*pieces.KNOWN} <= {*grams.columns}:
        rest = [c for c in grams.columns if c not in pieces.KNOWN]
        p3, p2, p1 = (F.col(n) / F.col(of) for n, of in (("n3", "c3"), ("n2", "c2"), ("n1", "n0")))
        return grams.select(*rest, "n3", "n2", "n1", p3.alias("p3"), p2.alias("p2"), p1.alias("p1"))
    total = model.uni.agg(F.sum("n")).scalar()
    pair_totals, word_totals = contexts(model)
    found = grams
    if "n3" not in grams.columns:
        found = lookup(grams, model.tri.select(*GRAM, F.col("n").alias("n3")), GRAM)
    found = lookup(found, pair_totals, ["w1", "w2"])
    found = lookup(found, model.bi.select("w2", "w3", F.col("n").alias("n2")), ["w2", "w3"])
    found = lookup(found, word_totals, ["w2"])
    found = lookup(found, model.uni.select("w3", F.col("n").alias("n1")), ["w3"])
    return found.select(
        *[c for c in grams.columns if c != "n3"], "n3", "n2", "n1",
        (F.col("n3") / F.col("c3")).alias("p3"),
        (F.col("n2") / F.col("c2")).alias("p2"),
        (F.col("n1") / total).alias("p1"),
    )


def interpolate(l1: float | Column, l2: float | Column) -> Column:
    """Interpolated probability; null for a word outside the vocabulary."""
    a, b = (x if isinstance(x, Column) else F.lit(x) for x in (l1, l2))
    zero = F.lit(0.0)
    return a * F.coalesce("p3", zero) + b * F.coalesce("p2", zero) + (1 - a - b) * F.col("p1")


def distinct_probs(sentences: DataFrame, model: NGramModel) -> DataFrame:
    """Back-off columns per distinct trigram of a corpus, with its count ``m``.

    Counting first means every trigram key meets the model once, however often it occurs.
    """
    grams = trigram_counts(sentences).withColumnRenamed("n", "m")
    return backoff(grams, model)


def perplexity(probs: DataFrame, grid: list[tuple[float, float]]) -> DataFrame:
    """Perplexity per (l1, l2). ``perplexity`` leaves stops out of the length, as is usual
    for this model family; ``perplexity_with_stop`` counts them. Unseen words are left out
    of the sum and of the length, and reported."""
    pairs = F.array(*[F.struct(F.lit(a).alias("l1"), F.lit(b).alias("l2")) for a, b in grid])
    each = probs.select("*", F.inline(pairs))
    known = F.col("p1").isNotNull()
    logs = F.log2(interpolate(F.col("l1"), F.col("l2"))) * F.col("m")
    word = known & (F.col("w3") != STOP)
    sums = each.groupBy("l1", "l2").agg(
        F.sum(F.when(known, logs)).alias("log2_sum"),
        F.sum(F.when(word, F.col("m")).otherwise(0)).alias("n_words"),
        F.sum(F.when(known, F.col("m")).otherwise(0)).alias("n_with_stop"),
        F.sum(F.when(~known, F.col("m")).otherwise(0)).alias("n_unseen"),
    )
    return sums.select(
        "l1", "l2", "n_words", "n_unseen",
        F.pow(F.lit(2.0), -F.col("log2_sum") / F.col("n_words")).alias("perplexity"),
        F.pow(F.lit(2.0), -F.col("log2_sum") / F.col("n_with_stop")).alias("perplexity_with_stop"),
    )


def sentence_loglik(
    sentences: DataFrame, model: NGramModel, l1: float, l2: float, grams: DataFrame | None = None
) -> DataFrame:
    """Sum of log2 probabilities of the words and the stop of each sentence.

    ``grams`` are the distinct trigrams of the sentences where :func:`fit_within` has counted them. A model of
    these very sentences answers their pieces, and no trigram passes a join.
    """
    if isinstance(model, ModelWithin) and model.sentences is sentences:
        return pieces.log2_likelihoods(sentences, model.trained, KEY, l1, l2, BEGIN, STOP)
    rows = trigram_rows(sentences, *KEY)
    # Score each distinct trigram once, then bring the result back to its places.
    if grams is None:
        grams = rows.groupBy(*GRAM).agg(F.count(F.lit(1)).alias("m"))
    scored = backoff(grams, model).select(*GRAM, "m", F.log2(interpolate(l1, l2)).alias("lg"))
    scored = written(scored, "scored")
    freq = scored.select(*GRAM, F.col("m").alias("n"))
    found = lookup(rows, scored.select(*GRAM, "lg"), GRAM, freq)
    return found.groupBy(*KEY).agg(
        F.sum("lg").alias("log2_likelihood"),
        F.count(F.when(F.col("lg").isNull(), 1)).alias("n_unseen"),
    )


def count_checks(sentences: DataFrame, counts: DataFrame) -> DataFrame:
    """Totals that must agree: tokens with stops = sum of each order; starts = sentences."""
    corpus = sentences.agg(
        F.sum(F.size("words") + 1).alias("n_tokens"), F.count(F.lit(1)).alias("n_sentences")
    )
    bi = lower_order(counts, "w2", "w3")
    uni = lower_order(bi, "w3")
    starts = F.col("w1").eqNullSafe(BEGIN) & F.col("w2").eqNullSafe(BEGIN)
    return corpus.select(
        "n_tokens",
        "n_sentences",
        counts.agg(F.sum("n")).scalar().alias("tri_total"),
        bi.agg(F.sum("n")).scalar().alias("bi_total"),
        uni.agg(F.sum("n")).scalar().alias("uni_total"),
        counts.agg(F.sum(F.when(starts, F.col("n")))).scalar().alias("tri_starts"),
        bi.agg(F.sum(F.when(F.col("w2") == BEGIN, F.col("n")))).scalar().alias("bi_starts"),
    )


def cdf(counts: DataFrame, context: list[str], element: str) -> DataFrame:
    """Intervals ``lo <= u < hi`` of each element in alphabetical order, and the context size.

    Fractional counts are made whole, in steps of 2**-32 of the largest, so that sums do not
    depend on their order and each interval begins where the one before ends.
    """
    if counts.schema["n"].dataType.typeName() in ("double", "float"):
        top = counts.agg(F.max("n")).scalar()
        counts = counts.withColumn("n", F.ceil(F.col("n") / top * F.lit(float(1 << 32))).cast("bigint"))
    # Heavy contexts, sums and totals each read the counts; they are made once.
    counts = written(counts, "counts")
    cumulated = running_sum(counts, context, [element], text_bucket(element), F.col("n"), "hi_n")
    if context:
        totals = counts.groupBy(*context).agg(
            F.sum("n").alias("total"), F.count(F.lit(1)).alias("size")
        )
        both = lookup(cumulated, totals, context)
    else:
        both = cumulated.select(
            "*",
            counts.agg(F.sum("n")).scalar().alias("total"),
            counts.agg(F.count(F.lit(1))).scalar().alias("size"),
        )
    return both.select(
        *context, element, "n", "size",
        ((F.col("hi_n") - F.col("n")) / F.col("total")).alias("lo"),
        (F.col("hi_n") / F.col("total")).alias("hi"),
    )
