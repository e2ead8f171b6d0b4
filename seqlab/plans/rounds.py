"""Labelling, training rounds and selection strategies.

A round is a driver loop over Spark jobs: choose sentences, label them with the teacher,
append the labelled rows to a store, train the student on all of them, compare, log.
Only counts, model weights of bounded size and the tag list reach the driver.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqlab.functions.vectors import SCORES
from seqlab.operators import agreement, features, linear, ngram, sampling, selection, training, vocab
from seqlab.operators.linear import LinearModel
from seqlab.operators.scale import running_sum, union_all
from seqlab.session import work_path, written
from seqlab.sources.corpora import KEY, TOKEN, pack
from seqlab.sources.models import append_metrics, long_metrics


def split_by_filter(sentences: DataFrame, allowed: Column) -> tuple[DataFrame, DataFrame]:
    """Sentences that may be labelled, and the rejected ones as their own table."""
    return sentences.where(allowed), sentences.where(~allowed)


def with_grid(rows: DataFrame, params: dict[str, list], condition: Column) -> DataFrame:
    """Each row with every admissible combination of the parameters, generated in place."""
    for name, values in params.items():
        rows = rows.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return rows.where(condition)


# Labelling


def label_batch(sentences: DataFrame, teacher: LinearModel) -> DataFrame:
    """Decode sentences and make training rows: features with the teacher's own tags as
    history, the arg-max tag as ``tag``, the probability row as ``p``."""
    decoded = written(linear.greedy_decode(sentences, teacher), "decoded")
    rows = features.examples(pack(decoded, tags="pred"))
    return rows.join(decoded.select(*TOKEN, "p"), TOKEN)


def append_labels(rows: DataFrame, store: str, batch: int) -> None:
    """Add one batch to the store. A batch that is written again replaces itself."""
    rows.write.mode("overwrite").parquet(f"{store}/batch={batch}")


def stored_labels(spark, store: str) -> DataFrame:
    return spark.read.parquet(store)


def train_to_target(
    rows: DataFrame, dev: DataFrame, tags: list[str], grid: list[tuple[float, int]], target: float = 0.966
) -> tuple[LinearModel, list[tuple[float, int, float]]]:
    """Train over (reg, max_iter) settings, keep the best on dev, stop at the target accuracy."""
    names = written(features.feature_vocab(rows), "vocabulary")
    train = linear.hard_targets(rows, tags)
    best, tried = None, []
    for reg, iterations in grid:
        model = linear.train_softmax(train, names, tags, reg, iterations)
        hit = (F.col("pred") == F.col("tag")).cast("double")
        acc = linear.predicted(linear.predict_proba(dev, model), tags).agg(F.avg(hit)).first()[0]
        tried.append((reg, iterations, acc))
        if best is None or acc > best[1]:
            best = (model, acc)
        if acc > target:
            break
    return best[0], tried


# Corpora and language models prepared for the strategies


class Bundle(NamedTuple):
    """Processed tokens with their original, the word list, the narrow version, both models."""

    full: DataFrame
    words: DataFrame
    narrow: DataFrame
    full_lm: ngram.NGramModel
    narrow_lm: ngram.NGramModel


def corpus_bundle(tokens: DataFrame, min_freq: int, n_words: int) -> Bundle:
    full = written(vocab.preprocess(tokens, vocab.word_norms(tokens, min_freq)), "full")
    words = written(vocab.top_words(full.where("split = 'train'"), n_words), "words")
    narrow = written(vocab.preprocess(tokens, vocab.allowlist_norms(tokens, words)), "narrow")
    lms = [ngram.fit(ngram.trigram_counts(pack(t.where("split = 'train'")))) for t in (full, narrow)]
    return Bundle(full, words, narrow, *lms)


# Strategies


class Strategy(NamedTuple):
    source: str  # words, uniform, train, lm, beam, chunks
    score: str
    tries: int  # draws per word, or candidates per chosen sentence


STRATEGIES = {
    "UNIGRAMS": Strategy("words", "constant", 1),
    "MAX_SIGNIFICANCE": Strategy("words", "margin", 10),
    "MAX_GRADIENT": Strategy("words", "gradient", 10),
    "MAX_ENTROPY": Strategy("words", "entropy", 10),
    "FROM_TRAIN_SET": Strategy("train", "constant", 1),
    "FROM_TRAIN_SET_MAX_ENTROPY": Strategy("train", "entropy", 10),
    "FROM_TRAIN_SET_MAX_GRADIENT": Strategy("train", "gradient", 10),
    "LANGUAGE_MODEL": Strategy("lm", "constant", 1),
    "MAX_ENTROPY_LANGUAGE_MODEL": Strategy("lm", "entropy", 10),
    "MAX_GRADIENT_LANGUAGE_MODEL": Strategy("lm", "gradient", 10),
    "BEAM_LANGUAGE_MODEL": Strategy("beam", "constant", 3),
    "BEAM_MAX_ENTROPY_LANGUAGE_MODEL": Strategy("beam", "entropy", 3),
    "BEAM_MAX_GRADIENT_LANGUAGE_MODEL": Strategy("beam", "gradient", 3),
    "IID_WORDS": Strategy("uniform", "constant", 1),
    "SEQUENTIAL": Strategy("chunks", "constant", 1),
}


class Context(NamedTuple):
    """What the strategies choose from. ``used`` counts words of earlier batches."""

    train: DataFrame  # sentences
    counts: DataFrame  # word, n: target frequencies over the word list
    used: DataFrame  # word, used
    generator: sampling.Sampler | None
    validator: ngram.NGramModel | None
    student: LinearModel | None
    length: int = 25
    ratio: float = 1.05
    lm_length: int = 40
    beam: sampling.BeamSettings = sampling.BeamSettings(0.4, 0.55, 100.0, 3, 3, 20, 30)
    seed: int = 123
    start: int = 0  # candidates that earlier batches of the run have taken from the source


def sentence_scores(sentences: DataFrame, model: LinearModel, score: str) -> DataFrame:
    """Mean score per sentence over the rows of the model's own decoding."""
    rows = linear.greedy_decode(sentences, model)
    return rows.groupBy(*KEY).agg(F.avg(SCORES[score](F.col("p"))).alias("score"))


def _numbered(rows: DataFrame, number: str, batch: int) -> DataFrame:
    """Generated sentences in the corpus schema."""
    return rows.select(
        F.col(number).cast("bigint").alias("src_id"), F.lit(batch).cast("int").alias("seg"),
        F.lit("train").alias("split"), "words", F.array_repeat(F.lit(""), F.size("words")).alias("tags"),
    )


def _candidates(s: Strategy, ctx: Context, n: int, batch: int) -> DataFrame:
    """``n`` candidates, going on in the source where the run stands."""
    spark = ctx.train.sparkSession
    seed, end = ctx.seed, ctx.start + n
    ids = spark.range(ctx.start, end)
    if s.source in ("words", "uniform"):
        if s.source == "uniform":
            weights = ctx.counts.select("word", F.lit(1).alias("n"))
        else:
            shares = selection.proportional_weights(ctx.counts, ctx.used, ctx.ratio)
            weights = written(shares.where("weight > 0").select("word", F.col("weight").alias("n")), "shares")
        model = ctx.student if s.score != "constant" else None
        scorer = sampling.WordScorer(model, SCORES[s.score])
        return _numbered(sampling.greedy_sentences(ids, weights, ctx.length, scorer, s.tries, seed), "id", batch)
    if s.source == "train":
        drawn = selection.cycle(ctx.train, KEY, seed, end).where(F.col("draw") >= ctx.start)
        return _numbered(drawn, "draw", batch)
    if s.source == "lm":
        b = ctx.beam
        return _numbered(sampling.lm_sample(ids, ctx.generator, b.l1, b.l2, ctx.lm_length, seed), "id", batch)
    if s.source == "beam":
        model = ctx.student if s.score != "constant" else None
        scorer = sampling.WordScorer(model, SCORES[s.score])
        rows = sampling.beam_sentences(ids, ctx.generator, ctx.validator, scorer, ctx.beam._replace(tries=s.tries), seed)
        return _numbered(rows, "id", batch)
    if s.source == "chunks":
        n_words = ctx.counts.count()
        per_pass = math.ceil(n_words / ctx.length)
        rows = selection.vocab_chunks(ctx.counts, ctx.length, math.ceil(end / per_pass), seed)
        draw = F.col("pass") * per_pass + F.col("chunk")
        rows = rows.withColumn("draw", draw).where((F.col("draw") >= ctx.start) & (F.col("draw") < end))
        return _numbered(rows, "draw", batch)
    raise ValueError(f"unknown source {s.source}")


def choose(name: str, ctx: Context, n: int, batch: int) -> DataFrame:
    """``n`` sentences by a named strategy. Best-of-n strategies draw ``tries`` candidates per
    wanted sentence, drop repeated contents and keep the best scored, numbered by rank."""
    s = STRATEGIES[name]
    if s.source not in ("train", "lm") or s.score == "constant":
        return _candidates(s, ctx, n, batch)
    pool = _candidates(s, ctx, n * s.tries, batch)
    content = F.sha2(F.concat_ws("\u001f", "words"), 256)
    once = pool.groupBy(content.alias("_content")).agg(F.min_by(F.struct(*pool.columns), "src_id").alias("s"))
    pool = written(once.select("s.*"), "pool")
    scored = pool.join(sentence_scores(pool, ctx.student, s.score), KEY)
    best = selection.best_n(scored, "score", KEY, n).withColumn("src_id", F.col("rank").cast("bigint"))
    return best.drop("score", "rank")


def candidates_per_choice(name: str) -> int:
    """How many candidates of its source a strategy takes for each sentence."""
    s = STRATEGIES[name]
    return s.tries if s.source in ("train", "lm") and s.score != "constant" else 1


def take_tokens(sentences: DataFrame, budget: int) -> DataFrame:
    """Sentences in draw order until the budget is used; the crossing one stays."""
    n = F.size("words").cast("bigint")
    summed = running_sum(sentences.withColumn("_n", n), [], ["src_id"], None, F.col("_n"), "_upto")
    return summed.where(F.col("_upto") - F.col("_n") < budget).drop("_n", "_upto")


# Rounds


class Round(NamedTuple):
    store: str
    metrics: str
    student: LinearModel


def run_rounds(
    run: str,
    strategy: str,
    ctx: Context,
    teacher: LinearModel,
    dev: DataFrame,
    budgets: list[int],
    reg: float,
    max_iter: int = 50,
    soft: bool = False,
    allowed: Column | None = None,
) -> Round:
    """Active-learning rounds. The first batch comes from uniform word draws, later ones from
    the strategy. With ``soft`` the student learns the teacher's probabilities instead of its
    labels. ``allowed`` refuses sentences that must not be labelled."""
    spark = ctx.train.sparkSession
    store, metrics = work_path(spark, "labels"), work_path(spark, "metrics")
    tags = teacher.tags
    dev = written(label_batch(dev, teacher).withColumnRenamed("p", "tp"), "dev")
    mean_length = ctx.train.agg(F.avg(F.size("words"))).first()[0]
    student, taken = None, {}
    for batch, budget in enumerate(budgets):
        name = "IID_WORDS" if batch == 0 else strategy
        source = STRATEGIES[name].source
        expected = {"train": mean_length, "lm": mean_length, "beam": ctx.beam.min_length + 1}.get(source, ctx.length)
        state = ctx._replace(student=student, used=_used(spark, store, ctx, batch), start=taken.get(name, 0))
        sentences, asked = _fill(name, state, budget, max(1.0, expected), batch)
        taken[name] = state.start + asked
        if allowed is not None and not split_by_filter(sentences, allowed)[1].isEmpty():
            raise ValueError("the strategy chose sentences that must not be labelled")
        append_labels(label_batch(sentences, teacher), store, batch)
        rows = stored_labels(spark, store)
        if soft:
            train = rows.withColumn("target", F.col("p"))
        else:
            train = linear.hard_targets(rows, tags)
        # The student goes on from its weights; features that it has not met start from zero.
        fitted = training.lbfgs(train, tags, reg, start=student, max_steps=max_iter, tolerance=1e-3)
        student = linear.center(fitted.model)
        student = student._replace(weights=written(student.weights, "student"))
        append_metrics(long_metrics(_state(student, teacher, dev, rows, reg), run, batch), metrics, f"{run}-{batch}")
    return Round(store, metrics, student)


def _fill(name: str, ctx: Context, budget: int, expected: float, batch: int) -> tuple[DataFrame, int]:
    """Sentences for one budget, and how many candidates of the source they used up.

    Lengths vary, so the number wanted is doubled until the budget is met. A strategy that has
    nothing more to give before that is an error."""
    wanted, before = math.ceil(budget / expected), -1
    each = candidates_per_choice(name)
    while True:
        chosen = written(choose(name, ctx, wanted, batch), "candidates")
        total = chosen.agg(F.sum(F.size("words"))).first()[0] or 0
        if total >= budget:
            kept = written(take_tokens(chosen, budget), "chosen")
            # Best-of-n looks at all its candidates; other sources stand after the last one kept.
            asked = wanted * each if each > 1 else kept.agg(F.max("src_id")).first()[0] + 1 - ctx.start
            return kept, int(asked)
        if total == before:
            raise ValueError(f"{name} has {total} tokens left, {budget} are asked for")
        wanted, before = wanted * 2, total


def _used(spark, store: str, ctx: Context, batch: int) -> DataFrame:
    if batch == 0:
        return ctx.used
    words = stored_labels(spark, store).groupBy("word").agg(F.count(F.lit(1)).alias("used"))
    return union_all([words, ctx.used]).groupBy("word").agg(F.sum("used").alias("used"))


def _state(student: LinearModel, teacher: LinearModel, dev: DataFrame, rows: DataFrame, reg: float) -> DataFrame:
    """The round's record: divergence, distance, norms, accuracy, tokens and words so far."""
    scored = linear.predict_proba(dev, student, TOKEN)
    pairs = dev.select(*TOKEN, "tp").join(scored.select(*TOKEN, F.col("p").alias("sp")), TOKEN)
    near = agreement.agreement(pairs)
    stats = agreement.weight_stats(agreement.weights_compare(teacher, student)).first()
    fitted = linear.predict_proba(rows, student, [*TOKEN, "batch", "tag"])
    names = F.array(*[F.lit(t) for t in student.tags])
    nll = fitted.agg(F.avg(-F.ln(F.element_at("p", F.array_position(names, F.col("tag")).cast("int"))))).first()[0]
    used = rows.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("word").alias("w")).first()
    loss = nll + reg * stats.norm_student
    return near.select(
        F.col("accuracy").alias("accuracies"),
        F.col("kl_rows").alias("validation KL"),
        F.lit(float(stats.l2_distance)).alias("l2 distances"),
        F.lit(float(stats.norm_student)).alias("w l2 norm"),
        F.lit(float(reg * stats.norm_student / loss)).alias("norm percent from loss"),
        F.lit(int(used.n)).alias("Single word queries amounts"),
        F.lit(int(used.w)).alias("unique_words_amounts"),
    )
