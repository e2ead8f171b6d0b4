"""Orders, budgets, batches and top-k choices over large sets of sentences.

Random order means: sorted by a seeded md5 of the row's ids, so it is the same on every run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from seqlab.functions.draws import draw_key, hash_bucket
from seqlab.operators.scale import first_rows, next_at_or_after, number_rows, running_sum
from seqlab.session import discard, written


def seeded_shuffle(df: DataFrame, keys: list[str], seed: int, by: list[str] | None = None) -> DataFrame:
    """Add ``shuffle_key`` and the dense 0-based ``rank`` in seeded order, per ``by``."""
    keyed = df.withColumn("shuffle_key", draw_key(seed, *[F.col(k) for k in keys]))
    return number_rows(keyed, by or [], ["shuffle_key", *keys], hash_bucket(F.col("shuffle_key")), "rank")


def random_subset(df: DataFrame, keys: list[str], seed: int, n: int) -> DataFrame:
    """The first ``n`` rows in seeded order, with their ``shuffle_key``."""
    keyed = df.withColumn("shuffle_key", draw_key(seed, *[F.col(k) for k in keys]))
    return first_rows(keyed, ["shuffle_key", *keys], n, F.conv(F.substring("shuffle_key", 1, 13), 16, 10))


def first_of_splits(sentences: DataFrame, sizes: dict[str, int], keys: list[str]) -> DataFrame:
    """The first sentences of each split named in ``sizes``; other splits stay whole.

    The first of ``keys`` is a number."""
    out = sentences.where(~F.col("split").isin(list(sizes)) | F.col("split").isNull())
    for split, n in sizes.items():
        part = sentences.where(F.col("split") == split)
        out = out.unionByName(first_rows(part, keys, n, F.col(keys[0])))
    return out


def minibatches(df: DataFrame, keys: list[str], seed: int, size: int) -> DataFrame:
    """Shuffled rows in consecutive batches of ``size``; the last one may be short."""
    ranked = seeded_shuffle(df, keys, seed)
    return ranked.withColumn("batch", F.floor(F.col("rank") / size).cast("bigint"))


def token_budget(df: DataFrame, keys: list[str], seed: int, budget: int, length: str = "len") -> DataFrame:
    """Sentences in seeded order until the token budget is used; the crossing one stays."""
    keyed = df.withColumn("shuffle_key", draw_key(seed, *[F.col(k) for k in keys]))
    order = ["shuffle_key", *keys]
    summed = running_sum(keyed, [], order, None, F.col(length).cast("bigint"), "upto")
    return summed.where(F.col("upto") - F.col(length) < budget)


def budget_batches(
    df: DataFrame, order: list[str], sizes: list[int], length: str = "len", then: int | None = None
) -> DataFrame:
    """Cut sentences, in order, into batches: each takes sentences until its budget is used.

    ``sizes`` are the budgets of the first batches. With ``then``, batches of that budget follow to the end of the
    sentences; without, what comes after the last batch is left out. Adds ``upto``, the tokens so far, and ``batch``;
    the sentence that crosses a budget belongs to it, and the batch at the end may fall short.

    A batch starts where the one before stopped. Every place where one could start gets its successor,
    the first sentence that crosses the budget from there; the ends are then followed from the first one by
    pointer doubling: round k adds the 2^k ends that lie 2^k steps after the known ones. Only order and
    length pass through these steps; other columns are written once and meet their batch by row number.
    """
    row = "_budget_row"
    if {*df.columns} - {*order, length, row}:
        kept = written(df.withColumn(row, F.monotonically_increasing_id()), "kept")
        cut = budget_batches(kept.select(*order, length, row), order, sizes, length, then)
        return kept.join(cut.select(row, "upto", "batch"), row).select(*df.columns, "upto", "batch")
    summed = written(running_sum(df, [], order, None, F.col(length).cast("bigint"), "upto"), "summed")
    heads, start = [], 0
    for batch, size in enumerate(sizes):
        start = summed.where(F.col("upto") >= start + size).agg(F.min("upto")).first()[0]
        if start is None:
            break
        heads.append((start, batch))
    ends = df.sparkSession.createDataFrame(heads, "hi long, batch long")
    if start is not None and then is not None:
        ends = ends.union(_following_ends(summed.select("upto").distinct(), start, then, len(heads)))
    ends = written(ends, "ends")
    n_ends = ends.count()
    found = next_at_or_after(summed, "upto", ends, "hi", "hi")
    if start is not None and then is None:
        found = found.where("hi IS NOT NULL")
    return found.join(ends, "hi", "left").select(
        *summed.columns, F.coalesce("batch", F.lit(n_ends).cast("long")).alias("batch")
    )


def _following_ends(places: DataFrame, start: int, size: int, first: int) -> DataFrame:
    """(hi, batch) of the ends after ``start``, each ``size`` tokens or more after the one before."""
    spark = places.sparkSession
    origin = spark.range(1).select(F.lit(start).cast("long").alias("upto"))
    points = places.where(F.col("upto") > start).union(origin).withColumn("need", F.col("upto") + size)
    jump = next_at_or_after(points, "need", places, "upto", "to").where("to IS NOT NULL")
    jump = written(jump.select(F.col("upto").alias("at"), "to"), "jump")
    known, steps = written(origin.select(F.col("upto").alias("at"), F.lit(0).cast("long").alias("i")), "known"), 1
    while True:
        fresh = written(known.join(jump, "at").select(F.col("to").alias("at"), (F.col("i") + steps).alias("i")), "fresh")
        if fresh.isEmpty():
            return known.where("i > 0").select(F.col("at").alias("hi"), (F.col("i") + first - 1).alias("batch"))
        grown = written(known.union(fresh), "known")
        further = jump.select(F.col("at").alias("to"), F.col("to").alias("beyond"))
        longer = written(jump.join(further, "to").select("at", F.col("beyond").alias("to")), "jump")
        for old in (known, fresh, jump):
            discard(old)
        known, jump, steps = grown, longer, 2 * steps


def running_unique(rows: DataFrame) -> DataFrame:
    """Per batch, tokens used and distinct words seen so far. ``rows``: ``batch``, ``words``."""
    tokens = rows.groupBy("batch").agg(F.sum(F.size("words")).cast("bigint").alias("tokens"))
    first = rows.select("batch", F.explode("words").alias("word")).groupBy("word").agg(
        F.min("batch").alias("batch")
    )
    new = first.groupBy("batch").agg(F.count(F.lit(1)).alias("new_words"))
    both = tokens.join(new, "batch", "left").na.fill(0, ["new_words"])
    summed = running_sum(both, [], ["batch"], None, F.col("tokens"), "n_tokens")
    summed = running_sum(summed, [], ["batch"], None, F.col("new_words"), "n_words")
    return summed.select("batch", "n_tokens", "n_words")


def cycle(sentences: DataFrame, keys: list[str], seed: int | None, n: int) -> DataFrame:
    """Hand out ``n`` sentences round and round. Adds ``draw`` (0-based) and ``pass``.

    Each sentence works out its own draws from its rank; nothing is joined. Without a seed
    the order is that of the keys.
    """
    if seed is None:
        ranked = number_rows(sentences, [], keys, None, "rank")
    else:
        ranked = seeded_shuffle(sentences, keys, seed).drop("shuffle_key")
    size = sentences.agg(F.count(F.lit(1))).scalar()
    last = F.floor((F.lit(n) - 1 - F.col("rank")) / size)
    passes = F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("pass")
    out = ranked.where(F.col("rank") < n).select("*", passes)
    return out.withColumn("draw", F.col("pass") * size + F.col("rank"))


def vocab_chunks(words: DataFrame, length: int, passes: int, seed: int) -> DataFrame:
    """Distinct words in runs of ``length``: alphabetical first, reshuffled for later passes."""
    distinct = words.select("word").distinct()
    each = distinct.select("word", F.explode(F.sequence(F.lit(0), F.lit(passes - 1))).alias("pass"))
    key = F.when(F.col("pass") == 0, F.col("word")).otherwise(
        F.md5(F.concat_ws("|", (F.col("pass") + seed).cast("string"), F.col("word")))
    )
    keyed = each.select("pass", "word", key.alias("key"))
    ranked = number_rows(keyed, [], ["pass", "key", "word"], None, "rank")
    size = distinct.agg(F.count(F.lit(1))).scalar()
    local = F.col("rank") - F.col("pass") * size
    chunked = ranked.select("pass", "word", F.floor(local / length).alias("chunk"), local.alias("at"))
    return chunked.groupBy("pass", "chunk").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]).alias("words")
    )


def best_share(df: DataFrame, score: str, keys: list[str], one_in: int) -> DataFrame:
    """The best ``count // one_in`` rows by score, ids on ties: nothing is used twice."""
    size = df.agg(F.count(F.lit(1))).scalar()
    return ranked_by_score(df, score, keys).where(F.col("rank") < F.floor(size / one_in))


def best_n(df: DataFrame, score: str, keys: list[str], n: int) -> DataFrame:
    return ranked_by_score(df, score, keys).where(F.col("rank") < n)


def ranked_by_score(df: DataFrame, score: str, keys: list[str]) -> DataFrame:
    """Add the 0-based ``rank`` by falling score, ids on ties.

    Scores are compared to nine places: a mean that was summed in another order is a tie, so
    that runs and retries agree.
    """
    flipped = df.withColumn("_x", -F.round(score, 9))
    return number_rows(flipped, [], ["_x", *keys], None, "rank").drop("_x")


def usage_scores(words: DataFrame, used: DataFrame, vocab: DataFrame) -> DataFrame:
    """Minus the times a word was used; 0 for words outside the vocabulary."""
    counts = used.groupBy("word").agg(F.count(F.lit(1)).alias("used"))
    inside = vocab.select("word", F.lit(True).alias("inside"))
    rows = words.select("word").distinct().join(counts, "word", "left").join(inside, "word", "left")
    score = F.when(F.col("inside"), -F.coalesce("used", F.lit(0))).otherwise(0)
    return rows.select("word", score.cast("bigint").alias("score"))


def proportional_weights(counts: DataFrame, used: DataFrame, ratio: float) -> DataFrame:
    """Draw weights that keep each word at no more than ``ratio`` times its share.

    ``counts (word, n)`` are target frequencies, ``used (word, used)`` the draws so far,
    updated once per batch of draws.
    """
    if not 1.0 < ratio < 2.0:
        raise ValueError("ratio must lie between 1 and 2")
    both = counts.join(used, "word", "left").na.fill(0, ["used"])
    total = counts.agg(F.sum("n")).scalar()
    drawn = F.coalesce(used.join(counts, "word", "left_semi").agg(F.sum("used")).scalar(), F.lit(0))
    f, c = F.col("n"), F.col("used")
    below = total - ratio * f
    raw = F.when(below != 0, (ratio * drawn * f - total * c) / below).otherwise(0.0)
    # Before the first draw every weight would be 0: plain frequencies are used.
    weight = F.when(drawn == 0, f.cast("double")).otherwise(F.greatest(raw, F.lit(0.0)))
    return both.select("word", "n", "used", weight.alias("weight"))


def early_stop(losses: DataFrame, improvement: float) -> DataFrame:
    """First step per run with more than 10 losses so far where the loss no longer beats the
    mean of the nine before it by the wanted share. ``losses``: ``run``, ``step``, ``loss``."""
    w = W.partitionBy("run").orderBy("step")
    marked = losses.select(
        "run", "step", "loss",
        F.row_number().over(w).alias("seen"),
        F.avg("loss").over(w.rowsBetween(-9, -1)).alias("before"),
    )
    stop = (F.col("seen") > 10) & (F.col("loss") * (1 + improvement) > F.col("before"))
    return marked.groupBy("run").agg(
        F.min(F.when(stop, F.col("step"))).alias("stop_step"), F.max("step").alias("last_step")
    )


def rate_schedule(series: DataFrame, eta: float) -> DataFrame:
    """Rates per step: ``eta / i^0.1``, and ``eta`` shrunk by 0.8 at every drop of the
    validation accuracy that is not a new best. ``series``: ``run``, ``step``, ``accuracy``."""
    w = W.partitionBy("run").orderBy("step")
    before = w.rowsBetween(W.unboundedPreceding, -1)
    marked = series.select(
        "run", "step", "accuracy",
        F.row_number().over(w).alias("i"),
        F.max("accuracy").over(before).alias("best"),
        F.lag("accuracy").over(w).alias("prev"),
    )
    drop = (F.col("accuracy") <= F.col("best")) & (F.col("prev") > F.col("accuracy"))
    drops = F.sum(F.when(drop, 1).otherwise(0)).over(w)
    return marked.select(
        "run", "step",
        (F.lit(eta) / F.pow(F.col("i"), F.lit(0.1))).alias("decayed"),
        (F.lit(eta) * F.pow(F.lit(0.8), drops)).alias("shrunk"),
    )


def skip_warmup(series: DataFrame, n: int = 5) -> DataFrame:
    return series.where(F.col("step") >= n)
