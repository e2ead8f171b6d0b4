"""Context features of tokens, their vocabulary, and sparse rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqlab.functions.text import FLAG_NAMES, ascii_lower, feature_array, feature_cells, feature_count, feature_family
from seqlab.operators.scale import lookup, number_rows
from seqlab.sources.corpora import KEY, TOKEN

BEGIN_WORD = "<s>"
END_WORD = "</s>"
BEGIN_TAG = "*"


def _shifted(column: str, by: int, pad: str) -> Column:
    """The array moved right by ``by`` places (left when negative), padded, same length."""
    n = F.size(column)
    if by > 0:
        return F.slice(F.concat(F.array_repeat(F.lit(pad), by), column), F.lit(1), n)
    return F.slice(F.concat(column, F.array_repeat(F.lit(pad), -by)), F.lit(1 - by), n)


def context_rows(sentences: DataFrame) -> DataFrame:
    """Tokens with previous and next words and previous tags. Neighbours come from the packed
    sentence, so there is no window and no shuffle."""
    # The words of a sentence are lowered together: one call instead of one per feature.
    lowered = F.split(ascii_lower(F.array_join("words", "\u0001")), "\u0001")
    z = sentences.select(
        *KEY,
        "split",
        F.col("words").alias("word"),
        lowered.alias("lowered"),
        F.col("tags").alias("tag"),
        _shifted("words", -1, END_WORD).alias("next_word"),
        _shifted("words", 1, BEGIN_WORD).alias("prev_word"),
        _shifted("words", 2, BEGIN_WORD).alias("prevprev_word"),
        _shifted("tags", 1, BEGIN_TAG).alias("prev_tag"),
        _shifted("tags", 2, BEGIN_TAG).alias("prevprev_tag"),
    )
    fields = ["word", "tag", "lowered", "next_word", "prev_word", "prevprev_word", "prev_tag", "prevprev_tag"]
    rows = z.select(*KEY, "split", F.posexplode(F.arrays_zip(*fields)).alias("pos", "t"))
    return rows.select(*TOKEN, "split", "t.*")


def examples(sentences: DataFrame) -> DataFrame:
    """One row per token: the tag and the array of active feature names."""
    return context_rows(sentences).select(*TOKEN, "split", "word", "tag", feature_array().alias("features"))


def feature_counts(sentences: DataFrame) -> DataFrame:
    """(feature, n): the features of all :func:`examples`, counted.

    A word gives the same names wherever it has the same tags before it and neighbours at the same sides:
    its own, and those that it gives to the token before it and to the two after it. So tokens are counted by
    these first, one row each, and names are made once for each distinct case.
    """
    at, n = F.col("pos"), F.size("words")
    cases = sentences.select("tags", n.alias("n"), F.posexplode("words").alias("pos", "word")).select(
        "word",
        F.when(at < 1, BEGIN_TAG).otherwise(F.get("tags", at - 1)).alias("prev_tag"),
        F.when(at < 2, BEGIN_TAG).otherwise(F.get("tags", at - 2)).alias("prevprev_tag"),
        (at == 0).alias("first"),
        F.least(F.col("n") - 1 - at, F.lit(2)).alias("after"),
    )
    counted = cases.groupBy(*cases.columns).agg(F.count(F.lit(1)).alias("n"))
    word, prev_tag = F.col("word"), F.col("prev_tag")
    before = feature_cells({"prev_word": word, "prevprev_tag": prev_tag})
    first, after = F.col("first"), F.col("after")
    begin = [F.lit(f"prev_word={BEGIN_WORD}"), F.lit(f"prevprev_word={BEGIN_WORD}")]
    own = feature_array({"word": word, "prev_tag": prev_tag, "prevprev_tag": F.col("prevprev_tag"), "lowered": F.col("lowered")})
    given = [
        *[F.when(~first, c) for c in feature_cells({"next_word": word}).values()],
        *[F.when(after >= 1, before[c]) for c in ("prev_word", "prev_is_cap")],
        *[F.when(after >= 2, c) for c in feature_cells({"prevprev_word": word}).values()],
        # The padding of the first token, of the second one, and of the last.
        *[F.when(first, c) for c in begin],
        F.when(first & (after >= 1), begin[1]),
        F.when(after == 0, f"next_word={END_WORD}"),
    ]
    names = F.concat(own, F.array_compact(F.array(*given)))
    each = counted.withColumn("lowered", ascii_lower(word)).select("n", F.explode(names).alias("feature"))
    return each.groupBy("feature").agg(F.sum("n").alias("n"))


def feature_rows(rows: DataFrame) -> DataFrame:
    return rows.select(*TOKEN, "split", "tag", F.explode("features").alias("feature"))


def feature_vocab(rows: DataFrame) -> DataFrame:
    """Distinct feature names with the flag names, numbered from 0 in sorted order."""
    spark = rows.sparkSession
    flags = spark.range(1).select(F.explode(F.array(*[F.lit(f) for f in FLAG_NAMES])).alias("feature"))
    names = rows.select(F.explode("features").alias("feature")).distinct().union(flags).distinct()
    return number_rows(names, [], ["feature"], None, "idx")


def vectorize(rows: DataFrame, vocab: DataFrame) -> DataFrame:
    """Sorted column indices of the active features; unknown features are dropped."""
    each = rows.select(*TOKEN, "split", "tag", F.explode("features").alias("feature"))
    found = lookup(each, vocab.select("feature", "idx"), ["feature"])
    return found.groupBy(*TOKEN, "split", "tag").agg(
        F.array_sort(F.collect_set("idx")).alias("indices")
    )


def family_counts(counts: DataFrame) -> DataFrame:
    """Counts of features (feature, n) by family."""
    return counts.groupBy(feature_family(F.col("feature")).alias("family")).agg(F.sum("n").alias("n"))


def nnz_histogram(sentences: DataFrame) -> DataFrame:
    """How many tokens have how many active features. The names themselves are not made."""
    at = F.col("pos")

    def near(column: str, by: int, pad: str) -> Column:
        outside = at + by < 0 if by < 0 else at + by >= F.size(column)
        return F.when(outside, pad).otherwise(F.get(column, at + by))

    tokens = sentences.select("words", "tags", F.posexplode("words").alias("pos", "word"))
    tokens = tokens.withColumn("lowered", ascii_lower(F.col("word")))
    active = feature_count({
        "word": F.col("word"), "lowered": F.col("lowered"),
        "next_word": near("words", 1, END_WORD),
        "prev_word": near("words", -1, BEGIN_WORD), "prevprev_word": near("words", -2, BEGIN_WORD),
        "prev_tag": near("tags", -1, BEGIN_TAG), "prevprev_tag": near("tags", -2, BEGIN_TAG),
    })
    return tokens.groupBy(active.cast("bigint").alias("nnz")).agg(F.count(F.lit(1)).alias("n_rows"))
