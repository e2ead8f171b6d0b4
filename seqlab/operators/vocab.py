"""Vocabularies, rare-word classes, and corpora rewritten with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqlab.functions.text import ascii_lower, word_class
from seqlab.operators import packed
from seqlab.operators.scale import MAX_HEAVY, lookup, number_rows, union_all
from seqlab.session import written
from seqlab.sources.corpora import KEY, TOKEN


def vocab_count(tokens: DataFrame) -> DataFrame:
    return tokens.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def word_tag_marginals(tokens: DataFrame) -> DataFrame:
    """Counts per word and per tag from one pass over the tokens."""
    pairs = word_tag_counts(tokens)
    sets = pairs.groupingSets([["word"], ["tag"]], "word", "tag")
    both = sets.agg(F.sum("n").alias("n"), F.grouping("word").alias("g"))
    kind = F.when(F.col("g") == 0, "word").otherwise("tag")
    return both.select(kind.alias("kind"), F.coalesce("word", "tag").alias("key"), "n")


def word_tag_counts(tokens: DataFrame) -> DataFrame:
    return tokens.groupBy("word", "tag").agg(F.count(F.lit(1)).alias("n"))


def word_norms(
    tokens: DataFrame, min_freq: int, in_vocab: Column | None = None
) -> DataFrame:
    """What each distinct word becomes, first and later in a sentence.

    Counts are taken over rows where ``in_vocab`` holds (the train split unless given).
    The class rules and the look-up of lower forms run once per distinct word, not per token.
    """
    counted = F.col("split") == "train" if in_vocab is None else in_vocab
    words = tokens.groupBy("word").agg(
        F.count(F.lit(1)).alias("total"), F.count(F.when(counted, 1)).alias("n")
    )
    return _norms(words, F.col("n") >= min_freq, words.where(F.col("n") >= min_freq))


def allowlist_norms(tokens: DataFrame, allowed: DataFrame) -> DataFrame:
    """As :func:`word_norms`, keeping exactly the words of ``allowed (word)``."""
    words = tokens.groupBy("word").agg(F.count(F.lit(1)).alias("total"))
    marked = words.join(allowed.select("word", F.lit(1).alias("n")), "word", "left")
    return _norms(marked.na.fill(0, ["n"]), F.col("n") >= 1, allowed)


def _norms(words: DataFrame, keep: Column, frequent: DataFrame) -> DataFrame:
    kept = frequent.select(F.col("word").alias("lower"), F.lit(True).alias("found"))
    forms = words.withColumn("keep", keep).withColumn("lower", ascii_lower(F.col("word")))
    found = F.coalesce("found", F.lit(False))
    word = F.col("word")
    return forms.join(kept, "lower", "left").select(
        "word",
        "total",
        "n",
        "keep",
        F.when(F.col("keep"), word).otherwise(word_class(word, F.lit(True), found)).alias("as_first"),
        F.when(F.col("keep"), word).otherwise(word_class(word, F.lit(False), found)).alias("as_later"),
    )


def preprocess(tokens: DataFrame, norms: DataFrame) -> DataFrame:
    """Replace rare words; the original stays in ``orig``, ``replaced`` tells which changed.

    Words that make up 1/100,000 of the tokens or more, of which there can be no more than 100,000
    and which most tokens are, find their norm in a broadcast table; only the others are shuffled.
    The tokens are read twice for it.
    """
    norms = written(norms, "norms")
    total = norms.agg(F.sum("total")).scalar()
    wide = norms.select("word", "keep", "as_first", "as_later", (F.col("total") * MAX_HEAVY >= total).alias("common"))
    common = F.broadcast(wide.where("common").drop("common"))
    unknown = [F.lit(None).cast(norms.schema[c].dataType).alias(c) for c in ("keep", "as_first", "as_later")]
    others = tokens.where("word IS NOT NULL").join(common.select("word"), "word", "left_anti").select(tokens.columns)
    found = union_all([
        tokens.join(common, "word").select(*tokens.columns, "keep", "as_first", "as_later"),
        lookup(others, wide.where("NOT common").drop("common"), ["word"]),
        tokens.where("word IS NULL").select(*tokens.columns, *unknown),
    ])
    new = F.when(F.col("pos") == 0, F.col("as_first")).otherwise(F.col("as_later"))
    return found.select(
        *TOKEN, F.col("word").alias("orig"), new.alias("word"), "tag", "split",
        (~F.col("keep")).alias("replaced"),
    )


def top_words(tokens: DataFrame, n: int) -> DataFrame:
    """The ``n`` commonest words, alphabetical on ties."""
    return vocab_count(tokens).orderBy(F.desc("n"), "word").limit(n)


def vocab_ids(words: DataFrame, column: str = "word") -> DataFrame:
    """Distinct values numbered from 0 in sorted order, without one task sorting them all."""
    return number_rows(words.select(column).distinct(), [], [column], None, "id")


def with_specials(words: DataFrame) -> DataFrame:
    extra = words.sparkSession.sql("SELECT explode(array('<s>', '</s>')) AS word")
    return vocab_ids(words.select("word").union(extra))


def outside(words: DataFrame, allowed: DataFrame) -> DataFrame:
    """Distinct words that are not in the allow-list."""
    return words.select("word").subtract(allowed.select("word"))


def invert_mapping(mapping: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """Swap key and value; of several keys with one value the last in ``order`` stays."""
    return mapping.groupBy(value).agg(F.max_by(key, order).alias(key))


def align(left: DataFrame, right: DataFrame) -> DataFrame:
    """Positional pairing of two versions of a corpus, whose tokens move packed. ``missing`` marks unpaired tokens."""
    a = left.select(*TOKEN, F.col("word").alias("a_word"), F.col("tag").alias("a_tag"))
    b = right.select(*TOKEN, F.col("word").alias("b_word"), F.col("tag").alias("b_tag"))
    missing = F.col("a_tag").isNull() | F.col("b_tag").isNull()
    return packed.paired(a, b, TOKEN).withColumn("missing", missing)


def contents(sentences: DataFrame) -> DataFrame:
    """Distinct sentence texts with their number of copies: a bag without its duplicates' rows."""
    text = F.array_join("words", " ").alias("sentence")
    return sentences.groupBy(text).agg(F.count(F.lit(1)).alias("copies"))


def sentences_not_in(pool: DataFrame, other: DataFrame) -> DataFrame:
    """Sentences of ``pool`` whose content is not in ``other``; all copies go.

    Both sides are reduced to distinct contents before they meet, so copies never pile up
    on one join key.
    """
    return contents(pool).join(contents(other), "sentence", "left_anti")


def allowed_windows(sentences: DataFrame, allowed: DataFrame) -> DataFrame:
    """Per sentence, the positions whose word, two predecessors and successor are all allowed.

    Each token is looked up once and then votes in the windows it belongs to; positions
    beyond the ends of the sentence count as allowed.
    """
    rows = sentences.select(*KEY, F.size("words").alias("len"), F.posexplode("words").alias("pos", "word"))
    marked = lookup(rows, allowed.select("word", F.lit(1).alias("ok")), ["word"])
    at = F.explode(F.array(*[F.col("pos") + d for d in (-1, 0, 1, 2)])).alias("pos")
    votes = marked.select(*KEY, "len", F.coalesce("ok", F.lit(0)).alias("ok"), at)
    inside = votes.where((F.col("pos") >= 0) & (F.col("pos") < F.col("len")))
    windows = inside.groupBy(*TOKEN).agg(F.min("ok").alias("ok"))
    return windows.groupBy(*KEY).agg(F.sum("ok").alias("n_allowed"))
