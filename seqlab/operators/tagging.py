"""The most-frequent-tag model and accuracy reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqlab.operators.scale import checked_small, lookup
from seqlab.operators.vocab import word_tag_counts

MAX_TAGS = 1000


def tag_list(tokens: DataFrame) -> list[str]:
    """The tag set in alphabetical order; a tag's index is its class id."""
    rows = checked_small(tokens.select("tag").distinct(), MAX_TAGS, "tags")
    return sorted(r.tag for r in rows)


def tag_dim(tokens: DataFrame) -> DataFrame:
    tags = tag_list(tokens)
    lits = F.array(*[F.struct(F.lit(i).alias("class_id"), F.lit(t).alias("tag")) for i, t in enumerate(tags)])
    return tokens.sparkSession.range(1).select(F.inline(lits))


def encode_tags(tokens: DataFrame, tags: list[str], column: str = "tag") -> DataFrame:
    """Add ``class_id``; a tag outside the set is an error."""
    at = F.array_position(F.array(*[F.lit(t) for t in tags]), F.col(column)) - 1
    unknown = F.raise_error(F.concat(F.lit("unknown tag: "), F.col(column)))
    return tokens.withColumn("class_id", F.when(at >= 0, at.cast("int")).otherwise(unknown.cast("int")))


def decode_tags(tokens: DataFrame, tags: list[str], column: str, out: str) -> DataFrame:
    return tokens.withColumn(out, F.element_at(F.array(*[F.lit(t) for t in tags]), F.col(column) + 1))


def most_frequent_tag(tokens: DataFrame) -> DataFrame:
    """Commonest tag per word, the smallest tag on ties."""
    best = F.min_by("tag", F.struct(-F.col("n"), F.col("tag"))).alias("pred")
    return word_tag_counts(tokens).groupBy("word").agg(best)


def predict_by_lookup(tokens: DataFrame, model: DataFrame) -> DataFrame:
    """Add ``pred``; words the model has not seen get null."""
    return lookup(tokens, model.select("word", "pred"), ["word"])


def accuracy(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Share of rows with ``pred = tag``; unseen words count as wrong and are reported."""
    hit = F.coalesce(F.col("pred") == F.col("tag"), F.lit(False)).cast("double")
    return rows.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("n_tokens"),
        F.count(F.when(F.col("pred").isNull(), 1)).alias("n_unseen"),
        F.avg(hit).alias("accuracy"),
    )


def tag_ambiguity(tokens: DataFrame) -> DataFrame:
    """Mean number of possible tags, weighted by word counts."""
    words = word_tag_counts(tokens).groupBy("word").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("k")
    )
    return words.agg((F.sum(F.col("n") * F.col("k")) / F.sum("n")).alias("ambiguity"))
