"""The corpus pipeline over `documents`: stages in order, each a function of one operator.

Every stage works on all rows that the one before it kept, and all but the last return the columns
of `documents`. `n_chars` follows the text where a stage changes it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqlab.llm import byte_bpe, line_dedup, mixing, quality, signature_tree
from seqlab.llm.lz_dedup import numbered
from seqlab.llm.queries import KEEP, TARGETS, labelled_languages, quality_model, table
from seqlab.session import written


def _packed(docs: DataFrame) -> DataFrame:
    """doc_id, text and the columns beside the text as one, so that no name clashes with those of an operator."""
    return docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row"))


def _unpacked(rows: DataFrame, docs: DataFrame, **changed: Column) -> DataFrame:
    own = {"text": F.col("text"), **changed}
    return rows.select(*[(own[c] if c in own else F.col("row").getField(c)).alias(c) for c in docs.columns])


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: documents whose quality score is below ``KEEP`` go.

    Null and empty texts get the vote for a text without terms, each row its own score, rows without an id
    like others; other columns are carried along whatever their names; an empty table gives an empty one.
    """
    scored = quality.score(_packed(docs), quality_model(spark, docs, sf_dir))
    return _unpacked(scored.where(F.col("score") >= KEEP), docs)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: later occurrences of repeated three-line windows are cut from the texts.

    No row goes. A null text stays null; rows of one id count one after another, a row without an id is kept
    whole; other columns are carried along whatever their names; an empty table gives an empty one.
    """
    cut = line_dedup.dedup(_packed(docs))
    changed = {}
    if "n_chars" in docs.columns:
        length = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("row").getField("n_chars"))
        changed["n_chars"] = length.cast(docs.schema["n_chars"].dataType)
    return _unpacked(cut, docs, **changed)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: of each component of near duplicates the document that names it stays.

    Of several rows of that document the first in the order of texts stays; rows without an id
    are in no group and stay, and null and empty texts link with nothing. Other columns are carried along whatever
    their names; an empty table gives an empty one.
    """
    found = signature_tree.similar(docs, n_words=5, percent=80)
    named = found.where("doc_id = component_id").select("doc_id").distinct()
    kept = numbered(_packed(docs).join(named, "doc_id", "left_semi"), "row").where("copy = 1")
    return _unpacked(kept, docs).union(docs.where("doc_id IS NULL"))


def mix_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: rows are left out or repeated by the rate that brings languages to ``TARGETS``.

    Null and empty texts have no tokens and go by the prior; rows without an id share one rate, repeated rows the
    rate of their id; other columns are carried along whatever their names; an empty table gives an empty one.
    """
    labelled = labelled_languages(docs, table(spark, sf_dir, "labels"))
    return mixing.apply_rates(docs, mixing.mix(docs, labelled, TARGETS))


def encode_and_decode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: byte-level BPE ids of every text, and the digest of what they decode to.

    One row for each row; a null text is encoded as the empty one, a null id stays null, other columns are left
    out; an empty table gives an empty one.
    """
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.round_trip(docs, ranks, public_tokenizers.PATTERN)


STAGES = [
    ("quality classifier", keep_good),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", keep_one_of_each_group),
    ("mixing sources to target weights", mix_languages),
    ("byte-level BPE encoding and decoding", encode_and_decode),
]

#: The classifier and the encoder have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result is written and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
