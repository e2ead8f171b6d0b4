"""Corpora in one schema from documents, event logs and conversations.

Sentences are packed, one row each: ``src_id bigint, seg int, split string,
words array<string>, tags array<string>``. Tokens are the exploded form with ``pos``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqlab.functions.text import split_of
from seqlab.operators.scale import number_rows
from seqlab.session import cut_scan, written

KEY = ["src_id", "seg"]
TOKEN = ["src_id", "seg", "pos"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_sentences(text: Column) -> Column:
    """Sentence strings of a text: cut at blanks after ``.``, ``!`` or ``?`` and at newlines."""
    return F.split(text, "(?<=[.!?])[ \t]+\n*|\n+")


def words_of(sentence: Column) -> Column:
    """Punctuation marks and the runs between blanks and marks, in one pass."""
    return F.regexp_extract_all(sentence, F.lit("[.,!?;:]|[^ \t\r.,!?;:]+"), F.lit(0))


#: Bytes of text in a piece whose grams one task counts: some 25 times as much in the rows of its hash table.
PIECE = 8 << 20


def document_sentences(
    docs: DataFrame, keep_empty: bool = False, pieces: int | None = None, numbered: bool = False
) -> DataFrame:
    """Sentences of whole documents; the tag of every token is the language of its document.

    With ``pieces`` the documents are dealt to as many tasks, however the scan is cut; with ``numbered`` each
    sentence then carries its ``piece``."""
    docs = docs.select("doc_id", "text", "lang")
    number = []
    if numbered:
        piece = F.pmod(F.xxhash64("doc_id", "text"), F.lit(pieces)).cast("int")
        dealt, number = docs.withColumn("piece", piece).repartition(pieces, "piece"), ["piece"]
    else:
        dealt = cut_scan(docs, "doc_id") if pieces is None else docs.repartition(pieces, F.xxhash64("doc_id", "text"))
    lines = dealt.select(
        *number,
        F.col("doc_id").alias("src_id"),
        split_of(F.col("doc_id")).alias("split"),
        F.col("lang"),
        F.posexplode(raw_sentences(F.col("text"))).alias("seg", "line"),
    )
    if not keep_empty:
        # The same as an empty word list, told without taking the words out twice.
        lines = lines.where(F.col("line").rlike("[^ \t\r]"))
    packed = lines.select(
        *number, "src_id", "seg", "split", "lang", words_of(F.col("line")).alias("words")
    )
    tags = F.array_repeat(F.col("lang"), F.size("words"))
    return packed.select(*KEY, "split", "words", tags.alias("tags"), *number)


def benchmark_sentences(items: DataFrame) -> DataFrame:
    return document_sentences(
        items.select(F.col("item_id").alias("doc_id"), "text", F.lit("benchmark").alias("lang"))
    )


def not_empty() -> Column:
    return F.size("words") > 0


def drop_empty(sentences: DataFrame) -> DataFrame:
    return sentences.where(not_empty())


def event_tokens(events: DataFrame) -> DataFrame:
    """Event log as tagged sequences: one per user and calendar day, ordered by time."""
    rows = cut_scan(events, "user_id").select(
        F.col("user_id").alias("src_id"),
        F.datediff(F.to_date("ts"), F.lit("1970-01-01").cast("date")).alias("seg"),
        "ts",
        "event_id",
        F.get_json_object("props", "$.k").alias("word"),
        F.col("event_type").alias("tag"),
    )
    minute = F.substring(F.col("ts").cast("string"), 1, 16)
    numbered = number_rows(rows, KEY, ["ts", "event_id"], minute, "n")
    return numbered.select(
        *KEY, F.col("n").cast("int").alias("pos"), "word", "tag", split_of(F.col("src_id")).alias("split")
    )


def conversation_tokens(conversations: DataFrame) -> DataFrame:
    """All words of all turns, tagged with the role; a turn is a sentence of its conversation."""
    turns = conversations.select(
        F.col("conv_id").alias("src_id"),
        F.col("turn").cast("int").alias("seg"),
        F.col("role").alias("tag"),
        F.posexplode(words_of(F.translate("text", "\n", " "))).alias("pos", "word"),
    )
    return turns.select(*TOKEN, "word", "tag", split_of(F.col("src_id")).alias("split"))


def pack(tokens: DataFrame, **arrays: str) -> DataFrame:
    """Tokens to sentences. Extra arrays are named as ``array=column``."""
    arrays = {"words": "word", "tags": "tag", **arrays}
    row = F.struct("pos", *[F.col(c).alias(a) for a, c in arrays.items()])
    grouped = tokens.groupBy(*KEY, "split").agg(F.array_sort(F.collect_list(row)).alias("row"))
    return grouped.select(*KEY, "split", *[F.col(f"row.{a}").alias(a) for a in arrays])


def tokens(sentences: DataFrame) -> DataFrame:
    each = sentences.select(*KEY, "split", "tags", F.posexplode("words").alias("pos", "word"))
    return each.select(*KEY, "pos", "word", F.get("tags", F.col("pos")).alias("tag"), "split")


def tok(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_sentences(table(spark, sf_dir, "documents"))


def tok_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As :func:`tok`, in pieces of about ``PIECE`` bytes of text, for counts by task of nearly distinct keys.

    A scan gives a task 128 MB of a compressed file, whose grams do not fit its memory: its counts would go
    to disk and be sorted there. Small tables stay as they come.
    """
    docs = table(spark, sf_dir, "documents")
    pieces = _pieces(docs, PIECE)
    return document_sentences(docs, pieces=pieces if pieces > 1 else None)


def tok_numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As :func:`tok`, each sentence with the number of its ``piece`` of about twice ``PIECE`` bytes of text."""
    docs = table(spark, sf_dir, "documents")
    return document_sentences(docs, pieces=_pieces(docs, 2 * PIECE), numbered=True)


def _pieces(docs: DataFrame, size: int) -> int:
    """How many pieces of ``size`` bytes the texts fill; where they fill several, at least one for each core."""
    spark = docs.sparkSession
    pieces = -(-(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // size)
    given = int(spark.conf.get("seqlab.scan.partitions", None) or spark.sparkContext.defaultParallelism)
    return max(pieces, given) if pieces > 1 else 1


def seq_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event sequences, numbered once and written for the several jobs that read them."""
    return written(event_tokens(table(spark, sf_dir, "events")), "sequences")


def seq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(seq_tokens(spark, sf_dir))
