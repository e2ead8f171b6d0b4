"""Readers and writers of the text formats: column files, tagged documents, word tables, run logs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqlab.sources.column_tags import ColumnTags

# Fixed values of the log format.
DONE_MARKER = "Labels Only Experiment Done"
LOG_HEADERS = [
    "norm percent from loss",
    "unique_words_amounts",
    "Single word queries amounts",
    "accuracies",
    "l2 distances",
    "w l2 norm",
    "validation KL",
]
RUN_NAME = r"words(\d+)_l2_weight([^_]+).*lossimpr([^_]+).*0_(.+)\.txt"


def _tokens(spark: SparkSession, path: str, layout: str) -> DataFrame:
    spark.dataSource.register(ColumnTags)
    return spark.read.format("column_tags").option("layout", layout).load(path)


def read_conll(spark: SparkSession, path: str) -> DataFrame:
    """Tab-column files: word in column 1, tag in column 3, blank lines between sentences.

    A last sentence without a closing blank line is kept, and empty sentences are not made.
    Columns ``file sentence pos word tag``; see :mod:`column_tags`.
    """
    return _tokens(spark, path, "conll")


def read_docs(spark: SparkSession, path: str) -> DataFrame:
    """Tagged documents: units end at a ``-DOCSTART-`` line or a blank line; a line is cut at
    its first tab. Columns ``file sentence pos word tag``, a sentence being a unit."""
    return _tokens(spark, path, "docs")


def sentences(tokens: DataFrame) -> DataFrame:
    """The ``words`` and ``tags`` of each sentence that :func:`read_conll` or :func:`read_docs` gives, joined by blanks.

    The reader hands out whole sentences, token by token, so they are put together where they were read.
    """

    def joined(table: pa.Table, starts: np.ndarray, column: str) -> pa.Array:
        texts = table[column].combine_chunks()
        known = texts.is_valid().to_numpy(zero_copy_only=False)
        offsets = np.concatenate([[0], np.cumsum(known)])[np.append(starts, len(texts))]
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), texts.drop_null())
        return pc.binary_join(lists, " ")

    def put(table: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([joined(table, starts, c) for c in ("word", "tag")], ["words", "tags"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # the tokens of the last sentence, which may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            files, places = batch["file"].dictionary_encode().indices.to_numpy(), batch["sentence"].to_numpy()
            new = np.flatnonzero((np.diff(places) != 0) | (np.diff(files) != 0)) + 1
            first = (batch["file"][0].as_py(), int(places[0]))
            if held and (held[-1]["file"][-1].as_py(), held[-1]["sentence"][-1].as_py()) != first:
                yield put(pa.Table.from_batches(held), np.zeros(1, np.int64))
                held = []
            if len(new):
                last = int(new[-1])
                before = sum(b.num_rows for b in held)
                table = pa.Table.from_batches([*held, batch.slice(0, last)])
                yield put(table, np.concatenate([[0], new[:-1] + before]))
                held = []
                batch = batch.slice(last)
            held.append(batch)
        if held:
            yield put(pa.Table.from_batches(held), np.zeros(1, np.int64))

    return tokens.select("file", "sentence", "word", "tag").mapInArrow(read, "words string, tags string")


def write_conll(sentences: DataFrame, path: str) -> None:
    line = F.transform(
        F.arrays_zip("words", "tags"),
        lambda t, i: F.concat_ws("\t", (i + 1).cast("string"), t["words"], F.lit("_"), t["tags"]),
    )
    sentences.select(F.array_join(line, "\n").alias("value")).write.option("lineSep", "\n\n").text(path)


def write_docs(sentences: DataFrame, path: str) -> None:
    """One ``-DOCSTART-`` unit per sentence."""
    line = F.transform(F.arrays_zip("words", "tags"), lambda t: F.concat_ws("\t", t["words"], t["tags"]))
    start = F.concat(F.lit("-DOCSTART- "), F.concat_ws(" ", F.col("src_id").cast("string"), F.col("seg").cast("string")))
    sentences.select(F.concat_ws("\n", start, F.array_join(line, "\n")).alias("value")).write.text(path)


def read_vocab_table(spark: SparkSession, path: str) -> DataFrame:
    """Blank-separated ``word count freq`` lines without a header."""
    cols = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where("trim(value) <> ''").select(
        cols[0].alias("word"), cols[1].cast("bigint").alias("n"), cols[2].cast("double").alias("freq")
    )


def write_vocab_table(vocab: DataFrame, path: str) -> None:
    line = F.concat_ws(" ", "word", F.col("n").cast("string"), F.format_string("%.12f", "freq"))
    vocab.select(line.alias("value")).write.text(path)


def write_run_logs(series: DataFrame, path: str, marker: str = DONE_MARKER) -> None:
    """``series``: ``run``, ``metric``, ``values array<double>``, ``stale``, ``done``. One folder
    per run; a stale block of the same header comes before the final one."""
    block = F.concat_ws(
        "\n", "metric", F.col("stale").cast("string"), F.lit("training"), "metric",
        F.concat(F.lit("["), F.array_join(F.transform("values", lambda v: v.cast("string")), ", "), F.lit("]")),
    )
    runs = series.groupBy("run").agg(
        F.array_join(F.sort_array(F.collect_list(block)), "\n").alias("body"), F.max("done").alias("done")
    )
    end = F.when(F.col("done"), marker).otherwise("interrupted")
    text = runs.select("run", F.concat_ws("\n", "body", end).alias("value"))
    text.repartition("run").write.partitionBy("run").text(path)


def parse_run_logs(
    spark: SparkSession, path: str, headers: list[str] | None = None, marker: str = DONE_MARKER
) -> DataFrame:
    """Long metrics of finished runs: after each header's last occurrence comes its list."""
    names = F.array(*[F.lit(h) for h in headers or LOG_HEADERS])
    files = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True)
    done = files.where(F.col("value").contains(marker)).select(
        F.col("_metadata.file_path").alias("file"), F.split("value", "\r?\n").alias("lines")
    )
    each = done.select("file", "lines", F.explode(names).alias("metric"))
    last = F.size("lines") - F.array_position(F.reverse("lines"), F.col("metric")) + 1
    found = each.where(F.array_contains("lines", F.col("metric"))).select(
        "file", "metric", F.get(F.col("lines"), last.cast("int")).alias("list")
    )
    values = F.from_json("list", "array<double>")
    return found.select("file", "metric", F.posexplode(values).alias("step", "value"))


def parse_run_name(names: DataFrame, column: str) -> DataFrame:
    """Words, l2, improvement and method out of a run's file name, and its short title."""
    part = [F.regexp_extract(column, ".*" + RUN_NAME, i) for i in range(1, 5)]
    return names.select(
        column, part[0].alias("words"), part[1].alias("l2"), part[2].alias("improvement"), part[3].alias("method"),
        F.format_string("%s,impr=%s,reg=%s", part[3], part[2], part[1]).alias("title"),
    )
