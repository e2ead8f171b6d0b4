"""Streaming forms of the corpus iterators: files in, tables out, ended when all is read.

Every sink is a folder per micro-batch written by ``foreachBatch`` with overwrite, so a batch
that runs again after a failure replaces itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream_table(spark: SparkSession, folder: str, name: str, max_files: int | None = None) -> DataFrame:
    """A table's parquet files as a stream: those in its folder, or the one file it is."""
    path = f"{folder}/{name}.parquet"
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if _is_folder(spark, path):
        return reader.parquet(path)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def _is_folder(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    return place.getFileSystem(conf).getFileStatus(place).isDirectory()


def drain(stream: DataFrame, mode: str, write: Callable[[DataFrame, int], None], out: str) -> None:
    """Run a stream over everything that is there, then stop.

    The checkpoint lies in ``out``, in a folder that table readers pass over, so a later run on
    the same ``out`` takes up where this one ended.
    """
    query = (
        stream.writeStream.outputMode(mode)
        .foreachBatch(write)
        .option("checkpointLocation", f"{out}/_checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def running_vocab(tokens: DataFrame, out: str) -> DataFrame:
    """Word counts kept up to date. Each batch writes only the words it changed; a reader
    takes the newest count of each word."""
    counts = tokens.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    drain(counts, "update", lambda df, batch: df.write.mode("overwrite").parquet(f"{out}/batch={batch}"), out)
    rows = tokens.sparkSession.read.schema("word string, n bigint, batch bigint").parquet(out)
    return rows.groupBy("word").agg(F.max_by("n", "batch").alias("n"))


def unique_words(tokens: DataFrame, out: str) -> DataFrame:
    """Words at their first appearance. The state grows with the vocabulary: there is no event
    time that could end it."""
    fresh = tokens.select("word").dropDuplicates(["word"])
    drain(fresh, "append", lambda df, batch: df.write.mode("overwrite").parquet(f"{out}/batch={batch}"), out)
    return tokens.sparkSession.read.schema("word string, batch bigint").parquet(out)


def label_append(sentences: DataFrame, label: Callable[[DataFrame], DataFrame], out: str) -> DataFrame:
    """Label each micro-batch and append the training rows under its batch id."""
    drain(sentences, "append", lambda df, batch: label(df).write.mode("overwrite").parquet(f"{out}/batch={batch}"), out)
    return sentences.sparkSession.read.parquet(out)
