"""Running totals of a stream of tokens: how many so far, and how many distinct words.

The totals are kept by buckets of words, each with a value state (its totals) and a map state (its words), so
no task holds the vocabulary or the whole count. A micro-batch puts out what it added per bucket; summed
over buckets and added up over micro-batches that gives the totals after each.

The state lies in the checkpoint beside the output: a run on the same folder goes on where the last one
ended, and a micro-batch that runs again after a failure replaces its rows. Tokens count in the
micro-batch that brings them, whenever they were due: a late batch changes no earlier total.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from seqlab.operators.scale import running_sum
from seqlab.streaming.jobs import drain

BUCKETS = 64
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class WordTotals(StatefulProcessor):
    """Totals of one bucket of words; gives what each micro-batch adds to them."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.totals = handle.getValueState("totals", "tokens long, words long")
        self.seen = handle.getMapState("seen", "word string", "tokens long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        counts: dict[str, int] = {}
        for pdf in rows:
            for word, n in zip(pdf["word"], pdf["n"], strict=True):
                counts[word] = counts.get(word, 0) + int(n)
        fresh = 0
        for word, n in counts.items():
            known = (word,)
            before = self.seen.getValue(known)[0] if self.seen.containsKey(known) else 0
            fresh += before == 0
            self.seen.updateValue(known, (before + n,))
        tokens, words = self.totals.get() if self.totals.exists() else (0, 0)
        added = sum(counts.values())
        self.totals.update((tokens + added, words + fresh))
        yield pd.DataFrame(
            {
                "bucket": [key[0]], "new_tokens": [added], "new_words": [fresh],
                "tokens": [tokens + added], "words": [words + fresh],
            }
        )

    def close(self) -> None:
        pass


SCHEMA = "bucket int, new_tokens long, new_words long, tokens long, words long"


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Words of a batch of rows once each with their number, so that a hot word sends few rows."""
    for pdf in batches:
        n = pdf["word"].value_counts()
        yield pd.DataFrame({"word": n.index.astype(str), "n": n.to_numpy()})


@contextmanager
def _state_on_disk(spark: SparkSession):
    """State with columns needs the store on disk; the session gets its own setting back."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


def add_totals(tokens: DataFrame, out: str) -> None:
    """Run a stream of tokens (``word``) over all that is there; null words are passed over."""
    spark = tokens.sparkSession
    counted = tokens.where("word IS NOT NULL").select("word").mapInPandas(_counted, "word string, n long")
    keyed = counted.withColumn("bucket", F.pmod(F.xxhash64("word"), F.lit(BUCKETS)).cast("int"))
    with _state_on_disk(spark):
        added = keyed.groupBy("bucket").transformWithStateInPandas(
            statefulProcessor=WordTotals(), outputStructType=SCHEMA, outputMode="Append", timeMode="None"
        )
        drain(added, "append", lambda df, batch: df.write.mode("overwrite").parquet(f"{out}/batch={batch}"), out)


def totals(spark: SparkSession, out: str) -> DataFrame:
    """(batch, n_tokens, n_words) after each micro-batch that brought tokens."""
    rows = spark.read.schema(f"{SCHEMA}, batch long").parquet(out)
    each = rows.groupBy("batch").agg(F.sum("new_tokens").alias("new_tokens"), F.sum("new_words").alias("new_words"))
    summed = running_sum(each, [], ["batch"], None, F.col("new_tokens"), "n_tokens")
    summed = running_sum(summed, [], ["batch"], None, F.col("new_words"), "n_words")
    return summed.select("batch", "n_tokens", "n_words")
