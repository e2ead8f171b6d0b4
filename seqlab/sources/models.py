"""Parquet stores for models, feature vocabularies and metrics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqlab.operators.features import feature_vocab
from seqlab.operators.linear import LinearModel, long_weights, packed_weights
from seqlab.operators.scale import checked_small
from seqlab.operators.tagging import MAX_TAGS
from seqlab.sources import committed


def save_model(model: LinearModel, path: str) -> None:
    spark = model.weights.sparkSession
    long_weights(model).write.mode("overwrite").parquet(f"{path}/weights")
    rows = [(i, t, b) for i, (t, b) in enumerate(zip(model.tags, model.bias))]
    spark.createDataFrame(rows, "class_id int, tag string, b double").coalesce(1).write.mode("overwrite").parquet(f"{path}/bias")


def load_model(spark: SparkSession, path: str) -> LinearModel:
    """Read a model back; weights and bias must speak of the same classes."""
    weights = spark.read.parquet(f"{path}/weights")
    bias = sorted(checked_small(spark.read.parquet(f"{path}/bias"), MAX_TAGS, "classes"), key=lambda r: r.class_id)
    known = {r.class_id for r in bias}
    used = {r.class_id for r in checked_small(weights.select("class_id").distinct(), MAX_TAGS, "classes")}
    if used != known or known != set(range(len(bias))):
        raise ValueError(f"weights have classes {sorted(used)}, bias has {sorted(known)}")
    return LinearModel([r.tag for r in bias], packed_weights(weights, len(bias)), [r.b for r in bias])


def feature_vocab_cache(
    spark: SparkSession, path: str, min_freq: int, rows: Callable[[], DataFrame]
) -> DataFrame:
    """The feature vocabulary of one minimum frequency, fitted and written only if absent."""
    part = f"{path}/min_freq={min_freq}"
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(part)
    present = jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jvm_path)
    if not present:
        feature_vocab(rows()).write.parquet(part)
    return spark.read.parquet(path).where(F.col("min_freq") == min_freq)


def append_metrics(metrics: DataFrame, path: str, batch: str) -> None:
    """Add ``run, metric, step, value`` rows to the long metrics store under the name of their batch.
    A batch that is there already, as when a round runs again, is not added twice."""
    rows = metrics.select("run", "metric", F.col("step").cast("bigint").alias("step"), F.col("value").cast("double").alias("value"))
    committed.append(rows, path, batch)


def long_metrics(row: DataFrame, run: str, step: int) -> DataFrame:
    """One summary row to long form."""
    pairs = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in row.columns])
    return row.select(F.lit(run).alias("run"), F.lit(step).cast("bigint").alias("step"), F.inline(pairs))
