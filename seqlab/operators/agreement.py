"""How near two models are: divergences of predictions and distances of weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqlab.functions.vectors import argmax, square_sum
from seqlab.operators.linear import LinearModel, long_weights
from seqlab.sources.corpora import TOKEN

EPS = 1e-8


def paired(teacher: DataFrame, student: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Rows with ``tp`` and ``sp``, the probability arrays of both models."""
    keys = keep or TOKEN
    left = teacher.withColumnRenamed("p", "tp")
    return left.join(student.select(*keys, F.col("p").alias("sp")), keys)


def _clip(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(EPS)), F.lit(1.0 - EPS))


def kl_cells(pairs: DataFrame) -> Column:
    """Mean over rows and classes of ``|t ln(t / s)|`` with both sides clipped."""
    cell = F.zip_with(
        F.col("tp"), F.col("sp"), lambda t, s: F.abs(_clip(t) * F.ln(_clip(t) / _clip(s)))
    )
    total = F.aggregate(cell, F.lit(0.0), lambda a, x: a + x)
    return F.sum(total) / F.sum(F.size("tp"))


def kl_row(p: str, q: str) -> Column:
    """KL(p || q) of one row, natural log; cells with p = 0 add nothing."""
    cell = F.zip_with(
        F.col(p), F.col(q), lambda a, b: F.when((a > 0) & (b > 0), a * F.ln(a / b)).when(a > 0, float("inf")).otherwise(0.0)
    )
    return F.aggregate(cell, F.lit(0.0), lambda acc, x: acc + x)


def weights_compare(left: LinearModel, right: LinearModel) -> DataFrame:
    """Row-aligned weights of two models; a missing feature weighs 0."""
    a = long_weights(left).withColumnRenamed("w", "w1")
    b = long_weights(right).withColumnRenamed("w", "w2")
    zero = F.lit(0.0)
    return a.join(b, ["feature", "class_id"], "full").select(
        "feature", "class_id", F.coalesce("w1", zero).alias("w1"), F.coalesce("w2", zero).alias("w2")
    )


def weight_stats(compared: DataFrame) -> DataFrame:
    """Sum of squares of both models and the mean over features of the row distance."""
    gap = F.pow(F.col("w1") - F.col("w2"), 2)
    rows = compared.groupBy("feature").agg(
        F.sqrt(F.sum(gap)).alias("d"),
        F.sum(F.col("w1") * F.col("w1")).alias("q1"),
        F.sum(F.col("w2") * F.col("w2")).alias("q2"),
    )
    return rows.agg(
        F.sum("q1").alias("norm_teacher"),
        F.sum("q2").alias("norm_student"),
        F.avg("d").alias("l2_distance"),
        F.count(F.lit(1)).alias("n_features"),
    )


def l2_norm(model: LinearModel) -> DataFrame:
    return model.weights.agg(F.sum(square_sum(F.col("w"))).alias("norm"))


def cross_entropy(rows: DataFrame, model: LinearModel, reg: float) -> DataFrame:
    """Mean negative log probability of the label plus the weighted norm.
    ``rows``: ``class_id``, ``p``."""
    nll = -F.ln(F.element_at("p", F.col("class_id") + 1))
    return rows.agg(F.avg(nll).alias("nll")).select(
        "nll",
        l2_norm(model).scalar().alias("norm"),
        (F.col("nll") + reg * l2_norm(model).scalar()).alias("loss"),
        (reg * l2_norm(model).scalar() / (F.col("nll") + reg * l2_norm(model).scalar())).alias("norm_share"),
    )


def agreement(pairs: DataFrame) -> DataFrame:
    """One summary row: share of equal arg-max classes and both divergences."""
    same = (argmax(F.col("tp")) == argmax(F.col("sp"))).cast("double")
    return pairs.agg(
        F.count(F.lit(1)).alias("n_tokens"),
        F.avg(same).alias("accuracy"),
        kl_cells(pairs).alias("kl_cells"),
        F.avg(kl_row("sp", "tp")).alias("kl_rows"),
    )


def confusion(pairs: DataFrame, tags: list[str]) -> DataFrame:
    names = F.array(*[F.lit(t) for t in tags])
    return pairs.groupBy(
        F.element_at(names, argmax(F.col("tp")) + 1).alias("teacher"),
        F.element_at(names, argmax(F.col("sp")) + 1).alias("student"),
    ).agg(F.count(F.lit(1)).alias("n"))
