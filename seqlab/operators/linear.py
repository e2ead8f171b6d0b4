"""Linear scoring and softmax training over named sparse features.

A model is two tables: ``(feature, w array<double>)`` with one cell per class, and a bias
array of the same length held with the tag list. Long form is ``(feature, class_id, w)``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqlab.functions.text import feature_array
from seqlab.functions.vectors import argmax, array_total, let, softmax
from seqlab.operators.features import context_rows
from seqlab.operators.scale import checked_small, lookup
from seqlab.session import written
from seqlab.sources.corpora import KEY, TOKEN, pack

# Weights that may pass through the driver in the built-in trainer.
MAX_DRIVER_WEIGHTS = 20_000_000
HISTORY = ("prev_tag=", "prevprev_tag=", "tag_bigram=")


class LinearModel(NamedTuple):
    tags: list[str]
    weights: DataFrame  # feature, w array<double>
    bias: list[float]


def cells(make, k: int) -> Column:
    return F.array(*[make(i) for i in range(k)])


def long_weights(model: LinearModel) -> DataFrame:
    return model.weights.select("feature", F.posexplode("w").alias("class_id", "w"))


def packed_weights(weights: DataFrame, k: int) -> DataFrame:
    """Long to packed form; classes that are absent weigh 0."""
    return weights.groupBy("feature").agg(
        cells(lambda i: F.sum(F.when(F.col("class_id") == i, F.col("w")).otherwise(0.0)), k).alias("w")
    )


def count_weights(rows: DataFrame, tags: list[str]) -> LinearModel:
    """Closed-form weights from smoothed counts:
    ``w = ln(1 + n(feature, class)) - ln(K + n(feature))``, log priors as bias."""
    k = len(tags)
    each = rows.select("tag", F.explode("features").alias("feature"))
    n = [F.count(F.when(F.col("tag") == t, 1)) for t in tags]
    w = cells(lambda i: F.ln(1.0 + n[i]) - F.ln(float(k) + F.count(F.lit(1))), k)
    weights = each.groupBy("feature").agg(w.alias("w"))
    by_tag = {r.tag: r.n for r in checked_small(
        rows.groupBy("tag").agg(F.count(F.lit(1)).alias("n")), 1000, "tags")}
    total = sum(by_tag.values())
    bias = [float(np.log((1.0 + by_tag.get(t, 0)) / (k + total))) for t in tags]
    return LinearModel(tags, weights, bias)


def scores(rows: DataFrame, model: LinearModel, keep: list[str]) -> DataFrame:
    """Bias plus the weight rows of the active features, as ``z array<double>`` per token.

    ``keep`` are columns fixed by the token. Unknown features add nothing.
    """
    k = len(model.tags)
    each = rows.select(*keep, F.explode("features").alias("feature"))
    found = lookup(each, model.weights.select("feature", "w"), ["feature"])
    z = cells(lambda i: F.coalesce(F.sum(F.col("w")[i]), F.lit(0.0)) + F.lit(model.bias[i]), k)
    return found.groupBy(*keep).agg(z.alias("z"))


def predict_proba(rows: DataFrame, model: LinearModel, keep: list[str] | None = None) -> DataFrame:
    """Class probabilities ``p array<double>`` per token."""
    keep = keep or [*TOKEN, "split", "tag"]
    return scores(rows, model, keep).select(*keep, softmax(F.col("z")).alias("p"))


def long_probs(probs: DataFrame, *keep: str) -> DataFrame:
    return probs.select(*keep, F.posexplode("p").alias("class_id", "p"))


def of_history(feature: Column) -> Column:
    """Whether a feature name depends on earlier predictions."""
    return reduce(lambda a, b: a | b, [feature.startswith(prefix) for prefix in HISTORY])


def history_weights(model: LinearModel) -> dict[str, list[float]]:
    """Weights of the features that depend on earlier predictions: (K+1)^2 + 2(K+1) at most."""
    k = len(model.tags) + 1
    rows = checked_small(
        model.weights.where(of_history(F.col("feature"))), k * k + 2 * k, "tag-history features"
    )
    return {r.feature: list(r.w) for r in rows}


def word_scores(sentences: DataFrame, model: LinearModel) -> DataFrame:
    """Score of everything but the tag history, per token. Only whether a previous tag exists
    matters to the capital flags, and that is known from the position."""
    rows = context_rows(sentences)
    placeholder = {c: F.col(c) for c in ("word", "lowered", "next_word", "prev_word", "prevprev_word")}
    placeholder["prev_tag"] = F.when(F.col("pos") == 0, "*").otherwise("")
    placeholder["prevprev_tag"] = F.when(F.col("pos") <= 1, "*").otherwise("")
    names = F.filter(feature_array(placeholder), lambda f: ~of_history(f))
    keep = [*TOKEN, "split", "word", "tag"]
    return scores(rows.select(*keep, names.alias("features")), model, keep)


def greedy_decode(sentences: DataFrame, model: LinearModel, distinct: bool = True) -> DataFrame:
    """Left-to-right tagging with the model's own previous tags.

    Columns: token key, ``split word tag pred prev_tag prevprev_tag p``. Word features are
    scored by joins for all tokens at once; tasks then walk each sentence with the small
    tag-history table. With ``distinct`` equal sentences are decoded once.
    """
    if distinct:
        content = F.sha2(F.concat_ws("\u001f", "words"), 256)
        keyed = sentences.withColumn("_content", content)
        first = keyed.groupBy("_content").agg(
            F.min_by(F.struct(*KEY, "split", "words", "tags"), F.struct(*KEY)).alias("s")
        )
        first = written(first, "contents")
        once = _decode(first.select("s.*"), model)
        found = first.select("_content", F.col("s.src_id").alias("src_id"), F.col("s.seg").alias("seg")).join(
            once.select(*KEY, "preds", "ps"), KEY
        )
        # Written, so each content is decoded once and a content that very many sentences share
        # is a skewed partition that adaptive execution can split.
        rows = keyed.join(written(found.select("_content", "preds", "ps"), "decoded"), "_content", "left")
    else:
        rows = _decode(sentences, model)
    zipped = F.arrays_zip("words", "tags", "preds", "p1", "p2", "ps")
    star = F.array(F.lit("*"))
    out = rows.select(
        *KEY, "split", "words", "tags", "preds", "ps",
        F.concat(star, "preds").alias("p1"), F.concat(star, star, "preds").alias("p2"),
    ).select(*KEY, "split", F.size("words").alias("_n"), F.posexplode(zipped).alias("pos", "t"))
    return out.where(F.col("pos") < F.col("_n")).select(
        *TOKEN, "split",
        F.col("t.words").alias("word"), F.col("t.tags").alias("tag"), F.col("t.preds").alias("pred"),
        F.col("t.p1").alias("prev_tag"), F.col("t.p2").alias("prevprev_tag"), F.col("t.ps").alias("p"),
    )


def _decode(sentences: DataFrame, model: LinearModel) -> DataFrame:
    tags = model.tags
    shared = sentences.sparkSession.sparkContext.broadcast(
        {f: np.array(w) for f, w in history_weights(model).items()}
    )
    packed = pack(word_scores(sentences, model), zs="z")

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = shared.value
        for pdf in batches:
            preds, probs = [], []
            for zs in pdf["zs"]:
                prev, prevprev = "*", "*"
                path, ps = [], []
                for z in zs:
                    z = z + sum(
                        table.get(f, 0.0)
                        for f in (
                            f"prev_tag={prev}", f"prevprev_tag={prevprev}", f"tag_bigram={prev} {prevprev}"
                        )
                    )
                    e = np.exp(np.maximum(z - z.max(), -300.0))
                    prev, prevprev = tags[int(z.argmax())], prev
                    path.append(prev)
                    ps.append(e / e.sum())
                preds.append(path)
                probs.append(ps)
            yield pdf.drop(columns=["zs"]).assign(preds=preds, ps=probs)

    schema = (
        "src_id long, seg int, split string, words array<string>, tags array<string>, "
        "preds array<string>, ps array<array<double>>"
    )
    return packed.select(*KEY, "split", "words", "tags", "zs").mapInPandas(walk, schema)


def center(model: LinearModel) -> LinearModel:
    """Subtract each feature's mean over classes, and that of the bias; predictions stay."""
    k = float(len(model.tags))
    centered = let(array_total(F.col("w")) / k, lambda m: F.transform("w", lambda x: x - m))
    weights = model.weights.select("feature", centered.alias("w"))
    shift = sum(model.bias) / k
    return LinearModel(model.tags, weights, [b - shift for b in model.bias])


def gradient_steps(
    rows: DataFrame, tags: list[str], steps: int, eta: float, reg: float, decay: float = 0.0
) -> LinearModel:
    """Full-batch descent with the weights kept as a distributed table.

    Each step: ``w <- (1 - 2 reg eta) w + eta mean gradient``, ``b <- b + eta mean gradient``
    from zero weights, ``eta / step^decay`` as the rate. This is the form for vocabularies
    whose weights do not fit the driver; :func:`train_softmax` is faster when they do.
    ``rows`` carry ``features`` and a ``target array<double>`` per class.
    """
    k = len(tags)
    rows = written(rows.select(*TOKEN, F.array_distinct("features").alias("features"), "target"), "examples")
    n_rows = rows.count()
    zero = F.array_repeat(F.lit(0.0), k)
    weights = written(rows.select(F.explode("features").alias("feature")).distinct().select("feature", zero.alias("w")), "weights")
    bias = [0.0] * k
    for step in range(1, steps + 1):
        rate = eta / step**decay
        p = predict_proba(rows, LinearModel(tags, weights, bias), [*TOKEN])
        gaps = rows.join(p, TOKEN).select(
            "features", cells(lambda i: F.col("target")[i] - F.col("p")[i], k).alias("g")
        )
        means = gaps.agg(*[F.avg(F.col("g")[i]).alias(f"g{i}") for i in range(k)]).first()
        sums = gaps.select(F.explode("features").alias("feature"), "g").groupBy("feature").agg(
            cells(lambda i: F.sum(F.col("g")[i]), k).alias("g")
        )
        keep = 1.0 - 2.0 * reg * rate
        weights = written(
            weights.join(sums, "feature").select(
                "feature",
                cells(lambda i: F.col("w")[i] * keep + F.col("g")[i] * (rate / n_rows), k).alias("w"),
            ),
            "weights",
        )
        bias = [b + rate * m for b, m in zip(bias, means)]
    return LinearModel(tags, weights, bias)


def hard_targets(rows: DataFrame, tags: list[str], column: str = "tag") -> DataFrame:
    return rows.withColumn("target", F.array(*[(F.col(column) == t).cast("double") for t in tags]))


def train_softmax(
    rows: DataFrame, vocab: DataFrame, tags: list[str], reg: float, max_iter: int = 100
) -> LinearModel:
    """Multinomial logistic regression on hard or soft targets (``target`` per class).

    A soft row becomes one weighted row per class. L2 applies to weights only. Where the vocabulary
    and the weights are few enough they pass through the driver; beyond that training stays in tables,
    see :func:`training.lbfgs`.
    """
    k = len(tags)
    if vocab.limit(MAX_DRIVER_WEIGHTS // k + 1).count() > MAX_DRIVER_WEIGHTS // k:
        from seqlab.operators import training

        return training.lbfgs(rows, tags, reg, max_steps=max_iter, vocab=vocab).model
    names = checked_small(vocab.select("feature", "idx"), MAX_DRIVER_WEIGHTS // k, "feature vocabulary")
    order = [r.feature for r in sorted(names, key=lambda r: r.idx)]
    vectorizer = CountVectorizerModel.from_vocabulary(order, "features", "vector", binary=True)
    # The class list travels as metadata: a class no row has keeps its place.
    meta = {"ml_attr": {"type": "nominal", "name": "label", "vals": tags}}
    data = (
        vectorizer.transform(rows)
        .select("vector", F.posexplode("target").alias("class_id", "weight"))
        .where("weight > 0")
        .select("vector", "weight", F.col("class_id").cast("double").alias("label", metadata=meta))
    )
    fit = LogisticRegression(
        featuresCol="vector", labelCol="label", weightCol="weight", family="multinomial",
        regParam=2.0 * reg, elasticNetParam=0.0, standardization=False, maxIter=max_iter, tol=1e-9,
    ).fit(data)
    w = fit.coefficientMatrix.toArray()
    arrow = pa.table({"feature": pa.array(order), "w": pa.array(list(w.T), pa.list_(pa.float64()))})
    weights = rows.sparkSession.createDataFrame(arrow)
    return LinearModel(tags, weights, [float(b) for b in fit.interceptVector.toArray()])


def predicted(probs: DataFrame, tags: list[str]) -> DataFrame:
    names = F.array(*[F.lit(t) for t in tags])
    return probs.withColumn("pred", F.element_at(names, argmax(F.col("p")) + 1))
