"""Quality classifier: votes of the nearest labelled documents in a latent-semantic space.

A text becomes counts of hashed terms: trigrams of byte shapes (letters of one case, digits and
white space look alike, punctuation does not), words, and words that repeat the one before. A
truncated singular value decomposition of labelled rows gives the latent space. Every document
meets every labelled vector in blocked cosine products; its ``NEIGHBOURS`` nearest vote with
their labels, weighted by a power of the similarity.

The model is fitted on a bounded sample of labelled rows: at most ``LABELLED`` vectors are
broadcast (``LABELLED * RANK`` floats, half a megabyte) and the decomposition sees the first
``DECOMPOSED`` of them, in the order of a hash of their ids. Everything else covers all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqlab.llm.arrow_text import buffers, mix, slices, word_bounds, word_hashes
from seqlab.session import written

LABELLED = 4096
DECOMPOSED = 2048
RANK = 32
NEIGHBOURS = 15
POWER = 8
SHAPES, WORDS = 2048, 1024
#: Share of each term family in the length of a vector.
WORD_WEIGHT = 0.5
#: Floor of a term's deviation, so that terms seen once do not rule the space.
FLOOR = 0.02
BLOCK = 512
DIGITS = 100_000

_SHAPE = np.zeros(256, np.int64)
_SHAPE[97:123], _SHAPE[65:91], _SHAPE[48:58], _SHAPE[128:] = 1, 2, 3, 4
_SHAPE[32], _SHAPE[10], _SHAPE[[9, 11, 12, 13]] = 5, 6, 7
_PUNCTUATION = [b for b in range(33, 127) if _SHAPE[b] == 0]
_SHAPE[_PUNCTUATION] = 8 + np.arange(len(_PUNCTUATION))
_KINDS = 8 + len(_PUNCTUATION)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray


def features(texts: pa.Array) -> np.ndarray:
    """One row of term weights per text: square roots of the shares of its terms."""
    data, offsets = buffers(texts)
    n = len(texts)
    text = np.repeat(np.arange(n), np.diff(offsets))
    shape = _SHAPE[data]
    code = np.zeros(len(data), np.int64)
    code[2:] = (shape[:-2] * _KINDS + shape[1:-1]) * _KINDS + shape[2:]
    whole = np.ones(len(data), bool)
    whole[:2] = False
    whole[2:] &= text[2:] == text[:-2]
    code = (mix(code[whole].astype(np.uint64)) % np.uint64(SHAPES)).astype(np.int64)
    shapes = np.bincount(text[whole] * SHAPES + code, minlength=n * SHAPES).reshape(n, SHAPES)
    starts, ends, counts = word_bounds(data, offsets)
    hashes = word_hashes(data, starts, ends)
    of = np.repeat(np.arange(n), counts)
    word = (hashes % np.uint64(WORDS)).astype(np.int64)
    words = np.bincount(of * WORDS + word, minlength=n * WORDS).reshape(n, WORDS)
    again = np.zeros(len(hashes), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (of[1:] == of[:-1])
    repeats = np.bincount(of[again], minlength=n) / np.maximum(counts, 1)
    parts = [
        np.sqrt(shapes / np.maximum(shapes.sum(1, keepdims=True), 1)),
        WORD_WEIGHT * np.sqrt(words / np.maximum(counts, 1)[:, None]),
        np.sqrt(repeats)[:, None],
    ]
    return np.hstack(parts).astype(np.float32)


def blocks_of(texts: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """Features of at most ``BLOCK`` texts at a time, with the place of the first."""
    for k in range(0, len(texts), BLOCK):
        yield k, features(texts.slice(k, BLOCK))


def project(model: Model, rows: np.ndarray) -> np.ndarray:
    latent = ((rows - model.mean) / model.scale) @ model.axes
    length = np.sqrt((latent * latent).sum(axis=1, keepdims=True))
    return latent / np.maximum(length, 1e-12)


def vote(model: Model, latent: np.ndarray) -> np.ndarray:
    """Share of label 1 among the nearest labelled rows; ties in similarity go to the first."""
    n = len(model.labels)
    if not n:
        return np.full(len(latent), 0.5)
    near = np.rint(latent @ model.vectors.T * DIGITS).astype(np.int64)
    ranked = near * n + np.arange(n - 1, -1, -1)
    k = min(NEIGHBOURS, n)
    top = np.argpartition(ranked, n - k, axis=1)[:, n - k :]
    weight = np.maximum(np.take_along_axis(near, top, axis=1), 0) / DIGITS
    weight = weight**POWER
    total = weight.sum(axis=1)
    share = (weight * model.labels[top]).sum(axis=1) / np.maximum(total, 1e-300)
    return np.where(total > 0, share, model.labels.mean())


def _vectors(batches: Iterator[pa.RecordBatch], transform) -> Iterator[pa.RecordBatch]:
    for piece, texts in slices(batches):
        rows = [transform(r).astype("<f4") for _, r in blocks_of(texts)]
        raw = [x.tobytes() for block in rows for x in block]
        yield pa.RecordBatch.from_arrays(
            [piece.column(0), piece.column(1), pa.array(raw, pa.binary())],
            ["doc_id", "label", "vector"],
        )


def _collected(labelled: DataFrame, transform, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(vectors, labels) of a bounded table, in the order of a hash of the ids."""
    rows = (
        labelled.mapInArrow(
            lambda batches: _vectors(batches, transform), "doc_id long, label int, vector binary"
        )
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .select("label", "vector")
        .toArrow()
    )
    out = np.empty((len(rows), width), np.float32)
    k = 0
    for batch in rows.to_batches():
        for raw in batch.column(1):
            out[k] = np.frombuffer(raw.as_buffer(), "<f4")
            k += 1
    return out, rows.column("label").to_numpy().astype(np.float64)


def _leading_axes(rows: np.ndarray) -> np.ndarray:
    """Right singular vectors of ``rows`` by the eigenvectors of the small product: one column each.

    Needs two square matrices of the number of rows, a fraction of a full decomposition.
    """
    values, vectors = np.linalg.eigh(rows @ rows.T)
    rank = min(RANK, len(rows))
    values, vectors = values[::-1][:rank], vectors[:, ::-1][:, :rank]
    kept = values > 1e-6 * max(float(values[0]), 1e-30)
    return rows.T @ (vectors[:, kept] / np.sqrt(values[kept]))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on ``labels(doc_id, label)`` joined to ``docs(doc_id, text)``.

    At most ``LABELLED`` ids are taken, those with the smallest hashes; of repeated ids one label
    and one text count. Labels other than 0 and 1, null ids and ids without a document are
    passed over. Without labelled rows the model scores everything 0.5.
    """
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = (
        labels.where("doc_id IS NOT NULL AND label IN (0, 1)")
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.max("label").cast("int").alias("label"))
        .orderBy(*order)
        .limit(LABELLED)
    )
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # The broadcast side has LABELLED rows at most.
    sample = written(
        texts.join(F.broadcast(chosen), "doc_id")
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"), F.max("text").alias("text"))
        .select("doc_id", "label", "text"),
        "labelled",
    )
    first = sample.orderBy(*order).limit(DECOMPOSED)
    width = SHAPES + WORDS + 1
    rows, _ = _collected(first, lambda r: r, width)
    if not len(rows):
        empty = np.zeros((0, RANK), np.float32)
        return Model(np.zeros(width), np.ones(width), np.zeros((width, RANK)), empty, np.zeros(0))
    mean, scale = rows.mean(axis=0), rows.std(axis=0) + np.float32(FLOOR)
    rows -= mean
    rows /= scale
    axes = _leading_axes(rows)
    part = Model(mean, scale, axes, axes[:0], axes[:0])
    del rows
    vectors, known = _collected(sample, lambda r: project(part, r), axes.shape[1])
    return Model(mean, scale, part.axes, vectors, known)


def score(docs: DataFrame, model: Model, out: str = "score") -> DataFrame:
    """The columns of ``docs`` with ``out``, the chance of label 1 between 0 and 1.

    Every whole text is scored, one row for each row; null counts as empty, and empty texts get
    the vote for a text without terms. Only ``text`` is looked at; other columns, whatever
    their names, are carried along, one called ``out`` is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [c for c in docs.columns if c != out]
    packed = docs.select("text", F.struct(*names).alias("rest"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        for piece, texts in slices(batches):
            votes = [vote(fitted, project(fitted, rows)) for _, rows in blocks_of(texts)]
            column = pa.array(np.round(np.concatenate(votes), 6), pa.float64())
            yield pa.RecordBatch.from_arrays([piece.column(1), column], ["rest", "score"])

    kind = packed.schema["rest"].dataType.simpleString()
    scored = packed.mapInArrow(run, f"rest {kind}, score double")
    return scored.select(*[F.col("rest").getField(c).alias(c) for c in names], F.col("score").alias(out))


def held_out(doc_id: Column) -> Column:
    """Rows that no label is learned from: crc32 of the id as text is divisible by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))
