"""Best tag paths of sequences too long for one task, by max-plus products over chunks.

Decoding a token is a product in the (max, +) algebra: scores of the states (last two tags) times a matrix.
The product is associative, so a long sequence is cut into chunks and

1. each chunk becomes one matrix: the best score from every state at its start to every state at its end;
2. matrices of neighbouring chunks are multiplied pair by pair, up to the whole sequence;
3. on the way down each chunk learns the scores of the states at its start;
4. with these, each chunk tells for every state at its end from which state at its start the best path
   comes. These maps are composed upwards and followed downwards in the same way from the best last state,
   so every chunk learns in which state it ends;
5. each chunk decodes its own tokens between the two.

Rounds grow with the logarithm of the number of chunks, and no task holds more than a few chunks of a
sequence. A matrix has as many entries as there are pairs of states, which bounds the tag set: see
``MAX_STATES``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqlab.session import written
from seqlab.sources.corpora import KEY

#: States, (tags + 1)^2, up to which matrices of all pairs of them are made.
MAX_STATES = 512
SEQUENCE = [*KEY, "l1", "l2"]
_KEYS = "src_id long, seg int, l1 double, l2 double"


def _steps(start: np.ndarray, log_emit: np.ndarray, log_q: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Scores after the tokens for each row of start scores [S, K+1, K+1], and the best tag before each."""
    k = log_q.shape[0] - 1
    delta, back = start, []
    for row in log_emit:
        score = delta[:, :, :, None] + log_q[None, :, :, :k]
        back.append(score.argmax(axis=1).astype(np.int16))
        delta = np.full_like(start, -np.inf)
        delta[:, :, :k] = score.max(axis=1) + row
    return delta, back


def _log(emits) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.log(np.stack(emits))


def matrix(emits, log_q: np.ndarray) -> np.ndarray:
    """The best score from each state at the start of a chunk to each at its end."""
    k = log_q.shape[0]
    start = np.full((k * k, k * k), -np.inf)
    np.fill_diagonal(start, 0.0)
    delta, _ = _steps(start.reshape(k * k, k, k), _log(emits), log_q)
    return delta.reshape(k * k, k * k)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(max, +) product, a row of ``a`` at a time."""
    return np.stack([(row[:, None] + b).max(axis=0) for row in a])


def _origins(start: np.ndarray, emits, log_q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scores at the end of a chunk, and for each state there the state at the start of its best path."""
    k = log_q.shape[0]
    delta, back = _steps(start.reshape(1, k, k), _log(emits), log_q)
    u, v = np.divmod(np.arange(k * k), k)
    for step in reversed(back):
        known = np.minimum(v, step.shape[2] - 1)  # the start tag ends no path
        u, v = step[0, u, known], u
    return delta.ravel(), u.astype(np.int64) * k + v


def _path(start: np.ndarray, end: int, emits, log_q: np.ndarray) -> list[int]:
    k = log_q.shape[0]
    _, back = _steps(start.reshape(1, k, k), _log(emits), log_q)
    u, v = divmod(end, k)
    out = []
    for step in reversed(back):
        out.append(int(v))
        u, v = int(step[0, u, v]), u
    return out[::-1]


def _bytes(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a).tobytes()


def _floats(b: bytes) -> np.ndarray:
    return np.frombuffer(b, np.float64)


def _pairs(level: DataFrame) -> DataFrame:
    """Nodes grouped under their parents: parent, left and right (null for a last node alone)."""
    side = F.col("idx").bitwiseAND(F.lit(1))
    payload = F.col("value")
    return level.groupBy(*SEQUENCE, F.shiftright("idx", 1).alias("idx")).agg(
        F.max(F.when(side == 0, payload)).alias("left"), F.max(F.when(side == 1, payload)).alias("right")
    )


def _up(level: DataFrame, combine) -> list[DataFrame]:
    """``level`` (sequence, idx, value) and the levels above it, up to one node for each sequence."""

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            value = [a if b is None else combine(a, b) for a, b in zip(pdf["left"], pdf["right"])]
            yield pdf[[*SEQUENCE, "idx"]].assign(value=value)

    levels = [level]
    while not levels[-1].where("idx > 0").isEmpty():
        merged = _pairs(levels[-1]).mapInPandas(merge, f"{_KEYS}, idx int, value binary")
        levels.append(written(merged, "path_level"))
    return levels


def _down(levels: list[DataFrame], top: DataFrame, first, second) -> DataFrame:
    """What each node of the lowest level is given, from what the one node of each sequence is given.

    ``first(given, left, right)`` and ``second(...)``: what the children of a node with ``given`` get.
    """
    given = top.select(*SEQUENCE, "idx", "given")
    for level in reversed(levels[:-1]):

        def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                keys = pdf[[*SEQUENCE]]
                rows = list(zip(pdf["given"], pdf["left"], pdf["right"]))
                yield keys.assign(idx=2 * pdf["idx"], given=[first(*r) for r in rows])
                both = pdf["right"].notna()
                yield keys[both].assign(
                    idx=2 * pdf["idx"][both] + 1, given=[second(*r) for r, two in zip(rows, both) if two]
                )

        children = _pairs(level).join(given, [*SEQUENCE, "idx"]).select(*SEQUENCE, "idx", "given", "left", "right")
        given = written(children.mapInPandas(split, f"{_KEYS}, idx int, given binary"), "path_given")
    return given


def decode(chunks: DataFrame, tables, tags: list[str]) -> DataFrame:
    """Decode ``chunks`` (sequence key, ``l1 l2 idx words tags unseen emits``): adds ``preds`` and ``score``.

    ``tables`` is a broadcast of the log transitions for each (l1, l2).
    """
    cols = ["split", "words", "tags", "unseen"]
    chunks = written(chunks.select(*SEQUENCE, "idx", *cols, "emits"), "path_chunks")
    k = len(tags) + 1
    start = np.full((k, k), -np.inf)
    start[k - 1, k - 1] = 0.0
    first_scores = _bytes(start)

    def matrices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            value = [_bytes(matrix(e, tables.value[(a, b)])) for e, a, b in zip(pdf["emits"], pdf["l1"], pdf["l2"])]
            yield pdf[[*SEQUENCE, "idx"]].assign(value=value)

    def squared(b: bytes) -> np.ndarray:
        return _floats(b).reshape(k * k, k * k)

    node = f"{_KEYS}, idx int, value binary"
    level = written(chunks.select(*SEQUENCE, "idx", "emits").mapInPandas(matrices, node), "path_level")
    ups = _up(level, lambda a, b: _bytes(product(squared(a), squared(b))))
    top = ups[-1].select(*SEQUENCE, "idx", F.lit(first_scores).alias("given"))
    starts = _down(
        ups, top,
        lambda given, left, right: given,
        lambda given, left, right: _bytes((_floats(given)[:, None] + squared(left)).max(axis=0)),
    )
    started = written(chunks.join(starts, [*SEQUENCE, "idx"]), "path_chunks")
    last = started.groupBy(*SEQUENCE).agg(F.max("idx").alias("last"))

    def origins(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            value, end, score = [], [], []
            for emits, given, a, b, is_last in zip(pdf["emits"], pdf["given"], pdf["l1"], pdf["l2"], pdf["is_last"]):
                log_q = tables.value[(a, b)]
                scores, origin = _origins(_floats(given), emits, log_q)
                value.append(_bytes(origin))
                final = scores + log_q[:, :, k - 1].ravel()
                end.append(_bytes(np.array([final.argmax()], np.int64)) if is_last else None)
                score.append(float(final.max()) if is_last else 0.0)
            yield pdf[[*SEQUENCE, "idx"]].assign(value=value, end=end, score=score)

    marked = started.join(last, SEQUENCE).withColumn("is_last", F.col("idx") == F.col("last"))
    maps = marked.select(*SEQUENCE, "idx", "emits", "given", "is_last").mapInPandas(origins, f"{node}, end binary, score double")
    maps = written(maps, "path_maps")

    def ints(b: bytes) -> np.ndarray:
        return np.frombuffer(b, np.int64)

    # A map takes the state at the end of a node to the one at its start.
    backs = _up(maps.select(*SEQUENCE, "idx", "value"), lambda a, b: _bytes(ints(a)[ints(b)]))
    ends = maps.where("end IS NOT NULL").select(*SEQUENCE, "end", "score")
    top = backs[-1].join(ends, SEQUENCE).select(*SEQUENCE, "idx", F.col("end").alias("given"))
    closing = _down(
        backs, top,
        lambda given, left, right: given if right is None else _bytes(ints(right)[ints(given)]),
        lambda given, left, right: given,
    )

    def paths(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            preds = [
                [tags[i] for i in _path(_floats(given), int(ints(end)[0]), emits, tables.value[(a, b)])]
                for emits, given, end, a, b in zip(pdf["emits"], pdf["given"], pdf["end_state"], pdf["l1"], pdf["l2"])
            ]
            yield pdf.drop(columns=["emits", "given", "end_state"]).assign(preds=preds)

    joined = started.join(closing.withColumnRenamed("given", "end_state"), [*SEQUENCE, "idx"]).join(ends.drop("end"), SEQUENCE)
    schema = f"{_KEYS}, idx int, split string, words array<string>, tags array<string>, unseen array<boolean>, score double, preds array<string>"
    return joined.select(*SEQUENCE, "idx", *cols, "score", "emits", "given", "end_state").mapInPandas(paths, schema)

