"""Line dedup by overlapping three-line windows.

The lines of a text that are not blank are hashed without white space at their ends, and every
``window`` consecutive ones make a window. Windows that occur earlier in the corpus are found by
their hashes, spread over blocks, and the lines that such windows cover are removed. Of windows
that repeat within a slice of 1 MB only the first goes to a block, so a passage in a third of all
documents costs one entry per slice. Texts move once; the rest are hashes of 96 bits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqlab.llm.arrow_text import buffers, gather, slices, window_hashes, word_bounds, word_hashes
from seqlab.llm.lz_dedup import (
    RUN_SCHEMA,
    WINDOW_SCHEMA,
    block_count,
    copied,
    joined_runs,
    later_windows,
    numbered,
    run_lists,
    window_batches,
)


def line_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the lines that are not blank, trimmed, and how many each text has."""
    starts, ends, counts = word_bounds(data, offsets)
    text = np.repeat(np.arange(len(counts)), counts)
    line = np.cumsum(data == 10)[starts] if len(starts) else starts
    first = np.ones(len(starts), bool)
    first[1:] = (line[1:] != line[:-1]) | (text[1:] != text[:-1])
    last = np.append(first[1:], True)[: len(starts)]
    return starts[first], ends[last], np.bincount(text[first], minlength=len(counts))


def _window_rows(window: int, blocks: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, texts in slices(batches):
            data, offsets = buffers(texts)
            starts, ends, counts = line_bounds(data, offsets)
            lines = word_hashes(data, starts, ends)
            per_text = np.maximum(counts - window + 1, 0)
            first = np.cumsum(counts) - counts
            at, text = gather(first, per_text), np.repeat(np.arange(len(counts)), per_text)
            if not len(at):
                continue
            one, two = window_hashes(lines, window, 1)[at], window_hashes(lines, window, 2)[at]
            ids = piece.column(0).to_numpy().astype(np.int64)
            copies = piece.column(1).to_numpy().astype(np.int64)
            place = copies[text] * (1 << 32) + (at - first[text])
            yield from window_batches(one, two, one, ids[text], place, blocks)

    return run


def _without(text: str | None, gone: np.ndarray) -> str | None:
    """The text without those of its non-blank lines that are gone."""
    if not gone.any():
        return text
    kept, k = [], 0
    for line in text.split("\n"):
        blank = not line.strip(" \t\n\v\f\r")
        if blank or not gone[k]:
            kept.append(line)
        k += not blank
    return "\n".join(kept)


def dedup(docs: DataFrame, window: int = 3) -> DataFrame:
    """The columns of ``docs`` with later occurrences of repeated line windows cut from ``text``.

    Two more columns follow: ``n_lines``, the lines that were not blank, and ``n_removed``. Later
    means a larger ``doc_id``, or the same document and a later start; windows are judged on the
    input. Blank lines stay where they are, as do texts with fewer than ``window`` lines. Columns
    of these two names in ``docs`` are replaced.

    A null text stays null. Rows that share a ``doc_id`` count as one after another in the order
    of their texts, so a repeated row is a copy; a row without a ``doc_id`` is kept whole and
    nothing is taken from it. Other columns, whatever their names, are carried along.
    """
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    packed = docs.select("doc_id", "text", F.struct(*[c for c in names if c != "text"]).alias("rest"))
    rows = numbered(packed, "rest")
    blocks = block_count(docs)
    windows = rows.mapInArrow(_window_rows(window, blocks), WINDOW_SCHEMA)
    runs = windows.groupBy("block").applyInArrow(later_windows, RUN_SCHEMA)
    nowhere = packed.where("doc_id IS NULL").select(
        F.lit(None).cast("long").alias("doc_id"),
        F.lit(1).alias("copy"),
        "text",
        "rest",
        F.lit(None).cast("array<long>").alias("place"),
        F.lit(None).cast("array<int>").alias("windows"),
    )
    judged = rows.join(joined_runs(runs), "doc_id", "left").select(nowhere.columns)
    judged = judged.unionByName(nowhere)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, texts in slices(batches):
            _, _, counts = line_bounds(*buffers(texts))
            first = np.cumsum(counts) - counts
            copies = piece.column(1).to_numpy(zero_copy_only=False)
            gone = copied(counts, first, copies, run_lists(piece, 4), run_lists(piece, 5), window)
            own = [gone[a : a + n] for a, n in zip(first, counts, strict=True)]
            text = [_without(t, g) for t, g in zip(piece.column(2).to_pylist(), own, strict=True)]
            removed = [int(g.sum()) for g in own]
            yield pa.RecordBatch.from_arrays(
                [piece.column(3), pa.array(text, pa.string()), pa.array(counts, pa.int64()),
                 pa.array(removed, pa.int64())],
                ["rest", "text", "n_lines", "n_removed"],
            )

    schema = f"rest {packed.schema['rest'].dataType.simpleString()}, text string, n_lines long, n_removed long"
    out = judged.mapInArrow(run, schema)
    columns = [F.col("text") if c == "text" else F.col("rest").getField(c).alias(c) for c in names]
    return out.select(*columns, "n_lines", "n_removed")
