"""Substring dedup by windows that occur earlier, in place of relative Lempel-Ziv parsing.

Words go when a window of theirs occurs earlier in the corpus. No factor is parsed: there is no
greedy longest match and no source of a factor, and a run of copied windows, called a factor below,
may come from several sources. The index is cut into reference blocks by *seeds*. A seed is the
``SEED`` consecutive words whose hash is the smallest in a window of ``window`` words; equal
windows have equal seeds, so whatever a factor can be copied from lies in the block of its seeds,
and no text is compared with a block that holds none of them.

1. Every text names its seeds. Blocks of seeds report those that occur more than once.
2. Only around those seeds do texts send the windows to the blocks of the reference. A block
   sorts its windows and marks those that occur earlier.
3. Consecutive copied windows join to factors of at least ``window`` words. Because every window
   is looked up, also those across the bounds of two factors are checked, and nothing shorter
   than a window passes. Factors cover the words to remove.

A seed or passage that very many texts share costs each slice of 1 MB one entry per block: what
repeats inside a slice is settled there. Texts move once, in one shuffle that all three steps
read; the rest are hashes. A window counts as equal when 96 bits of two hashes of its words are, a word when
64 bits of its hash are; see :mod:`arrow_text`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType, VariantType

from seqlab.llm.arrow_text import (
    buffers,
    gather,
    list_array,
    slices,
    window_hashes,
    word_bounds,
    word_hashes,
)

SEED = 8
#: Blocks per shuffle partition, so that hashing them to partitions comes out even.
BLOCKS = 4


def sortable(value: Column, kind: DataType) -> list[Column]:
    """What rows can be ordered by in a value of any type: of structs their fields, of maps nothing."""
    if isinstance(kind, StructType):
        return [c for f in kind.fields for c in sortable(value.getField(f.name), f.dataType)]
    if isinstance(kind, ArrayType) and not sortable(value, kind.elementType):
        return []
    if isinstance(kind, ArrayType) and isinstance(kind.elementType, StructType):
        return [F.to_json(value)]
    return [] if isinstance(kind, (MapType, VariantType)) else [value]


def numbered(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, copy, text of the rows with an id: ``copy`` tells rows of one id apart by text.

    Rows of one id and text come in the order of what can be ordered of their other columns."""
    # No alias where none is needed: plans that read the rows twice then share one shuffle.
    plain = docs.schema["doc_id"].dataType.typeName() == "long"
    number = F.col("doc_id") if plain else F.col("doc_id").cast("long").alias("doc_id")
    rows = docs.select(number, "text", *more)
    rest = [c for name in more for c in sortable(F.col(name), docs.schema[name].dataType)]
    order = W.partitionBy("doc_id").orderBy("text", *rest)
    numbers = rows.where("doc_id IS NOT NULL").withColumn("copy", F.row_number().over(order))
    return numbers.select("doc_id", "copy", "text", *more)


def block_count(docs: DataFrame) -> int:
    return BLOCKS * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))


class Slice:
    """Words of the texts of one slice, as hashes, and which windows lie inside one text."""

    def __init__(self, texts: pa.Array, window: int) -> None:
        self.data, self.offsets = buffers(texts)
        self.starts, self.ends, self.counts = word_bounds(self.data, self.offsets)
        self.first = np.cumsum(self.counts) - self.counts  # first word of each text
        per_text = np.maximum(self.counts - window + 1, 0)
        self.at = gather(self.first, per_text)  # first word of each window
        self.text = np.repeat(np.arange(len(texts)), per_text)
        self.words = word_hashes(self.data, self.starts, self.ends)

    def seeds(self, window: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash and place of the seed of each window."""
        if not len(self.at):
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        grams = window_hashes(self.words, SEED)
        span = window - SEED + 1
        least = np.lib.stride_tricks.sliding_window_view(grams, span).argmin(axis=1)
        place = self.at + least[self.at]
        return grams[place], place


def first_of(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows in order: a stable sort by key, the start of each run, and the run of each row."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    fresh = np.ones(len(ranked), bool)
    fresh[1:] = ranked[1:] != ranked[:-1]
    return order, fresh, np.cumsum(fresh) - 1


def by_block(block: np.ndarray, columns: list[tuple[np.ndarray, pa.DataType]]) -> list[pa.Array]:
    """One row per block with lists of what goes there, rows of a block in their order."""
    order = np.argsort(block, kind="stable")
    ids, counts = np.unique(block, return_counts=True)
    lists = [list_array(values[order], counts, kind) for values, kind in columns]
    return [pa.array(ids.astype(np.int32)), *lists]


def flat(table: pa.Table, name: str) -> np.ndarray:
    """The values of a list column of a group, one after another."""
    return table.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False)


# Step 1: seeds


def _seed_rows(window: int, blocks: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, texts in slices(batches):
            cut = Slice(texts, window)
            hashes, place = cut.seeds(window)
            if not len(hashes):
                continue
            fresh = np.ones(len(place), bool)
            fresh[1:] = (place[1:] != place[:-1]) | (cut.text[1:] != cut.text[:-1])
            hashes, text = hashes[fresh], cut.text[fresh]
            order, first, run_of = first_of(hashes)
            several = np.bincount(run_of)[run_of] > 1
            ids = piece.column(0).to_numpy().astype(np.int64)
            sent = order[first]
            block = (hashes[sent] % np.uint64(blocks)).astype(np.int64)
            keys = hashes[sent].view(np.int64)
            columns = [
                (keys, pa.int64()),
                (ids[text[sent]], pa.int64()),
                (several[first].astype(np.int8), pa.int8()),
            ]
            yield pa.RecordBatch.from_arrays(by_block(block, columns), names)
            # Repeats inside the slice need no block: block -1 carries them to their texts.
            own = order[several & ~first]
            if len(own):
                nothing = np.zeros(len(own), np.int8)
                columns = [
                    (hashes[own].view(np.int64), pa.int64()),
                    (ids[text[own]], pa.int64()),
                    (nothing, pa.int8()),
                ]
                local = by_block(-1 - text[own] % blocks, columns)
                yield pa.RecordBatch.from_arrays(local, names)

    names = ["block", "key", "doc", "several"]
    return run


def _repeated(table: pa.Table) -> pa.Table:
    key, doc = flat(table, "key"), flat(table, "doc")
    several = flat(table, "several").astype(bool)
    block = table.column("block")[0].as_py()
    if block < 0:
        keep = np.ones(len(key), bool)
    else:
        order, _, run_of = first_of(key)
        known = (np.bincount(run_of) > 1) | (np.bincount(run_of, several[order]) > 0)
        keep = np.empty(len(key), bool)
        keep[order] = known[run_of]
    key, doc = key[keep], doc[keep]
    order = np.argsort(doc, kind="stable")
    ids, counts = np.unique(doc, return_counts=True)
    return pa.table({"doc_id": pa.array(ids), "keys": list_array(key[order], counts, pa.int64())})


# Step 2: windows around the repeated seeds


def _window_rows(window: int, blocks: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, texts in slices(_with_keys(batches)):
            cut = Slice(texts, window)
            hashes, _ = cut.seeds(window)
            lists = piece.column(3)
            known = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            chosen = np.isin(hashes, known)  # a seed repeated for one text is for all
            if not chosen.any():
                continue
            at, text = cut.at[chosen], cut.text[chosen]
            one = window_hashes(cut.words, window, 1)[at]
            two = window_hashes(cut.words, window, 2)[at]
            seed = hashes[chosen]
            ids = piece.column(0).to_numpy().astype(np.int64)
            copies = piece.column(1).to_numpy().astype(np.int64)
            doc = ids[text]
            place = copies[text] * (1 << 32) + (at - cut.first[text])
            yield from window_batches(one, two, seed, doc, place, blocks)

    return run


WINDOW_SCHEMA = "block int, one array<long>, two array<int>, doc array<long>, place array<long>"


def window_batches(
    one: np.ndarray,
    two: np.ndarray,
    seed: np.ndarray,
    doc: np.ndarray,
    place: np.ndarray,
    blocks: int,
) -> Iterator[pa.RecordBatch]:
    """Rows for the blocks of the reference: of equal windows here only the earliest.

    The later ones are copies for certain; negative blocks, dealt by document, carry them past the
    reference.
    """
    order = np.lexsort((place, doc, one))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])
    late = np.zeros(len(order), bool)
    late[order[~fresh]] = True
    block = (seed % np.uint64(blocks)).astype(np.int64)
    block = np.where(late, -1 - doc % blocks, block)
    check = (two >> np.uint64(32)).astype(np.uint32).view(np.int32)
    columns = [
        (one.view(np.int64), pa.int64()),
        (check, pa.int32()),
        (doc, pa.int64()),
        (place, pa.int64()),
    ]
    yield pa.RecordBatch.from_arrays(
        by_block(block, columns), ["block", "one", "two", "doc", "place"]
    )


def _with_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield batch.filter(batch.column(3).is_valid())


def later_windows(table: pa.Table) -> pa.Table:
    """Places of the windows of a block that occur earlier: runs of start and length per row."""
    one, two = flat(table, "one"), flat(table, "two")
    doc, place = flat(table, "doc"), flat(table, "place")
    if table.column("block")[0].as_py() >= 0:
        order = np.lexsort((place, doc, two, one))
        fresh = np.ones(len(order), bool)
        fresh[1:] = (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])
        later = order[~fresh]
        doc, place = doc[later], place[later]
    order = np.lexsort((place, doc))
    doc, place = doc[order], place[order]
    fresh = np.ones(len(doc), bool)
    fresh[1:] = (doc[1:] != doc[:-1]) | (place[1:] != place[:-1] + 1)
    begin = np.flatnonzero(fresh)
    length = np.diff(np.append(begin, len(doc)))
    ids, counts = np.unique(doc[begin], return_counts=True)
    return pa.table(
        {
            "doc_id": pa.array(ids),
            "place": list_array(place[begin], counts, pa.int64()),
            "windows": list_array(length, counts, pa.int32()),
        }
    )


RUN_SCHEMA = "doc_id long, place array<long>, windows array<int>"


def joined_runs(runs: DataFrame) -> DataFrame:
    """One row per document with all runs of copied windows."""
    lists = [F.flatten(F.collect_list(c)).alias(c) for c in ("place", "windows")]
    return runs.groupBy("doc_id").agg(*lists)


# Step 3: factors


def copied(
    units: np.ndarray,
    first: np.ndarray,
    copies: np.ndarray,
    place: list[np.ndarray | None],
    windows: list[np.ndarray | None],
    window: int,
) -> np.ndarray:
    """Which units (words or lines) of a slice lie in a factor.

    ``units`` and ``first``: how many units each text has, and its first one.
    """
    change = np.zeros(int(units.sum()) + 1, np.int64)
    for k, runs in enumerate(place):
        if runs is None or not len(runs):
            continue
        own = runs >> 32 == copies[k]
        start = (runs[own] & 0xFFFFFFFF) + first[k]
        np.add.at(change, start, 1)
        np.add.at(change, start + windows[k][own] + window - 1, -1)
    return np.cumsum(change)[:-1] > 0


def find_copies(rows: DataFrame, window: int) -> DataFrame:
    """Rows of :func:`numbered` with the runs of windows that start earlier (null: none)."""
    blocks = block_count(rows)
    seeds = rows.mapInArrow(
        _seed_rows(window, blocks),
        "block int, key array<long>, doc array<long>, several array<byte>",
    )
    repeated = seeds.groupBy("block").applyInArrow(_repeated, "doc_id long, keys array<long>")
    keys = repeated.groupBy("doc_id").agg(F.flatten(F.collect_list("keys")).alias("keys"))
    around = rows.join(keys, "doc_id", "left").select("doc_id", "copy", "text", "keys")
    windows = around.mapInArrow(_window_rows(window, blocks), WINDOW_SCHEMA)
    runs = windows.groupBy("block").applyInArrow(later_windows, RUN_SCHEMA)
    return rows.join(joined_runs(runs), "doc_id", "left").select(
        "doc_id", "copy", "text", "place", "windows"
    )


def run_lists(piece: pa.RecordBatch, column: int) -> list[np.ndarray | None]:
    lists = piece.column(column)
    values = lists.values.to_numpy(zero_copy_only=False)
    at = lists.offsets.to_numpy()
    return [values[a:b] if b > a else None for a, b in zip(at[:-1], at[1:], strict=True)]


def remove(docs: DataFrame, window: int = 20) -> DataFrame:
    """Remove every word in a window of ``window`` words that also starts earlier.

    Earlier means a smaller ``doc_id``, or the same document and an earlier start. Words are
    ``[^\\x20\\x09-\\x0D]+``, unchanged; windows are judged on the input. Returns doc_id, n_words,
    n_removed and ``kept``, the other words joined by one space.

    A null text has no words. Rows that share a ``doc_id`` count as one after another in the
    order of their texts, so a repeated row is a copy. A row without a ``doc_id`` is in no order:
    it is kept whole and nothing is copied from it. Other columns are ignored; an empty table
    gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, texts in slices(batches):
            data, offsets = buffers(texts)
            starts, ends, counts = word_bounds(data, offsets)
            first = np.cumsum(counts) - counts
            copies = piece.column(1).to_numpy(zero_copy_only=False)
            gone = copied(counts, first, copies, run_lists(piece, 3), run_lists(piece, 4), window)
            text_of = np.repeat(np.arange(len(counts)), counts)
            removed = np.bincount(text_of[gone], minlength=len(counts))
            keep = ~gone
            # Every kept word with the byte after it, which becomes a space.
            lengths = ends[keep] - starts[keep] + 1
            picked = np.append(data, np.uint8(32))[gather(starts[keep], lengths)]
            stops = np.cumsum(lengths)
            picked[stops - 1] = 32
            size = np.bincount(text_of[keep], lengths, len(counts)).astype(np.int64)
            stop = np.cumsum(size)
            raw = picked.tobytes()
            kept = [raw[b - n : b - 1] if n else b"" for n, b in zip(size, stop, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    piece.column(0),
                    pa.array(counts, pa.int64()),
                    pa.array(removed, pa.int64()),
                    pa.array(kept, pa.binary()).cast(pa.string()),
                ],
                ["doc_id", "n_words", "n_removed", "kept"],
            )

    nowhere = docs.where("doc_id IS NULL").select(
        F.lit(None).cast("long").alias("doc_id"),
        F.lit(1).alias("copy"),
        "text",
        F.lit(None).cast("array<long>").alias("place"),
        F.lit(None).cast("array<int>").alias("windows"),
    )
    judged = find_copies(numbered(docs), window).unionByName(nowhere)
    return judged.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string")


def digests(removed: DataFrame) -> DataFrame:
    return removed.select(
        "doc_id", "n_words", "n_removed", F.sha2(F.col("kept"), 256).alias("kept_sha256")
    )
