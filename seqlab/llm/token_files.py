"""Token ids in ORC: run-length encoded integers, row indexes and Bloom filters on document ids.

``write_tokens`` encodes every whole text and writes one row per document in ascending document
order over all files. ORC packs the ids with its integer run-length encoding; each stripe keeps
row-index statistics and a Bloom filter on ``doc_id``, so that readers take stripes in parallel
and skip those that cannot hold a wanted document (``pick_documents``).
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from seqlab.llm.arrow_text import buffers, list_array, slices
from seqlab.llm.chunk_encoder import ChunkEncoder

#: Chunks given to the tokenizer as one text, which is faster than one at a time.
TOGETHER = 500
SCHEMA = "doc_id long, part int, part_start long, n_tokens long, ids array<int>"


@lru_cache(maxsize=2)
def _encoder(definition: str) -> Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]:
    """Encodes an array of texts: flat ids and the number of ids of each text."""
    tokenizer = Tokenizer.from_str(definition)
    added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    lower_case = '"type":"Lowercase"' in definition.replace(" ", "")

    def encode(chunks: list[str]) -> list[list[int]]:
        return [x for k in range(0, len(chunks), TOGETHER) for x in joined(chunks[k : k + TOGETHER])]

    def joined(chunks: list[str]) -> list[list[int]]:
        found = tokenizer.encode("\n".join(chunks), add_special_tokens=False)
        ids = found.ids
        ends = np.cumsum([len(c) + 1 for c in chunks])
        first = np.fromiter((a for a, _ in found.offsets), np.int64, len(ids))
        cuts = np.searchsorted(first, ends).tolist()
        return [ids[a:b] for a, b in zip([0, *cuts[:-1]], cuts, strict=True)]

    by_chunk = ChunkEncoder(encode)

    def texts_to_ids(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if any(pc.any(pc.match_substring(texts, a)).as_py() for a in added):
            # Added tokens are found before anything else, also across chunks.
            found = tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)
            counts = np.array([len(e.ids) for e in found], np.int64)
            return np.array([i for e in found for i in e.ids], np.int32), counts
        data, offsets = buffers(texts)
        return by_chunk(data, offsets, _lower(data) if lower_case else None)

    return texts_to_ids


def _lower(data: np.ndarray) -> np.ndarray:
    """ASCII letters in lower case, but for those that a combining mark may follow."""
    upper = (data >= 65) & (data <= 90)
    upper[:-1] &= data[1:] < 128
    return data + upper.astype(np.uint8) * np.uint8(32)


def write_tokens(
    documents: DataFrame,
    path: str,
    tokenizer_file: str,
    end_id: int = 2,
    stripe_bytes: int = 32 << 20,
    index_rows: int = 1000,
) -> None:
    """Write the ids of ``documents(doc_id, text)`` as ORC files below ``path``.

    The tokenizer must drop white space or cut before it (as word tokenizers do). ``end_id``
    closes every document. A null text counts as empty, so its row holds the end id alone;
    repeated document ids keep one row each, in the order of their texts; a null id comes
    first. Other columns are ignored. An empty table gives files without rows. Rows:
    ``part`` is the task, ``part_start`` the ids that the task wrote before this document.
    """
    with open(tokenizer_file, encoding="utf-8") as f:
        definition = f.read()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, before = _encoder(definition), TaskContext.get().partitionId(), 0
        for piece, texts in slices(batches):
            ids, counts = encoder(texts)
            ends = np.cumsum(counts + 1)
            closed = np.insert(ids, np.cumsum(counts), end_id)
            starts = before + np.concatenate([[0], ends[:-1]])
            before += int(ends[-1])
            yield pa.RecordBatch.from_arrays(
                [
                    piece.column(0),
                    pa.array(np.full(len(counts), part, np.int32)),
                    pa.array(starts, pa.int64()),
                    pa.array(counts + 1, pa.int64()),
                    list_array(closed, counts + 1, pa.int32()),
                ],
                ["doc_id", "part", "part_start", "n_tokens", "ids"],
            )

    ordered = (
        documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id", "text")
    )
    (
        ordered.mapInArrow(encode, SCHEMA)
        .write.option("compression", "zstd")
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .option("orc.row.index.stride", str(index_rows))
        .option("orc.stripe.size", str(stripe_bytes))
        .orc(path)
    )


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the files with ``start``, the number of ids in all documents before.

    Offsets come from one row per writing task, which is what is broadcast (20 bytes for each
    file, against the many megabytes in it); ids are read once, by stripes, and not shuffled.
    """
    rows = spark.read.schema(SCHEMA).orc(path)
    sums = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_offset"))
    return rows.join(F.broadcast(offsets), "part").select(
        "doc_id", (F.col("part_offset") + F.col("part_start")).alias("start"), "n_tokens", "ids"
    )


def pick_documents(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """Rows of a few documents; stripes are skipped by their statistics and Bloom filters."""
    return spark.read.schema(SCHEMA).orc(path).where(F.col("doc_id").isin(doc_ids))


def with_crc(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the unsigned crc32 of the ids as little-endian 32-bit words."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            at = lists.offsets.to_numpy().astype(np.int64) * 4
            # A view from the first list on: offsets of a slice need not begin at 0.
            raw = memoryview(lists.values.to_numpy(zero_copy_only=False).astype("<u4").tobytes())
            crc = [zlib.crc32(raw[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
            counts = np.diff(at) // 4
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(counts), pa.array(crc, pa.int64())],
                ["doc_id", "start", "n_tokens", "ids_crc32"],
            )

    wanted = tokens.select("doc_id", "start", "n_tokens", "ids")
    return wanted.mapInArrow(digest, "doc_id long, start long, n_tokens long, ids_crc32 long")
