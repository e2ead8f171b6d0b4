"""Spelling variants: words one edit apart, found by asymmetric q-chunks.

Of two words one edit apart, the shorter one is cut into two disjoint chunks; the other gives the
positional grams of the same lengths. One edit changes at most one of the chunks, so the other stands
in the longer word unchanged, at its place or shifted by the difference in length, which is at most
one. Words of equal length take both parts. Chunks and grams are joined, and what meets is verified.

A chunk that many words share, such as a common ending, would compare all of them with each other.
Where more pairs would meet than ``PAIRS_EACH`` for each word that
has the chunk, the part beside the chunk, in which the edit must lie, is cut
into two chunks again, and only words that agree in one of these meet, and so on. When one letter
is left, a group has no more members than there are letters for one place, so the pairs of a group are
bounded at every size of the table, and none is dropped.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqlab.llm.arrow_text import buffers, gather, slices
from seqlab.session import written

#: A run loses a letter when this number divides the checksum of its document and itself.
ONE_IN = 97
#: Chunks and grams that share a key meet when their pairs are no more than this for each of them.
PAIRS_EACH = 4
#: Longest run in bytes whose checksum is put together from tables.
TABLED = 96


@lru_cache(maxsize=1)
def _shifts() -> np.ndarray:
    """What a crc32 becomes when n zero bytes follow, for each value of each of its four bytes."""
    byte = np.arange(256, dtype=np.uint32)
    step = byte.copy()
    for _ in range(8):
        step = np.where(step & 1, (step >> 1) ^ np.uint32(0xEDB88320), step >> 1)
    now = np.stack([byte << np.uint32(8 * k) for k in range(4)])
    out = [now]
    for _ in range(TABLED):
        now = (now >> np.uint32(8)) ^ step[now & np.uint32(255)]
        out.append(now)
    return np.stack(out)


def joined_crc(first: np.ndarray, second: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The crc32 of two texts in a row from theirs and the bytes of the second, up to ``TABLED``."""
    tables, out = _shifts(), second.copy()
    for k in range(4):
        out ^= tables[length, k, (first >> np.uint32(8 * k)) & np.uint32(255)]
    return out


def _runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of letters, and how many bytes before each place lead a letter of two.

    Letters are A-Z, a-z and U+00C0 to U+00FF, which in UTF-8 are 0xC3 and a byte that follows.
    """
    lead = data == 0xC3
    inside = lead | ((data >= 97) & (data <= 122)) | ((data >= 65) & (data <= 90))
    inside[1:] |= lead[:-1]
    fresh = np.ones(len(data) + 1, bool)
    fresh[1:-1] = ~inside[:-1]
    fresh[offsets] = True
    starts = np.flatnonzero(inside & fresh[:-1])
    ends = np.flatnonzero(inside & (np.append(~inside[1:], True) | fresh[1:])) + 1
    leads = np.zeros(len(data) + 1, np.int64)
    np.cumsum(lead, out=leads[1:])
    return starts, ends, leads


def _word_rows(min_length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, texts in slices(batches):
            data, offsets = buffers(texts)
            if not len(data):
                continue
            data = data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)
            starts, ends, leads = _runs(data, offsets)
            long = ends - starts - (leads[ends] - leads[starts]) >= min_length
            starts, ends = starts[long], ends[long]
            text = np.searchsorted(offsets, starts, "right") - 1
            length = ends - starts
            flat = data[gather(starts, length)]
            bounds = np.zeros(len(starts) + 1, np.int32)
            np.cumsum(length, out=bounds[1:])
            runs = pa.StringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(flat)).dictionary_encode()
            which, words = runs.indices.to_numpy(), runs.dictionary
            raw = [w.encode() for w in words.to_pylist()]
            own = np.fromiter(map(zlib.crc32, raw), np.uint32, len(raw))
            named = ["" if d is None else str(d) for d in piece.column(0).to_pylist()]
            before = np.array([zlib.crc32(f"{d}:".encode()) for d in named], np.uint32)
            h = np.zeros(len(which), np.uint32)
            short = length <= TABLED
            h[short] = joined_crc(before[text[short]], own[which[short]], length[short])
            for k in np.flatnonzero(~short):
                h[k] = zlib.crc32(raw[which[k]], int(before[text[k]]))
            hit = h % ONE_IN == 0
            counts = np.bincount(which[~hit], minlength=len(raw))
            altered = []
            for k in np.flatnonzero(hit):
                word = raw[which[k]].decode()
                at = int(h[k]) % len(word)
                altered.append(word[:at] + word[at + 1 :])
            kept = pa.array(np.flatnonzero(counts))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays([words.take(kept), pa.array(altered, pa.string())]),
                    pa.array(np.concatenate([counts[counts > 0], np.ones(len(altered), np.int64)]), pa.int64()),
                ],
                ["word", "n"],
            )

    return run


def words(docs: DataFrame, min_length: int = 5, min_count: int = 3) -> DataFrame:
    """(word, n): the words of all texts with at least these many code points and occurrences.

    A word is a maximal run of letters ``[A-Za-z\\u00C0-\\u00FF]`` with A-Z in lower case. Where the crc32 of
    ``<doc_id>:<run>`` is a multiple of ``ONE_IN``, the run loses the code point at crc32 modulo
    its length. A null text has no words, a null ``doc_id`` counts as the empty string, and repeated
    rows count again. Other columns are ignored; an empty table has no words.
    """
    rows = docs.select("doc_id", "text").mapInArrow(_word_rows(min_length), "word string, n long")
    counts = rows.groupBy("word").agg(F.sum("n").alias("n"))
    return counts.where((F.length("word") >= min_length) & (F.col("n") >= min_count))


def _piece(low: Column, high: Column) -> Column:
    return F.substring("word", low + 1, high - low)


def _cut(rows: DataFrame, shift: Column) -> DataFrame:
    """Cut the open part, in which the edit lies, in two: one row with each of the chunks in its key.

    ``low`` and ``high`` bound the open part in the word that gives chunks. In the other word what
    follows the edit lies ``shift`` places on.
    """
    low, high = F.col("low"), F.col("high")
    middle = F.floor((low + high) / 2).cast("int")
    sides = F.array(
        F.struct(F.concat("key", F.lit("1"), _piece(low, middle)).alias("key"), middle.alias("low"), high.alias("high")),
        F.struct(
            F.concat("key", F.lit("2"), _piece(middle + shift, high + shift)).alias("key"),
            low.alias("low"), middle.alias("high"),
        ),
    )
    return rows.select("word", "length", "more", F.inline(sides))


def near_pairs(table: DataFrame) -> DataFrame:
    """(a, b): each pair of different words of ``table(word)`` one edit apart, once.

    One edit inserts, deletes or replaces one code point. ``b`` is the longer word, or the later one. Words
    are distinct and not null; keys tell chunks apart by digits, so words hold none.
    """
    size = F.length("word").alias("length")
    start = table.select("word", size, F.lit(0).alias("low"), F.length("word").alias("high"), F.lit("").alias("key"))
    chunks = start.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("more"))
    grams = chunks.withColumn("length", F.col("length") - F.col("more")).withColumn("high", F.col("length"))
    found = None
    while True:
        # `more` letters: what the gram side has above the chunk side. `length` is the chunk side's.
        same = ["length", "more", "key", "low", "high"]
        left = written(_cut(chunks, F.lit(0)), "chunks")
        right = written(_cut(grams.where("length > 0"), F.col("more")), "grams")
        held = left.groupBy(same).agg(F.count(F.lit(1)).alias("n_chunks")).join(
            right.groupBy(same).agg(F.count(F.lit(1)).alias("n_grams")), same
        )
        many = f"n_chunks * n_grams > {PAIRS_EACH} * (n_chunks + n_grams)"
        crowded = held.where(f"{many} AND high - low > 1").select(same)
        crowded = written(crowded, "crowded")
        pairs = left.join(crowded, same, "left_anti").withColumnRenamed("word", "a").join(
            right.join(crowded, same, "left_anti").withColumnRenamed("word", "b"), same
        )
        pairs = pairs.where("more = 1 OR a < b").where(F.levenshtein("a", "b", 1) == 1).select("a", "b")
        pairs = written(pairs, "near")
        found = pairs if found is None else found.union(pairs)
        if crowded.isEmpty():
            return found.distinct()
        chunks = left.join(crowded, same, "left_semi")
        grams = right.join(crowded, same, "left_semi")


def group(table: DataFrame) -> DataFrame:
    """(word, n, n_near, form, form_n, root) for each row of ``table(word, n)``.

    ``n_near``: how many words are one edit apart. ``form``: the near word of the largest n, the first
    in code-point order on ties, if that is at least twice the word's own n; else null, as is ``form_n``.
    ``root``: the last word on the way from form to form; n doubles at each step, so the way ends.
    """
    table = written(table.select("word", "n"), "words")
    pairs = written(near_pairs(table), "pairs")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near")).union(
        pairs.select(F.col("b").alias("word"), F.col("a").alias("near"))
    )
    counted = both.join(table.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = counted.groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), "near")).alias("best")
    )
    rows = table.join(best, "word", "left")
    is_form = -F.col("best.minus") >= 2 * F.col("n")
    rows = written(
        rows.select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(is_form, F.col("best.near")).alias("form"),
            F.when(is_form, -F.col("best.minus")).cast("long").alias("form_n"),
        ),
        "forms",
    )
    way = rows.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:  # each round doubles the steps that `root` is ahead
        further = way.select(F.col("word").alias("root"), F.col("root").alias("next"))
        way = written(way.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), "next"), "ways")
        if way.where("next IS NOT NULL").isEmpty():
            break
        way = way.select("word", "root")
    return rows.join(way.select("word", "root"), "word", "left").withColumn("root", F.coalesce("root", "word"))
