"""Counts of word grams that move between tasks in packed messages.

A row of three words takes 35 bytes and more in a shuffle. Here a task counts the grams of its piece of the corpus and
sends one message per bucket of grams: the distinct words of the message once, then numbers in columns, compressed.
That is 8 bytes a gram and less. Grams are dealt to buckets by all their words, so that no word or pair is hot.

Words compare by their bytes; null is a value of its own.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Buckets that grams are dealt to, at least; and rows that a task counts before it sends them.
BUCKETS = 512
HELD = 3_000_000
#: Of the compression of messages.
LEVEL = 6
#: Rows of a batch that goes back to Spark.
BATCH = 1 << 16
MESSAGES = "bucket int, message binary"
MESSAGE_NAMES = ["bucket", "message"]
#: Bytes of messages that are opened together where a bucket is read in parts: some 50 times as much in memory.
OPENED = 16 << 20


def n_buckets(spark: SparkSession) -> int:
    return max(BUCKETS, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))


def zipped(arrays: Iterable[np.ndarray]) -> bytes:
    """Arrays of numbers that are not negative, each in its smallest type."""
    arrays = [a.astype(np.min_scalar_type(int(a.max())) if len(a) else np.uint8) for a in arrays]
    head = np.array([len(arrays), *(x for a in arrays for x in (a.itemsize, len(a)))], np.uint32)
    body = b"".join([head.tobytes(), *(a.tobytes() for a in arrays)])
    return len(body).to_bytes(4, "little") + pa.Codec("zstd", compression_level=LEVEL).compress(body, asbytes=True)


def unzipped(message: bytes) -> list[np.ndarray]:
    body = pa.decompress(message[4:], int.from_bytes(message[:4], "little"), codec="zstd", asbytes=True)
    n = int(np.frombuffer(body, np.uint32, 1)[0])
    at, out = 4 + 8 * n, []
    for size, length in np.frombuffer(body, np.uint32, 2 * n, 4).reshape(-1, 2).tolist():
        out.append(np.frombuffer(body, f"<u{size}", length, at))
        at += size * length
    return out


def coded(words: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The distinct words in byte order with a null behind them, and the place of each given word among them."""
    found = words.dictionary_encode()
    order = pc.sort_indices(found.dictionary)
    n = len(order)
    rank = np.empty(n + 1, np.int64)
    rank[order.to_numpy()] = np.arange(n)
    rank[n] = n
    distinct = pa.concat_arrays([found.dictionary.take(order), pa.nulls(1, found.dictionary.type)])
    return distinct, rank[found.indices.fill_null(n).to_numpy()]


def _spelled(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Byte lengths plus one (0: null) and the bytes of words."""
    text = words.fill_null("")
    ends = np.frombuffer(text.buffers()[1], np.int32, len(text) + 1, 4 * text.offset) if len(text) else np.zeros(1, np.int32)
    letters = text.buffers()[2]
    letters = np.frombuffer(letters, np.uint8)[ends[0] : ends[-1]] if letters is not None else np.zeros(0, np.uint8)
    return np.where(words.is_null().to_numpy(zero_copy_only=False), 0, np.diff(ends) + 1), letters


def _read(sizes: np.ndarray, letters: np.ndarray) -> pa.Array:
    ends = np.cumsum(np.maximum(sizes.astype(np.int64), 1) - 1)
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    words = pa.StringArray.from_buffers(len(sizes), pa.py_buffer(offsets.tobytes()), pa.py_buffer(letters.tobytes()))
    return pc.if_else(pa.array(sizes > 0), words, pa.scalar(None, pa.string()))


def hashes(words: pa.Array) -> np.ndarray:
    return pd.util.hash_array(words.fill_null("").to_numpy(zero_copy_only=False), categorize=False)


def numbered(columns: list[np.ndarray], base: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each distinct row of the columns is first met, in their order, and the number of each row among these."""
    key = columns[0] if columns else np.zeros(length, np.int64)
    for c in columns[1:-1]:
        key = np.unique(key * base + c, return_inverse=True)[1]
    if len(columns) > 1:
        key = key * base + columns[-1]
    _, first, inverse = np.unique(key, return_index=True, return_inverse=True)
    return first, inverse


def sums(inverse: np.ndarray, values: np.ndarray, length: int) -> np.ndarray:
    return np.bincount(inverse, weights=values, minlength=length).astype(np.int64)


def dealt(hashed: np.ndarray, columns: list[np.ndarray], buckets: int, length: int) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, places) of the rows of the columns of word numbers, in the order of the rows."""
    x = np.zeros(length, np.uint64)
    for c in columns:
        x = (x ^ hashed[c]) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
    yield from grouped((x >> np.uint64(20)) % np.uint64(buckets))


def grouped(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each bucket with its places, which keep their order."""
    bucket = bucket.astype(np.uint32)
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    for places in np.split(order, cuts):
        if len(places):
            yield int(bucket[places[0]]), places


def message(words: pa.Array, columns: list[np.ndarray], values: list[np.ndarray], of_words: Iterable[np.ndarray] = ()) -> bytes:
    """Rows of word numbers, in their order, with their ``values``; ``of_words`` are values of words, given for all of them.

    Of the first word, which does not fall, the steps are sent."""
    if columns:
        used, local = np.unique(np.concatenate(columns), return_inverse=True)
    else:
        used = local = np.zeros(0, np.int64)
    rows = np.split(local, len(columns)) if columns else []
    rows[:1] = [np.diff(r, prepend=0) for r in rows[:1]]
    return zipped([*_spelled(words.take(pa.array(used))), *(v[used] for v in of_words), *rows, *values])


class Opened:
    """Messages read together: ``words``, ``columns`` of word numbers, ``of_words`` and ``values``; ``ends`` of the messages."""

    def __init__(self, messages: list[bytes], n_columns: int, n_of_words: int = 0) -> None:
        parts = [unzipped(m) for m in messages]
        sizes = np.concatenate([p[0] for p in parts])
        self.words, codes = coded(_read(sizes, np.concatenate([p[1] for p in parts])))
        shift = np.cumsum([0, *(len(p[0]) for p in parts)])
        at = 2 + n_of_words
        self.columns = []
        for i in range(at, at + n_columns):
            given = [np.cumsum(p[i], dtype=np.int64) if i == at else p[i].astype(np.int64) for p in parts]
            self.columns.append(codes[np.concatenate([g + s for g, s in zip(given, shift)])])
        self.of_words = []
        for i in range(2, at):
            given = np.concatenate([p[i] for p in parts]).astype(np.int64)
            found = np.zeros(len(self.words), np.int64)
            found[codes[given > 0]] = given[given > 0]
            self.of_words.append(found)
        at += n_columns
        self.values = [np.concatenate([p[i] for p in parts]).astype(np.int64) for i in range(at, len(parts[0]))]
        self.ends = np.cumsum([len(p[at]) for p in parts])
        self.length = int(self.ends[-1])

    def numbered(self) -> tuple[np.ndarray, np.ndarray]:
        return numbered(self.columns, len(self.words), self.length)


def in_batches(table: pa.Table) -> pa.Table:
    """The same rows in batches that Spark takes one by one."""
    return pa.concat_tables([table.slice(i, BATCH) for i in range(0, max(len(table), 1), BATCH)])


def message_batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    types = [pa.int32()] * (len(names) - 1) + [pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(names), types)], names)


def counted(columns: list[np.ndarray], values: np.ndarray, words: pa.Array, buckets: int) -> pa.RecordBatch:
    """Messages of the distinct rows with the sums of their values."""
    first, inverse = numbered(columns, len(words), len(values))
    total, rows = sums(inverse, values, len(first)), [c[first] for c in columns]
    hashed = hashes(words)
    out = [
        (b, message(words, [c[at] for c in rows], [total[at]])) for b, at in dealt(hashed, rows, buckets, len(first))
    ]
    return message_batch(out, MESSAGE_NAMES)


def merged(messages: DataFrame, keys: list[str], out: str = "n") -> DataFrame:
    """Distinct rows of ``keys`` over all messages, with their sum."""

    def merge(table: pa.Table) -> pa.Table:
        got = Opened(table["message"].to_pylist(), len(keys))
        first, inverse = got.numbered()
        found = [got.words.take(pa.array(c[first])) for c in got.columns]
        return in_batches(pa.table([*found, pa.array(sums(inverse, got.values[0], len(first)))], [*keys, out]))

    return messages.groupBy("bucket").applyInArrow(merge, ", ".join(f"{k} string" for k in keys) + f", {out} long")


def summed(rows: DataFrame, keys: list[str], n: str = "n") -> DataFrame:
    """The sum of whole numbers ``n``, none below 0, per ``keys``, which are texts."""
    buckets = n_buckets(rows.sparkSession)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _gathered(batches, lambda b: b.num_rows):
            table = pa.Table.from_batches(held)
            flat = pa.concat_arrays([c for k in keys for c in table[k].chunks])
            words, codes = coded(flat)
            values = table[n].combine_chunks().to_numpy(zero_copy_only=False)
            yield counted(np.split(codes, len(keys)), values, words, buckets)

    return merged(rows.select(*keys, n).mapInArrow(send, MESSAGES), keys, n)


def _gathered(batches: Iterable[pa.RecordBatch], size) -> Iterator[list[pa.RecordBatch]]:
    """The batches in lists that hold some ``HELD`` rows."""
    held, rows = [], 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            rows += size(b)
        if rows >= HELD:
            yield held
            held, rows = [], 0
    if held:
        yield held


class Grams:
    """The words of some sentences with two paddings before and a stop behind, as numbers: row i is (w1, w2, w3)."""

    def __init__(self, sentences: pa.Array, begin: str, stop: str) -> None:
        """``sentences``: lists of words, none null."""
        flat = pa.concat_arrays([sentences.flatten(), pa.array([begin, stop], pa.string())])
        self.words, codes = coded(flat)
        first, last = int(codes[-2]), int(codes[-1])
        size = pc.list_value_length(sentences).to_numpy(zero_copy_only=False).astype(np.int64)
        self.sentence = np.repeat(np.arange(len(size)), size + 1)
        start = np.cumsum(size + 1) - (size + 1)
        w3 = np.full(len(self.sentence), last, np.int64)
        w3[np.arange(len(codes) - 2) + np.repeat(np.arange(len(size)), size)] = codes[:-2]
        w2, w1 = np.empty_like(w3), np.empty_like(w3)
        w2[1:], w1[2:] = w3[:-1], w3[:-2]
        w2[start] = w1[start] = w1[start[size > 0] + 1] = first
        self.w1, self.w2, self.w3, self.first = w1, w2, w3, first


def trigram_messages(sentences: DataFrame, begin: str, stop: str) -> DataFrame:
    buckets = n_buckets(sentences.sparkSession)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _gathered(batches, lambda b: len(b.column(0).flatten())):
            g = Grams(pa.concat_arrays([b.column(0) for b in held]), begin, stop)
            yield counted([g.w1, g.w2, g.w3], np.ones(len(g.w3)), g.words, buckets)

    return sentences.select("words").where("words IS NOT NULL").mapInArrow(send, MESSAGES)



def shares(rows: DataFrame, context: list[str], word: str, n: str, out: str) -> DataFrame:
    """Add to rows of texts ``context`` and ``word`` the share of ``n`` in the sum of their context; null if a text of it is.

    Rows meet in buckets of their contexts. A bucket keeps its messages as they came and opens a few at a time, once
    for the totals and once for the rows, so that a context with very many words takes no more memory than these.
    """
    buckets, keys = n_buckets(rows.sparkSession), [*context, word]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _gathered(batches, lambda b: b.num_rows):
            table = pa.Table.from_batches(held)
            words, codes = coded(pa.concat_arrays([c for k in keys for c in table[k].chunks]))
            columns = np.split(codes, len(keys))
            order = np.lexsort(columns[::-1])
            columns, values = [c[order] for c in columns], table[n].combine_chunks().to_numpy()[order]
            parts = dealt(hashes(words), columns[:-1], buckets, len(order))
            yield message_batch([(b, message(words, [c[at] for c in columns], [values[at]])) for b, at in parts], MESSAGE_NAMES)

    def share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        messages = [m for b in batches for m in b["message"].to_pylist()]
        bytes_before = np.cumsum([0, *map(len, messages)])[:-1]
        some = [list(x) for x in np.split(np.array(messages, object), np.flatnonzero(np.diff(bytes_before // OPENED)) + 1)]
        totals = []
        for part in some:
            got = Opened(part, len(keys))
            first, inverse = numbered(got.columns[:-1], len(got.words), got.length)
            total = sums(inverse, got.values[0], len(first))
            totals.append(message(got.words, [c[first] for c in got.columns[:-1]], [total]))
        every = Opened(totals, len(context))
        first, inverse = every.numbered()
        found = np.split(sums(inverse, every.values[0], len(first))[inverse], every.ends[:-1])
        for part, total in zip(some, found):
            got = Opened(part, len(keys))
            _, inverse = numbered(got.columns[:-1], len(got.words), got.length)
            null = np.any([c == len(got.words) - 1 for c in got.columns[:-1]], axis=0)
            texts, values = [got.words.take(pa.array(c)) for c in got.columns], got.values[0]
            shared = pa.array(values / total[inverse], pa.float64(), mask=null)
            yield from pa.table([*texts, pa.array(values), shared], [*keys, n, out]).to_batches(max_chunksize=BATCH)

    sent = rows.select(*keys, n).mapInArrow(send, MESSAGES)
    schema = ", ".join(f"{k} string" for k in keys) + f", {n} long, {out} double"
    return sent.groupBy("bucket").applyInArrow(share, schema)


def paired(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Full join on ``keys``, which are whole numbers; all other columns are texts. Rows that repeat meet one another.

    Both sides are dealt to buckets by the keys but the last, and a null key meets nothing.
    """
    buckets = n_buckets(left.sparkSession)

    def sender(texts: list[str]):
        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for held in _gathered(batches, lambda b: b.num_rows):
                table = pa.Table.from_batches(held)
                nulls = [table[k].is_null().to_numpy() for k in keys]
                numbers = [table[k].fill_null(0).to_numpy().astype(np.int64) for k in keys]
                words, codes = coded(pa.concat_arrays([c for t in texts for c in table[t].chunks]))
                codes = np.split(codes, len(texts))
                # Neighbours compress best side by side. Most rows come so.
                if np.all([np.diff(c) == 0 for c in numbers[:-1]], axis=0).sum() < len(numbers[0]) / 2:
                    order = np.lexsort(numbers[::-1])
                    numbers, nulls, codes = ([c[order] for c in x] for x in (numbers, nulls, codes))
                # Two's complement, so that no number is negative.
                columns = [c.view(np.uint64) for c in numbers]
                x = np.zeros(len(columns[0]), np.uint64)
                for c in columns[:-1]:
                    x = (x ^ c) * np.uint64(0x9E3779B97F4A7C15)
                    x ^= x >> np.uint64(29)
                out = []
                for b, at in grouped((x >> np.uint64(20)) % np.uint64(buckets)):
                    used, local = np.unique(np.concatenate([c[at] for c in codes]), return_inverse=True)
                    arrays = [*(c[at] for c in columns), *(n[at] for n in nulls), *np.split(local, len(codes))]
                    out.append((b, zipped([*_spelled(words.take(pa.array(used))), *arrays])))
                yield message_batch(out, MESSAGE_NAMES)

        return send

    def opened(table: pa.Table, texts: list[str]) -> pa.Table:
        got = [pa.table([*([pa.array([], pa.int64())] * len(keys)), *([pa.array([], pa.string())] * len(texts))], [*keys, *texts])]
        for m in table["message"].to_pylist():
            sizes, letters, *rest = unzipped(m)
            k, words = len(keys), _read(sizes, letters)
            numbers = [pa.array(c.astype(np.uint64).view(np.int64), mask=n.astype(bool)) for c, n in zip(rest[:k], rest[k : 2 * k])]
            got.append(pa.table([*numbers, *(words.take(pa.array(c)) for c in rest[2 * k :])], [*keys, *texts]))
        return pa.concat_tables(got)

    sides = [(df, [c for c in df.columns if c not in keys]) for df in (left, right)]
    (_, a), (_, b) = sides
    types = {k: left.schema[k].dataType.simpleString() for k in keys}

    def join(mine: pa.Table, other: pa.Table) -> pa.Table:
        met = opened(mine, a).join(opened(other, b), keys, join_type="full outer").select([*keys, *a, *b])
        arrow = {"int": pa.int32(), "bigint": pa.int64()}
        return in_batches(pa.table([*(met[k].cast(arrow[types[k]]) for k in keys), *(met[c] for c in (*a, *b))], met.column_names))

    sent = [df.select(*keys, *texts).mapInArrow(sender(texts), MESSAGES).groupBy("bucket") for df, texts in sides]
    schema = ", ".join([*(f"{k} {types[k]}" for k in keys), *(f"{c} string" for c in (*a, *b))])
    return sent[0].cogroup(sent[1]).applyInArrow(join, schema)
