"""Sharding by histogram sort: shards of near-equal bytes from one exchange of the documents.

The key of a document is the hash of its text, then its ``doc_id``: 16 bytes. The splitters between
shards are found without moving a text:

1. A table of keys and sizes is written. In each round it is asked for the exact bytes and rows
   below 256 probes inside the key interval that each open splitter has come down to: a
   ``groupBy`` of one more key byte over the rows of these intervals.
2. A splitter is settled when a probe lies within the tolerance of its target. Otherwise its
   interval becomes the one between the two probes around the target, a 256th of the old one.
3. The rows are exchanged once, by the settled splitters. Finer splitters with a loose tolerance
   cut every shard into parts of about ``part_bytes``, so that the work of a task does not depend
   on the number of shards. The rows below each part are known from the counts, and so are
   the slots of its rows.

Equal texts lie side by side. As probes of the first eight bytes fall between groups of equal
texts, such a group is cut only if it lies across a splitter and is too large for the tolerance; so
at most ``shards - 1`` groups of the whole table are. A group that holds a third of all rows is
cut by ``doc_id`` like anything else.

The driver holds 256 counts for each open splitter, of which there are at most ``MAX_PARTS``.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqlab.session import written

KEY_BYTES = 16
MAX_PARTS = 4096
#: Share of a part's bytes by which the cuts inside a shard may be off.
LOOSE = 0.25
_FLIP = -(1 << 63)  # turns the order of signed numbers into that of their bits
_PREFIX = 12  # bits by which rows find the splitters near them


class Cut(NamedTuple):
    """A splitter: the least 16-byte key after it, and what lies before it."""

    key: int
    size: int
    rows: int


class _Open(NamedTuple):
    """A splitter on its way: the key bytes it has come down to, and what lies before them."""

    target: int
    slack: float
    prefix: int
    size: int
    rows: int


def size_of(text: Column) -> Column:
    """Bytes of a text and one more for its end; null has none."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def _keyed(docs: DataFrame, *more: Column) -> DataFrame:
    return docs.select(
        F.xxhash64("text").alias("hash"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(_FLIP)).alias("number"),
        size_of(F.col("text")).alias("size"),
        *more,
    )


def _top(name: str, n: int) -> Column:
    """The first ``n`` bytes of a key word as a number without sign trouble below 8 bytes."""
    flipped = F.col(name).bitwiseXOR(F.lit(_FLIP))
    return F.shiftrightunsigned(flipped, 64 - 8 * n) if n < 8 else flipped


def _byte(level: int) -> Column:
    word = "hash" if level < 8 else "number"
    return (_top(word, level % 8 + 1).bitwiseAND(F.lit(255))).cast("int")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _counts(keys: DataFrame, level: int, prefixes: list[int]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each prefix of ``level`` bytes: bytes and rows by the byte that follows."""
    rows = keys.withColumn("byte", _byte(level))
    if level:
        # The prefix as up to two numbers, which equal those of the rows in it.
        parts = [("hash", min(level, 8))] + ([("number", level - 8)] if level > 8 else [])
        spec = ", ".join(f"p{k} long" for k in range(len(parts)))
        split = [
            (_signed(p),) if level <= 8 else (_signed(p >> 8 * (level - 8)), _signed(p & ((1 << 8 * (level - 8)) - 1)))
            for p in prefixes
        ]
        wanted = keys.sparkSession.createDataFrame(
            [(i, *s) for i, s in enumerate(split)], f"which int, {spec}"
        )
        for k, (word, n) in enumerate(parts):
            rows = rows.withColumn(f"p{k}", _top(word, n))
        rows = rows.join(F.broadcast(wanted), [f"p{k}" for k in range(len(parts))])
    else:
        rows = rows.withColumn("which", F.lit(0))
    table = rows.groupBy("which", "byte").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).toArrow()
    which, byte = table["which"].to_numpy(), table["byte"].to_numpy()
    out = {p: (np.zeros(256, np.int64), np.zeros(256, np.int64)) for p in prefixes}
    for p, own in zip(prefixes, (np.flatnonzero(which == i) for i in range(len(prefixes)))):
        out[p][0][byte[own]] = table["size"].to_numpy()[own]
        out[p][1][byte[own]] = table["n"].to_numpy()[own]
    return out


def find_cuts(keys: DataFrame, targets: list[int], slacks: list[float]) -> list[Cut]:
    """A cut for each target number of bytes before it, within its slack where keys allow.

    Where all 16 bytes are used up, the nearer side of the last key is taken.
    """
    cuts: dict[int, Cut] = {}
    open_ = {k: _Open(t, s, 0, 0, 0) for k, (t, s) in enumerate(zip(targets, slacks, strict=True))}
    for level in range(KEY_BYTES):
        if not open_:
            break
        counts = _counts(keys, level, sorted({o.prefix for o in open_.values()}))
        shift = 8 * (KEY_BYTES - 1 - level)
        going = {}
        for k, o in open_.items():
            sizes, rows = (np.concatenate([[0], np.cumsum(c)]) for c in counts[o.prefix])
            # The probes around the target: before and after the byte in which it lies.
            byte = min(int(np.searchsorted(sizes[1:], o.target - o.size, "right")), 255)
            ends = [Cut(((o.prefix << 8) + b) << shift, o.size + int(sizes[b]), o.rows + int(rows[b])) for b in (byte, byte + 1)]
            near = min(ends, key=lambda c: abs(c.size - o.target))
            alone = ends[1].rows - ends[0].rows <= 1  # nothing to tell apart between the probes
            if abs(near.size - o.target) <= o.slack or alone or level == KEY_BYTES - 1:
                cuts[k] = near
            else:
                going[k] = o._replace(prefix=(o.prefix << 8) + byte, size=ends[0].size, rows=ends[0].rows)
        open_ = going
    return [cuts[k] for k in range(len(targets))]


def _part_tables(spark, cuts: list[Cut], shards: int, each: int) -> tuple[DataFrame, DataFrame]:
    """Where a row finds its part, by the first bits of its key; and (part, shard, before)."""
    starts = [Cut(0, 0, 0), *cuts]
    near: list[list[tuple[int, int]]] = [[] for _ in range(1 << _PREFIX)]
    first = np.zeros((1 << _PREFIX) + 1, int)
    for c in cuts:
        at = c.key >> (8 * KEY_BYTES - _PREFIX)
        if at < 1 << _PREFIX:
            near[at].append(((c.key >> 64) + _FLIP, (c.key & ((1 << 64) - 1)) + _FLIP))
        first[min(at, 1 << _PREFIX) + 1 :] += 1
    find = [(q, int(first[q]), near[q]) for q in range(1 << _PREFIX)]
    where = [(p, p // each, c.rows - starts[p // each * each].rows) for p, c in enumerate(starts)]
    return (
        spark.createDataFrame(find, "prefix int, first int, cuts array<struct<hash: long, number: long>>"),
        spark.createDataFrame(where, "part int, shard int, before long"),
    )


def shards(docs: DataFrame, n: int = 16, tolerance: float = 0.01, part_bytes: int = 8 << 20) -> DataFrame:
    """Deal documents to shards 0 to n - 1 of near-equal bytes: shard, slot, size, ``doc``.

    ``size`` is the UTF-8 bytes of the text and one more. Every splitter is within ``tolerance``
    of a shard's ideal bytes of its place, or, where a single document is larger than that, at
    the nearer side of it. ``slot`` counts from 0 without gaps in each shard, in the order of
    (hash of the text, ``doc_id``). ``doc`` holds all columns of ``docs``, whatever their names.

    A null text has no bytes and is a group apart from the empty text; a null ``doc_id`` comes
    first among equal texts. Rows that share both text and ``doc_id`` are one unit, which no splitter
    cuts; the order among them is that in which Spark meets them. An empty table gives an empty one. The
    table is read three times and must give the same rows each time.
    """
    spark = docs.sparkSession
    keys = written(_keyed(docs), "shard_keys")
    total = keys.agg(F.sum("size")).first()[0] or 0
    each = max(1, min(MAX_PARTS // n, -(-total // (n * part_bytes))))
    steps = range(1, n * each)
    slacks = [tolerance * total / n if k % each == 0 else LOOSE * total / (n * each) for k in steps]
    cuts = find_cuts(keys, [total * k // (n * each) for k in steps], slacks)
    # Loose cuts stay between the shard bounds around them.
    for k in steps:
        low, high = k // each * each, (k // each + 1) * each
        if k % each:
            least = cuts[low - 1] if low else Cut(0, 0, 0)
            before = cuts[k - 2] if k - 1 > low else least
            cut = max(cuts[k - 1], before)
            cuts[k - 1] = min(cut, cuts[high - 1]) if high < n * each else cut
    find, where = _part_tables(spark, cuts, n, each)
    rows = _keyed(docs, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    prefix = F.shiftrightunsigned(_top("hash", 8), 64 - _PREFIX).cast("int")
    found = rows.withColumn("prefix", prefix).join(F.broadcast(find), "prefix")
    own = F.struct("hash", "number")
    part = F.col("first") + F.size(F.filter("cuts", lambda c: c <= own))
    placed = found.select("doc", "hash", "number", "size", part.alias("part"))
    order = W.partitionBy("part").orderBy("hash", "number")
    numbered = placed.withColumn("nth", F.row_number().over(order) - 1)
    slot = (F.col("nth") + F.col("before")).alias("slot")
    return numbered.join(F.broadcast(where), "part").select("shard", slot, "size", "doc")


def write_shards(docs: DataFrame, path: str, n: int = 16, **settings) -> None:
    """One folder ``shard=k`` per shard with the documents, their ``slot`` and ``size``; a part is
    one file, in the order of its slots. Columns of ``docs`` with these names stay inside ``doc``."""
    placed = shards(docs, n, **settings)
    placed.write.mode("overwrite").partitionBy("shard").parquet(path)
