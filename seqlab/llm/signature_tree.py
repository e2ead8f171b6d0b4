"""n-gram Jaccard join with signature trees.

Documents are sets of hashed word shingles; two link when the intersection is at least a share
of the union. The result is the components of the links: links are neither listed nor counted, and
pairs that are connected already are not compared. No link between components is lost and no group is
spelled out in pairs:

1. Equal sets are one class, named by its smallest document.
2. *Routing.* Sizes fall into classes so wide that only sets of the same or neighbouring classes
   can link. For each pair of classes the hash range is cut into more segments than two linked
   sets can differ in; so at least one segment of theirs is equal and not empty (sets with unusually
   many empty segments send those too). Blocks of equal segments give candidate edges, of which
   each task keeps a spanning forest, and the candidate groups are their components.
3. *Trees.* A candidate group is cut into leaves of bounded size by size class and salt. A task
   gets two leaves and builds one signature tree: rows in the order of their sizes, nodes with
   OR-combined bitmaps and size ranges. The dual traversal starts at (root, root) and drops a pair
   of nodes when the largest overlap that bitmaps and sizes allow is too small, or when all
   its rows are connected already; what remains is compared exactly.
4. First only neighbouring leaves meet, so that a huge group of near copies costs a chain of
   leaves, not their square. In candidate groups of several leaves that hang apart by then, sets are put in
   the order of how rare their shingles are. Sets that link share one of their first shingles, so the
   holders of each of these meet next, where they are not connected and sizes allow it. What all members of a group have in
   common comes last in that order, and members that differ in more than a link allows do not reach it: a
   group that hangs together by a passage that all share is never compared pair by pair.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil, exp, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqlab.llm.arrow_text import (
    buffers,
    gather,
    list_array,
    mix,
    slices,
    window_hashes,
    word_bounds,
    word_hashes,
)
from seqlab.llm.components import Forest, components
from seqlab.llm.lz_dedup import block_count, by_block, first_of, flat
from seqlab.session import discard, written

#: Most sets and most shingles of a leaf, and children of a node of the tree.
LEAF = 256
LEAF_SHINGLES = 1 << 20
FAN = 8
#: Bits for each shingle of the largest set, so that nodes of unlike sets stay sparse, and the
#: widest bitmap; where several shingles share a bit, the bound allows for it.
SPREAD = 64
BITS = 1 << 16
#: Cells for each shingle in the table of their counts, the most of all, and those of a block. The table is broadcast;
#: where shingles share a cell, some pass for more frequent than they are.
CELLS = 4
MOST_CELLS = 1 << 24
CELL_BLOCK = 1 << 16


class Sizes:
    """Size classes and segment numbers for a threshold of ``percent`` in a hundred."""

    def __init__(self, percent: int) -> None:
        self.percent = percent
        bounds = [1]
        while bounds[-1] < 1 << 40:
            bounds.append(bounds[-1] * 100 // percent + 1)
        self.bounds = np.array(bounds, np.int64)
        self.segments, self.spare = [], []
        for c in range(len(bounds) - 1):
            differ = 2 * (bounds[c + 1] - 1) * (100 - percent) // (100 + percent)
            smallest, spare = bounds[max(c - 1, 0)], 0
            while True:
                m = differ + 1 + spare
                empty = m * exp(-smallest / m)
                needed = ceil(empty + 6 * sqrt(empty)) if differ else 0
                if needed <= spare or spare > differ:
                    break
                spare = min(needed, 2 * spare + 4)
            self.segments.append(differ + 1 + spare)
            self.spare.append(spare)

    def of(self, n: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bounds, n, "right") - 1

    def least_overlap(self, a: int, b: int) -> int:
        """Smallest intersection with which sets of these sizes link."""
        return -((a + b) * -self.percent // (100 + self.percent))


def _sets(texts: pa.Array, n_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, sorted within each, the text of each, and counts."""
    data, offsets = buffers(texts)
    lower = (data >= 65) & (data <= 90)
    data = data + lower.astype(np.uint8) * np.uint8(32)
    starts, ends, counts = word_bounds(data, offsets)
    words = word_hashes(data, starts, ends)
    first = np.cumsum(counts) - counts
    per_text = np.maximum(counts - n_words + 1, 0)
    at, text = gather(first, per_text), np.repeat(np.arange(len(counts)), per_text)
    hashes = window_hashes(words, n_words)[at] if len(at) else np.zeros(0, np.uint64)
    for size in range(1, n_words):  # a text with fewer words is one shingle
        short = np.flatnonzero(counts == size)
        if len(short):
            hashes = np.concatenate([hashes, window_hashes(words, size)[first[short]]])
            text = np.concatenate([text, short])
    order = np.lexsort((hashes, text))
    hashes, text = hashes[order], text[order]
    fresh = np.ones(len(hashes), bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
    hashes, text = hashes[fresh], text[fresh]
    return hashes, text, np.bincount(text, minlength=len(counts))


def _digest(hashes: np.ndarray, text: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Two sums of mixed hashes: equal for equal sets."""
    out = []
    for seed in (0x51ED270B27B4F3CF, 0x2545F4914F6CDD1D):
        total = np.zeros(n, np.uint64)
        np.add.at(total, text, mix(hashes ^ np.uint64(seed)))
        out.append(total.view(np.int64))
    return out[0], out[1]


def shingle_sets(docs: DataFrame, n_words: int) -> DataFrame:
    """doc_id, n_shingles and a 128-bit digest (d1, d2) of the set, for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, texts in slices(batches):
            hashes, text, counts = _sets(texts, n_words)
            d1, d2 = _digest(hashes, text, len(counts))
            columns = [piece.column(0), *(pa.array(x, pa.int64()) for x in (counts, d1, d2))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "d1", "d2"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, d1 long, d2 long")


def _own_sets(
    piece: pa.RecordBatch, texts: pa.Array, n_words: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As :func:`_sets`, of the texts whose digest is among those listed in column 2."""
    hashes, text, counts = _sets(texts, n_words)
    d1, d2 = _digest(hashes, text, len(counts))
    wanted = piece.column(2)
    listed, at = wanted.values, wanted.offsets.to_numpy()
    w1, w2 = (listed.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
    keep = np.array(
        [bool(((w1[a:b] == x) & (w2[a:b] == y)).any()) for a, b, x, y in zip(at[:-1], at[1:], d1, d2, strict=True)],
        bool,
    )
    chosen = keep[text]
    return hashes[chosen], text[chosen], np.where(keep, counts, 0)


def _with_wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield batch.filter(batch.column(2).is_valid())


# Routing


def segment_keys(
    hashes: np.ndarray, text: np.ndarray, counts: np.ndarray, sizes: Sizes
) -> tuple[np.ndarray, np.ndarray]:
    """(key, text) of every segment to send, for the class of the text and the next one."""
    keys, owners = [], []
    own = np.zeros(len(counts), np.int64)
    own[counts > 0] = sizes.of(counts[counts > 0])
    segments, spare = np.array(sizes.segments), np.array(sizes.spare)
    filled = counts > 0
    for step in (0, 1):
        classes = own + step
        m = np.where(filled, segments[classes], 0)
        base = np.cumsum(m) - m
        place = (hashes >> np.uint64(32)) * m[text].astype(np.uint64) >> np.uint64(32)
        at = base[text] + place.astype(np.int64)
        total = np.zeros(int(m.sum()), np.uint64)
        np.add.at(total, at, mix(hashes))
        held = np.zeros(len(total), bool)
        held[at] = True
        of = np.repeat(np.arange(len(counts)), m)
        number = np.arange(len(total)) - base[of]
        empty = np.bincount(of[~held], minlength=len(counts))
        send = held | (empty > spare[classes])[of]
        tag = mix((classes[of] * (1 << 32) + number).astype(np.uint64) + np.uint64(77))
        keys.append(mix(total + tag)[send])
        owners.append(of[send])
    return np.concatenate(keys), np.concatenate(owners)


def _segment_rows(n_words: int, percent: int, blocks: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = Sizes(percent)
        for piece, texts in slices(batches):
            keys, text = segment_keys(*_sets(texts, n_words), sizes)
            if not len(keys):
                continue
            ids = piece.column(0).to_numpy().astype(np.int64)
            order, first, run_of = first_of(keys)
            sent = np.sort(order[first])  # in the order of the texts, so that ids pack well
            block = (keys[sent] % np.uint64(blocks)).astype(np.int64)
            high = (keys[sent] >> np.uint64(32)).astype(np.uint32).view(np.int32)
            low = (keys[sent] >> np.uint64(16)).astype(np.uint16).view(np.int16)
            columns = [(high, pa.int32()), (low, pa.int16()), (ids[text[sent]], pa.int64())]
            yield pa.RecordBatch.from_arrays(by_block(block, columns), names)
            # Equal segments within the slice: a forest of candidate edges, past the blocks.
            a, b = _forest(ids[text[order]], run_of)
            if len(a):
                block, nothing = np.repeat(-1 - b % blocks, 2), np.zeros(2 * len(a), np.int16)
                ends = np.stack([a, b], axis=1).ravel()
                columns = [(nothing, pa.int32()), (nothing, pa.int16()), (ends, pa.int64())]
                yield pa.RecordBatch.from_arrays(by_block(block, columns), names)

    names = ["block", "high", "low", "doc"]
    return run


#: Segments as blocks get them: 48 bits of the key, of which the block says some more. Unequal
#: segments that agree in these make a candidate that the trees refuse.
SEGMENTS = "block int, high array<int>, low array<short>, doc array<long>"


def _forest(doc: np.ndarray, run_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect the documents of each run as the run does, without circles.

    They go to the smallest document of the run, so that paths stay short.
    """
    order = np.lexsort((doc, run_of))
    doc, run_of = doc[order], run_of[order]
    first = np.ones(len(doc), bool)
    first[1:] = run_of[1:] != run_of[:-1]
    hub = doc[first][np.cumsum(first) - 1]
    pairs = np.stack([hub, doc], axis=1)[~first]
    pairs = np.unique(np.sort(pairs[pairs[:, 0] != pairs[:, 1]], axis=1), axis=0)
    nodes, index = np.unique(pairs, return_inverse=True)
    forest = Forest(len(nodes))
    index = index.reshape(pairs.shape)
    kept = [forest.union(i, j) for i, j in index.tolist()]
    pairs = pairs[np.array(kept, bool)] if len(pairs) else pairs.reshape(0, 2)
    return pairs[:, 0], pairs[:, 1]


def _candidate_edges(table: pa.Table) -> pa.Table:
    doc = flat(table, "doc")
    if table.column("block")[0].as_py() < 0:
        a, b = doc[::2], doc[1::2]
    else:
        key = flat(table, "high").astype(np.int64) * (1 << 16) + flat(table, "low")
        order, _, run_of = first_of(key)
        a, b = _forest(doc[order], run_of)
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


# Trees


class SignatureTree:
    """Sets in the order of their sizes under nodes with OR-combined bitmaps and size ranges."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.sets = sets
        size = np.array([len(s) for s in sets])
        width = min(BITS, max(64, 1 << int(SPREAD * size.max() - 1).bit_length()))
        bits = np.zeros((len(sets), width), bool)
        for row, s in zip(bits, sets, strict=True):
            row[(s & np.uint64(width - 1)).astype(np.int64)] = True
        maps = np.packbits(bits, axis=1).view(np.uint64)
        excess = size - bits.sum(axis=1)  # members that share a bit with another
        self.levels = [(maps, size, size, excess)]
        while len(self.levels[-1][0]) > 1:
            maps, low, high, excess = self.levels[-1]
            cuts = np.arange(0, len(maps), FAN)
            self.levels.append(
                (
                    np.bitwise_or.reduceat(maps, cuts, axis=0),
                    np.minimum.reduceat(low, cuts),
                    np.maximum.reduceat(high, cuts),
                    np.maximum.reduceat(excess, cuts),
                )
            )

    def may_link(self, level: int, i: int, j: np.ndarray, sizes: Sizes) -> np.ndarray:
        """Of the nodes ``j``, those that may hold a set that links with one under node ``i``."""
        maps, low, high, excess = self.levels[level]
        common = np.bitwise_count(maps[i] & maps[j]).sum(axis=1, dtype=np.int64)
        overlap = common + np.minimum(excess[i], excess[j])
        overlap = np.minimum(overlap, np.minimum(high[i], high[j]))
        needed = (low[i] + low[j]) * sizes.percent
        apart = (low[j] * sizes.percent > high[i] * 100) | (low[i] * sizes.percent > high[j] * 100)
        return (overlap * (100 + sizes.percent) >= needed) & ~apart


def connect(
    sets: list[np.ndarray],
    forest: Forest,
    sizes: Sizes,
    names: list[tuple[int, int]] | None = None,
    compared: set | None = None,
) -> list[tuple[int, int]]:
    """Links that connect whatever links connect; ``forest`` says what is connected already.

    Pairs of ``names`` (one per set) in ``compared`` are known not to link, and new ones join it.
    """
    found: list[tuple[int, int]] = []
    n = len(sets)

    def compare(i: int, j: int) -> None:
        if names is not None:
            pair = (names[i], names[j]) if names[i] < names[j] else (names[j], names[i])
            if pair in compared:
                return
            compared.add(pair)
        a, b = sets[i], sets[j]
        if len(a) > len(b):
            a, b = b, a
        needed = sizes.least_overlap(len(a), len(b))
        if needed > len(a):
            return
        at = np.searchsorted(b, a)
        if int((b[np.minimum(at, len(b) - 1)] == a).sum()) >= needed:
            forest.union(i, j)
            found.append((i, j))

    if n <= FAN:  # a tree of one node
        for i in range(n):
            for j in range(i + 1, n):
                if forest.find(i) != forest.find(j):
                    compare(i, j)
        return found
    tree = SignatureTree(sets)

    def together(level: int, i: int, j: int) -> bool:
        span = FAN**level
        rows = [*range(i * span, min(n, (i + 1) * span)), *range(j * span, min(n, (j + 1) * span))]
        root = forest.find(rows[0])
        return all(forest.find(r) == root for r in rows)

    def visit(level: int, i: int, j: int) -> None:
        if (level > 0 or i != j) and together(level, i, j):
            return
        if level == 0:
            if i != j:
                compare(i, j)
            return
        width = len(tree.levels[level - 1][0])
        left = range(i * FAN, min(width, (i + 1) * FAN))
        right = np.arange(j * FAN, min(width, (j + 1) * FAN))
        for x in left:
            others = right[right >= x] if i == j else right
            for y in others[tree.may_link(level - 1, x, others, sizes)].tolist():
                visit(level - 1, x, y)

    visit(len(tree.levels) - 1, 0, 0)
    return found


def _tree_links(percent: int) -> Callable[[pa.Table], pa.Table]:
    """Of a group with columns pair, doc, known, members: new links within each pair of leaves.

    Rows with ``members`` bring the sets of a document, rows with ``pair`` say where it stands.
    No two documents are compared twice in the group, and what one pair connects the next knows.
    """

    def run(table: pa.Table) -> pa.Table:
        sizes = Sizes(percent)
        table = table.combine_chunks()
        sets: dict[int, list[np.ndarray]] = {}
        for batch in table.to_batches():
            lists = batch.column(3)
            at, values = lists.offsets.to_numpy(), lists.values.to_numpy().view(np.uint64)
            filled, docs = lists.is_valid().to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
            for k in np.flatnonzero(filled).tolist():
                sets.setdefault(docs[k], []).append(values[at[k] : at[k + 1]])
        placed = table.filter(table.column("pair").is_valid())
        pairs, docs, known = (placed.column(c).to_numpy() for c in ("pair", "doc", "known"))
        names, index = np.unique(known, return_inverse=True)
        joined, compared, out = Forest(len(names)), set(), []
        order = np.lexsort((docs, pairs))
        cuts = np.flatnonzero(np.diff(pairs[order])) + 1
        for rows in np.split(order, cuts):
            of = dict(zip(docs[rows].tolist(), index[rows].tolist(), strict=True))
            if len({joined.find(i) for i in of.values()}) < 2:
                continue
            held = [(len(s), d, k) for d in of for k, s in enumerate(sets.get(d, []))]
            held.sort()
            forest, seen = Forest(len(held)), {}
            for k, (_, d, _) in enumerate(held):
                forest.union(seen.setdefault(joined.find(of[d]), k), k)
            chosen = [sets[d][k] for _, d, k in held]
            for i, j in connect(chosen, forest, sizes, [(d, k) for _, d, k in held], compared):
                joined.union(of[held[i][1]], of[held[j][1]])
                out.append((held[i][1], held[j][1]))
        a, b = zip(*out, strict=True) if out else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


LINKS = "a long, b long"


def _leaf(cluster: Column, size_class: Column, salt: Column) -> Column:
    return F.xxhash64(cluster, size_class, salt)


def _bin(key: str) -> Column:
    return F.xxhash64(key, F.lit(1))


def _links_of(rows: DataFrame, percent: int) -> DataFrame:
    """Links among ``rows(bin, pair, doc, known, members)`` within each pair."""
    blocks = block_count(rows)
    grouped = rows.withColumn("bin", F.pmod(F.col("bin"), F.lit(blocks)))
    grouped = grouped.select("bin", "pair", "doc", "known", "members").groupBy("bin")
    tree = _tree_links(percent)
    return grouped.applyInArrow(lambda t: tree(t.drop(["bin"])), LINKS)


def _members(rows: DataFrame, n_words: int, percent: int) -> DataFrame:
    """Sets of ``rows(doc_id, text, wanted, cluster)``: doc, cluster, size_class, members."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = Sizes(percent)
        for piece, texts in slices(_with_wanted(batches)):
            hashes, _, counts = _own_sets(piece, texts, n_words)
            keep = pa.array(counts > 0)
            some = counts[counts > 0]
            yield pa.RecordBatch.from_arrays(
                [
                    piece.column(0).filter(keep),
                    piece.column(3).filter(keep),
                    pa.array(sizes.of(some), pa.int32()),
                    list_array(hashes.view(np.int64), some, pa.int64()),
                ],
                ["doc", "cluster", "size_class", "members"],
            )

    return rows.mapInArrow(run, "doc long, cluster long, size_class int, members array<long>")


def similar(docs: DataFrame, n_words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs(doc_id, text)``.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case, shingles ``n_words`` of them; a text
    with fewer words is one shingle. Two documents link when 100 * intersection >= ``percent``
    * union; a component is named by its smallest ``doc_id``.

    A null or empty text has no shingles and links with nothing. Rows that share a ``doc_id``
    are one document with several texts, which links if one of them does; each row has its own
    ``n_shingles``. A row without a ``doc_id`` links with nothing and has a null component. Other
    columns are ignored; an empty table gives an empty one.
    """
    plain = docs.schema["doc_id"].dataType.typeName() == "long"
    number = F.col("doc_id") if plain else F.col("doc_id").cast("long").alias("doc_id")
    rows = docs.select(number, "text")
    sets = written(shingle_sets(rows, n_words), "sets")
    filled = sets.where("doc_id IS NOT NULL AND n_shingles > 0")
    classes = written(filled.groupBy("d1", "d2").agg(F.min("doc_id").alias("first")), "classes")
    texts = rows.where("doc_id IS NOT NULL")
    segments = texts.mapInArrow(_segment_rows(n_words, percent, block_count(docs)), SEGMENTS)
    edges = segments.groupBy("block").applyInArrow(_candidate_edges, LINKS)
    clusters = components(written(edges, "candidates")).select(
        F.col("id").alias("doc_id"), F.col("component").alias("cluster")
    )
    # Of each class in a candidate group, the set of its first document goes on.
    grouped = classes.join(clusters, F.col("first") == F.col("doc_id")).groupBy("doc_id").agg(
        F.collect_list(F.struct("d1", "d2")).alias("wanted"), F.max("cluster").alias("cluster")
    )
    again = texts.join(grouped, "doc_id", "left").select("doc_id", "text", "wanted", "cluster")
    members = written(_members(again, n_words, percent), "members")
    links = _tree_stage(members, percent)
    linked = components(links).select(F.col("id").alias("first"), "component")
    named = written(classes.join(linked, "first", "left"), "named")
    # A document with several texts stands in several classes: they are one.
    several = filled.select("doc_id", "d1", "d2").distinct().groupBy("doc_id").count().where("count > 1")
    if not several.isEmpty():
        ties = filled.join(several, "doc_id").join(classes, ["d1", "d2"])
        ties = ties.select(F.col("doc_id").alias("a"), F.col("first").alias("b"))
        linked = components(links.union(ties)).select(F.col("id").alias("first"), "component")
        named = written(classes.join(linked, "first", "left"), "named")
    component = F.coalesce("component", "first", "doc_id").alias("component_id")
    found = filled.join(named, ["d1", "d2"], "left").select("doc_id", "n_shingles", component)
    alone = sets.where("doc_id IS NULL OR n_shingles = 0")
    return found.union(alone.select("doc_id", "n_shingles", "doc_id"))


def _tree_stage(members: DataFrame, percent: int) -> DataFrame:
    """Links between the sets of each candidate group, leaf by leaf."""
    key = ["cluster", "size_class"]
    parts = F.greatest(F.count("*") / LEAF, F.sum(F.size("members")) / LEAF_SHINGLES)
    counts = members.groupBy(*key).agg(F.ceil(parts).cast("int").alias("salts"))
    classes = W.partitionBy("cluster").orderBy("size_class")  # there are under 200 classes
    counts = counts.select(
        "*",
        F.coalesce(F.lag("size_class").over(classes) == F.col("size_class") - 1, F.lit(False)).alias("below"),
        F.coalesce(F.lead("size_class").over(classes) == F.col("size_class") + 1, F.lit(False)).alias("above"),
    )
    salted = members.join(written(counts, "leaf_counts"), key).withColumn(
        "salt", F.pmod(F.xxhash64("doc"), F.col("salts")).cast("int")
    )
    # A leaf meets the next salt of its class; the first salts of neighbouring classes meet.
    salt, own = F.col("salt"), F.col("size_class")
    lonely = (F.col("salts") == 1) & ~F.col("below") & ~F.col("above")
    start = [
        (lonely | (salt < F.col("salts") - 1), own, salt),
        (salt > 0, own, salt - 1),
        ((salt == 0) & F.col("below"), own - 1, F.lit(-1)),
        ((salt == 0) & F.col("above"), own, F.lit(-1)),
    ]
    starts = F.array_compact(
        F.array(*[F.when(when, F.struct(c.alias("c"), s.alias("s"))) for when, c, s in start])
    )
    spread = salted.select("doc", "cluster", "members", F.explode(starts).alias("start")).select(
        _leaf(F.col("cluster"), F.col("start.c"), F.col("start.s")).alias("pair"),
        "doc",
        F.col("doc").alias("known"),
        "members",
    ).withColumn("bin", _bin("pair"))
    first = written(_links_of(spread, percent), "links")
    more = _remaining(salted, first, percent, members)
    return first if more is None else first.union(more)


def _cells(hashes: np.ndarray, size: int) -> np.ndarray:
    return (mix(hashes ^ np.uint64(0x6A09E667F3BCC909)) & np.uint64(size - 1)).astype(np.int64)


def _shingle_counts(rows: DataFrame, size: int) -> np.ndarray:
    """Of each of ``size`` cells, how many shingles of ``rows(members)`` fall into it, up to 255."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(size, np.uint8)
        for batch in batches:
            hashes = batch.column(0).flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            cells, n = np.unique(_cells(hashes, size), return_counts=True)
            held[cells] = np.minimum(held[cells] + n, 255)
        cells = np.flatnonzero(held)
        at = (cells % CELL_BLOCK).astype(np.uint16).view(np.int16)
        columns = [(at, pa.int16()), (held[cells].view(np.int8), pa.int8())]
        yield pa.RecordBatch.from_arrays(by_block(cells // CELL_BLOCK, columns), ["block", "at", "n"])

    def add(table: pa.Table) -> pa.Table:
        at, n = flat(table, "at").view(np.uint16), flat(table, "n").view(np.uint8)
        total = np.minimum(np.bincount(at, n, CELL_BLOCK), 255).astype(np.uint8)
        return pa.table({"block": table.column("block").slice(0, 1), "counts": pa.array([total.tobytes()], pa.binary())})

    each = rows.select("members").mapInArrow(count, "block int, at array<short>, n array<byte>")
    counts = np.zeros(size, np.uint8)
    for block, held in each.groupBy("block").applyInArrow(add, "block int, counts binary").toLocalIterator():
        counts[block * CELL_BLOCK : (block + 1) * CELL_BLOCK] = np.frombuffer(held, np.uint8)
    return counts


def prefix_keys(
    hashes: np.ndarray, text: np.ndarray, counts: np.ndarray, held: np.ndarray, percent: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shingle, text, most) of the first shingles of each set, from the rarest to the most frequent.

    ``held`` says how often each shingle occurs, at least. The order is the same in all sets. Of two sets that
    link, what comes before their first common shingle is missing in the other, so the rest has to suffice:
    that bounds the size of the other set by ``most``, and where it is too small for a link the prefix ends.
    """
    order = np.lexsort((mix(hashes), held, text))
    own = counts[text]
    place = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
    most = (own - place) * (100 + percent) // percent - own
    # A shingle that occurs once is in no other set.
    send = (most * 100 >= own * percent) & (held[order] > 1)
    return hashes[order][send], text[send], most[send]


def _keys_of(rows: DataFrame, percent: int) -> DataFrame:
    """(key, doc, known, size, most): the :func:`prefix_keys` of ``rows(doc, known, members)``."""
    n = rows.agg(F.sum(F.size("members"))).first()[0] or 0
    size = min(MOST_CELLS, max(CELL_BLOCK, 1 << (CELLS * n).bit_length()))
    shared = rows.sparkSession.sparkContext.broadcast(_shingle_counts(rows, size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            counts = np.diff(lists.offsets.to_numpy()).astype(np.int64)
            hashes = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            text = np.repeat(np.arange(len(counts)), counts)
            keys, owner, most = prefix_keys(hashes, text, counts, shared.value[_cells(hashes, size)], percent)
            at = pa.array(owner)
            columns = [
                pa.array(keys.view(np.int64)),
                batch.column(0).take(at),
                batch.column(1).take(at),
                pa.array(counts[owner]),
                pa.array(most),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["key", "doc", "known", "size", "most"])

    schema = "key long, doc long, known long, size long, most long"
    return rows.select("doc", "known", "members").mapInArrow(run, schema)


def _remaining(
    salted: DataFrame, first: DataFrame, percent: int, members: DataFrame | None = None
) -> DataFrame | None:
    """Links in the candidate groups of several leaves that are not connected by now.

    Documents that link have a shingle of their prefixes in common, so it is enough that the holders of each
    such shingle meet, and only of those whose holders are not all connected. Shingles with the same
    holders count once, for the first of them. Holders beyond the size of a leaf are cut into leaves, of which those
    pairs meet in which components are apart and sizes allow a link. Components that fill leaves have
    their own, so that a few documents that are apart meet each of them once. *Late* holders can only
    link with smaller sets, so no two of them link. ``members``, from which ``salted`` comes, is not read again
    and deleted.
    """
    wide = written(salted.where("salts > 1").select("cluster").distinct(), "wide_clusters")
    if wide.isEmpty():
        return None
    known = components(first).select(F.col("id").alias("doc"), "component")
    rows = salted.join(wide, "cluster", "left_semi").join(known, "doc", "left")
    rows = rows.select("cluster", "doc", "members", F.coalesce("component", "doc").alias("known"))
    ends = rows.groupBy("cluster").agg(F.min("known").alias("low"), F.max("known").alias("high"))
    rows = rows.join(written(ends.where("low < high").select("cluster"), "split_clusters"), "cluster", "left_semi")
    rows = written(rows.select("doc", "members", "known"), "wide")
    discard(members)
    keys = _keys_of(rows, percent)
    # Keys without sizes may all meet.
    free = [F.lit(0).cast("long").alias(c) for c in ("size", "most") if c not in keys.columns]
    keys = keys.select("*", *free)
    # A document with several rows holds a shingle once, or it would drop out of ``who``.
    if not rows.groupBy("doc").count().where("count > 1").isEmpty():
        keys = keys.groupBy("key", "doc", "known").agg(F.min("size").alias("size"), F.max("most").alias("most"))
    keys = written(keys.withColumn("late", F.col("most") < F.col("size")), "wide_keys")
    ends = [F.min("known").alias("low"), F.max("known").alias("high"), F.min("size").alias("least"), F.max("most").alias("top")]
    holders = keys.groupBy("key").agg(
        F.count("*").alias("n"),
        F.bit_xor(F.xxhash64("doc")).alias("who"),
        F.min("doc").alias("lead"),
        F.min("late").alias("late"),
        *ends,
    )
    # The first of the shingles with the same holders leaves most to link with.
    open_keys = holders.where("low < high AND NOT late").groupBy("who", "n", "lead").agg(
        F.max_by(F.struct("key", "least", "top"), "top").alias("k")
    )
    open_keys = written(open_keys.select("k.*", "lead", "n"), "open_keys")
    placed = keys.join(open_keys, "key").where("most >= least AND size <= top")
    placed = written(placed.select("key", "lead", "n", "doc", "known", "size", "most", "late"), "placed")
    discard(keys)
    # Keys of one leaf with the same first holder go together: they have most holders in common.
    blocks = F.lit(block_count(rows))
    met = placed.where(F.col("n") <= LEAF).select(
        F.pmod(_bin("lead"), blocks).alias("bin"), F.col("key").alias("pair"), "doc", "known"
    )
    many = placed.where(F.col("n") > LEAF)
    held = many.groupBy("key", "known", "late").agg(F.count("*").alias("held"))
    family = F.when(F.col("held") > LEAF, F.xxhash64("key", "late", "known")).otherwise(F.xxhash64("key", "late"))
    held = written(held.withColumn("family", family), "holder_counts")
    if not held.isEmpty():
        salts = held.groupBy("family").agg(F.ceil(F.sum("held") / LEAF).cast("int").alias("salts"))
        leaf = F.xxhash64("family", F.pmod(F.xxhash64("doc"), F.col("salts")))
        many = many.join(held.join(salts, "family").drop("held"), ["key", "known", "late"])
        many = written(many.select("key", "doc", "known", "size", "most", "late", leaf.alias("leaf")), "placed")
        leaves = written(many.groupBy("key", "leaf", "late").agg(*ends), "leaves")
        left, right = leaves.alias("l"), leaves.alias("r")
        apart = F.least("l.low", "r.low") < F.greatest("l.high", "r.high")
        may_link = (F.col("l.least") <= F.col("r.top")) & (F.col("r.least") <= F.col("l.top"))
        may_link &= ~(F.col("l.late") & F.col("r.late"))
        # Leaves, not documents: one row per LEAF of them, and only where something is left to join.
        pairs = left.join(
            right, (F.col("l.key") == F.col("r.key")) & (F.col("l.leaf") <= F.col("r.leaf")) & apart & may_link
        ).select(
            F.col("l.key").alias("key"),
            F.explode(F.array_distinct(F.array("l.leaf", "r.leaf"))).alias("leaf"),
            F.xxhash64("l.leaf", "r.leaf").alias("pair"),
        )
        parted = many.join(written(pairs, "leaf_pairs"), ["key", "leaf"])
        met = met.union(parted.select(F.pmod(_bin("pair"), blocks).alias("bin"), "pair", "doc", "known"))
    met = written(met, "met")
    sets = met.select("bin", "doc").distinct().join(rows.select("doc", "members"), "doc")
    nothing = F.lit(None)
    spread = met.withColumn("members", nothing.cast("array<long>")).unionByName(
        sets.select("bin", nothing.cast("long").alias("pair"), "doc", nothing.cast("long").alias("known"), "members")
    )
    links = written(_links_of(spread, percent), "links")
    discard(rows)
    return links
