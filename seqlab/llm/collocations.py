"""Phrase collocations: which words stand together more often than their parts explain.

Everything is counted per language. Words are named by 64-bit hashes of language and letters; a table of
all words with their names is counted first, and it shows that no two words share a name (else another seed is
taken), so counts of names are counts of words.

1. Words are counted. Only words that occur often enough can be in a candidate.
2. Pairs of such words are counted, each task in a trie of :mod:`phrase_trie` whose subtrees are
   spilled as sorted runs and merged per prefix partition.
3. Phrases of up to ``longest`` words, all of whose pairs occur often enough, are counted alike.

Which words and pairs occur often enough the tasks ask of bitmaps of fixed size, made of the names
in the tables of step 1 and 2. A bitmap says yes to some others too; these are counted in vain and fall out
when their counts are complete.

Cuts of candidates, and longer candidates that explain shorter ones, are joins on these counts. Products are
exact 38-digit decimals.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqlab.llm.arrow_text import buffers, mix, slices, word_hashes
from seqlab.llm.phrase_trie import RUN_SCHEMA, PhraseTrie, merge_runs, pair_code
from seqlab.session import written

#: Bits of each bitmap: 2 MB, broadcast. It separates well up to some millions of names.
BITS = 24
#: Word occurrences whose phrases one prefix partition holds at most.
PART_WORDS = 1 << 19
UNKNOWN_LANG = "und"
#: Slices of a language that are ranked apart before their first rows meet.
SLICES = 64

# 1 ends a piece, 2 a word.
_ENDS = np.zeros(256, np.uint8)
_ENDS[[*b".,;:!?\n\v\f\r"]] = 1
_ENDS[[*b" \t"]] = 2


class _Words:
    """The words of a slice: their names, places in the bytes, texts, and whether the next one follows
    in the same piece."""

    def __init__(self, texts: pa.Array, langs: pa.Array, seed: int) -> None:
        data, offsets = buffers(texts)
        self.data = data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)
        kind = _ENDS[data]
        inside = kind == 0
        fresh = np.ones(len(data) + 1, bool)
        fresh[1:-1] = ~inside[:-1]
        fresh[offsets] = True
        self.starts = np.flatnonzero(inside & fresh[:-1])
        self.ends = np.flatnonzero(inside & (np.append(~inside[1:], True) | fresh[1:])) + 1 if len(data) else self.starts
        self.text = np.searchsorted(offsets, self.starts, "right") - 1
        piece = np.cumsum(kind == 1)[self.starts] if len(data) else self.starts
        self.follows = (piece[1:] == piece[:-1]) & (self.text[1:] == self.text[:-1])
        names = langs.dictionary_encode()
        self.langs = names.dictionary
        keys = np.array([_lang_key(x, seed) for x in names.dictionary.to_pylist()], np.uint64)
        self.lang = names.indices.to_numpy()[self.text] if len(langs) else np.zeros(0, np.int64)
        own = word_hashes(self.data, self.starts, self.ends, seed)
        self.ids = mix(own ^ keys[self.lang]) if len(own) else own


def _lang_key(lang: str, seed: int) -> np.uint64:
    raw = np.frombuffer(lang.encode() + b"/", np.uint8)
    return word_hashes(raw, np.array([0]), np.array([len(raw)]), seed + 64)[0]


def _slices(batches: Iterator[pa.RecordBatch], seed: int) -> Iterator[_Words]:
    for piece, texts in slices(batches):
        yield _Words(texts, piece.column(1).cast(pa.string()), seed)


def _word_rows(seed: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cut in _slices(batches, seed):
            ids, first, counts = np.unique(cut.ids, return_index=True, return_counts=True)
            raw = cut.data.tobytes()
            words = [raw[a:b] for a, b in zip(cut.starts[first], cut.ends[first], strict=True)]
            langs = cut.langs.take(pa.array(cut.lang[first]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids.view(np.int64)), langs, pa.array(words, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64())],
                ["id", "lang", "word", "n"],
            )

    return run


def count_words(docs: DataFrame) -> tuple[DataFrame, int]:
    """(id, lang, word, n) of all words, written, and the seed under which the names differ."""
    for seed in range(8):
        rows = docs.mapInArrow(_word_rows(seed), "id long, lang string, word string, n long")
        found = written(rows.groupBy("id", "lang", "word").agg(F.sum("n").alias("n")), "phrase_words")
        if found.groupBy("id").agg(F.count(F.lit(1)).alias("words")).where("words > 1").isEmpty():
            return found, seed
    raise RuntimeError("word names collide under every seed")


def bitmap(names: DataFrame) -> np.ndarray:
    """The bitmap of a table of 64-bit names ``id``, folded in the cluster."""
    bit = F.pmod("id", F.lit(1 << BITS))
    cell = names.select(F.floor(bit / 64).cast("int").alias("cell"), F.expr(f"shiftleft(1L, cast(pmod(id, {1 << BITS}) % 64 as int))").alias("bit"))
    table = cell.groupBy("cell").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(1 << (BITS - 6), np.uint64)
    out[table["cell"].to_numpy()] = table["bits"].to_numpy().view(np.uint64)
    return out


def _in_bitmap(bits: np.ndarray, ids: np.ndarray) -> np.ndarray:
    place = ids & np.uint64((1 << BITS) - 1)  # as pmod of the signed number
    return (bits[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) > 0


def _phrase_rows(spark, sizes: list[int], seed: int, part_bits: int, words: np.ndarray, pairs: np.ndarray | None) -> Callable:
    shared = spark.sparkContext.broadcast((words, pairs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        in_words, in_pairs = shared.value
        tries = [PhraseTrie(k, part_bits) for k in sizes]
        for cut in _slices(batches, seed):
            often = _in_bitmap(in_words, cut.ids)
            link = cut.follows & often[1:] & often[:-1]
            if in_pairs is not None:
                at = np.flatnonzero(link)
                link[at] = _in_bitmap(in_pairs, pair_code(cut.ids[at], cut.ids[at + 1]))
            chain = link  # whether the word and the next k - 1 are linked
            for k in range(2, max(sizes) + 1):
                if k > 2:
                    chain = chain[:-1] & link[k - 2 :]
                if k in sizes:
                    at = np.flatnonzero(chain)
                    yield from tries[sizes.index(k)].add(cut.ids[at[:, None] + np.arange(k)])
        for trie in tries:
            yield from trie.rest()

    return run


def _merged(docs: DataFrame, mapper: Callable, at_least: int) -> DataFrame:
    runs = docs.mapInArrow(mapper, RUN_SCHEMA)
    return runs.groupBy("words", "part").applyInArrow(merge_runs(at_least), "ids array<long>, n long")


def count_phrases(docs: DataFrame, longest: int = 5, at_least: int = 100) -> tuple[DataFrame, DataFrame]:
    """The words (id, lang, word, n) and the phrases (ids, n) of 2 to ``longest`` words in a row of one piece
    that occur ``at_least`` times; both written. ``docs`` has ``text`` and ``lang``."""
    spark = docs.sparkSession
    rows = docs.select("text", F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN_LANG)).alias("lang"))
    words, seed = count_words(rows)
    total = words.agg(F.sum("n")).first()[0] or 0
    part_bits = max(0, (total // PART_WORDS).bit_length())
    in_words = bitmap(words.where(F.col("n") >= at_least))
    pairs = written(_merged(rows, _phrase_rows(spark, [2], seed, part_bits, in_words, None), at_least), "phrase_pairs")
    if longest == 2:
        return words, pairs
    coded = pairs.mapInArrow(_pair_codes, "id long")
    sizes = list(range(3, longest + 1))
    more = _merged(rows, _phrase_rows(spark, sizes, seed, part_bits, in_words, bitmap(coded)), at_least)
    return words, pairs.unionByName(written(more, "phrases"))


def _pair_codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0).flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(pair_code(ids[:, 0], ids[:, 1]).view(np.int64))], ["id"])


def _whole(c: str) -> Column:
    return F.col(c).cast("decimal(16,0)")


def collocations(docs: DataFrame, longest: int = 5, at_least: int = 100, first: int = 2000) -> DataFrame:
    """The ``first`` collocations of each language: lang, rank, phrase, a, l, r, n, score.

    Texts are lower-cased in A-Z and cut into pieces at ``[.,;:!?\\x0A-\\x0D]``, pieces into words at spaces and
    tabs. Candidates are phrases of 2 to ``longest`` words with ``a >= at_least`` occurrences in pieces. Cut after
    its first words a candidate has parts with ``l`` and ``r`` occurrences and the score floor(1000 a n / (l r)),
    where ``n`` counts all words of the language; the cut with the lowest score counts, the first of equal ones.
    A candidate is dropped when a longer one that holds it occurs as often. Order: score and ``a`` falling,
    phrase rising by its bytes.

    A null text is empty, a null language is ``und``; repeated rows count again; other columns are
    ignored; an empty table gives an empty one.
    """
    words, phrases = count_phrases(docs, longest, at_least)
    size = F.size("ids")
    single = words.where(F.col("n") >= at_least).select(F.array("id").alias("ids"), "n")
    counts = single.unionByName(phrases)
    # A longer candidate that occurs as often is followed down through those one word shorter.
    inner = phrases.where(size > 2).select(
        F.explode(F.array(F.slice("ids", F.lit(1), size - 1), F.slice("ids", F.lit(2), size - 1))).alias("ids"),
        F.col("n").alias("longer"),
    )
    inner = inner.groupBy("ids").agg(F.max("longer").alias("longer"))
    kept = phrases.join(inner, "ids", "left").where("longer IS NULL OR longer < n").select("ids", F.col("n").alias("a"))
    cuts = kept.select("ids", "a", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.withColumn("left", F.slice("ids", F.lit(1), F.col("k"))).withColumn("right", F.slice("ids", F.col("k") + 1, size))
    cuts = cuts.join(counts.select(F.col("ids").alias("left"), F.col("n").alias("l")), "left")
    cuts = cuts.join(counts.select(F.col("ids").alias("right"), F.col("n").alias("r")), "right")
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    names = words.where(F.col("n") >= at_least).select("id", "lang", "word")
    spelled = kept.select("ids", F.posexplode("ids").alias("at", "id")).join(names, "id").groupBy("ids").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"),
        F.min("lang").alias("lang"),
    )
    cuts = cuts.join(spelled, "ids").join(totals, "lang")
    cuts = cuts.withColumn("top", _whole("a") * _whole("n") * F.lit(1000).cast("decimal(4,0)"))
    cuts = cuts.withColumn("bottom", _whole("l") * _whole("r"))
    cuts = cuts.withColumn("score", F.expr("top div bottom"))
    best = cuts.groupBy("lang", "phrase", "ids", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    best = best.select("lang", "phrase", "a", "n", "cut.score", "cut.l", "cut.r")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    # First within slices of a language, so that a language with most of the phrases is not one task's.
    salted = best.withColumn("slice", F.pmod(F.xxhash64("phrase"), F.lit(SLICES)))
    near = salted.withColumn("rank", F.row_number().over(W.partitionBy("lang", "slice").orderBy(*order)))
    near = near.where(F.col("rank") <= first).drop("rank", "slice")
    ranked = near.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)))
    ranked = ranked.where(F.col("rank") <= first)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
