"""A trigram model asked by the pieces of a corpus that it was counted on.

Each piece sends what it counts for its distinct words, pairs and trigrams in packed messages; whoever owns a bucket
adds these up and sends the sums back to the pieces that asked. So a sentence is scored where it lies: no token, and no
trigram with what is known of it, passes a join. Sentences need the column ``piece``; what belongs to a piece may come in any order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqlab.operators import packed

_ASKS = "piece int, bucket int, message binary"
_NAMES = ["piece", "bucket", "message"]
#: What is known of a distinct trigram: its count in the model, those of its last pair and word, those of its two
#: contexts, and the number of all rows of the model.
KNOWN = ["n3", "n2", "n1", "c3", "c2", "n0"]


class Piece:
    """The distinct words, pairs and trigrams of a piece, in an order that depends on their words only."""

    def __init__(self, table: pa.Table, begin: str, stop: str) -> None:
        g = packed.Grams(table["words"].combine_chunks() if len(table) else pa.array([], pa.list_(pa.string())), begin, stop)
        self.grams, self.words, n = g, g.words, len(g.words)
        trained = table["trained"].to_numpy().astype(bool)[g.sentence]
        asked = table["asked"].to_numpy().astype(bool)[g.sentence]
        # The first pair of a row is the last one of the row before, or two paddings.
        last = np.concatenate([g.w2 * n + g.w3, [g.first * n + g.first]])
        keys, of_row = np.unique(last, return_inverse=True)
        self.pair = of_row[:-1]
        self.context = np.concatenate([of_row[-1:], of_row[:-2]])
        starts = np.concatenate([[True], np.diff(g.sentence) > 0])[: len(self.pair)]
        self.context = np.where(starts, of_row[-1], self.context[: len(self.pair)])
        triples, self.triple = np.unique(self.context * n + g.w3, return_inverse=True)
        pairs = [keys // n, keys % n]
        self.of_triple = (triples // n, np.empty(len(triples), np.int64), triples % n)  # context, last pair, last word
        self.of_triple[1][self.triple] = self.pair
        self.columns = [[], [np.arange(n)], pairs, [pairs[0][triples // n], pairs[1][triples // n], triples % n]]
        sizes = [1, n, len(keys), len(triples)]
        ends = [np.zeros(len(g.w3), np.int64), g.w3, self.pair, self.triple]
        befores = [None, g.w2, self.context, None]
        self.ends, self.befores, self.asked = [], [], []
        for size, end, before in zip(sizes, ends, befores):
            self.ends.append(np.bincount(end[trained], minlength=size))
            self.befores.append(np.zeros(size, np.int64) if before is None else np.bincount(before[trained], minlength=size))
            wanted = np.zeros(size, bool)
            wanted[end[asked]] = True
            if before is not None:
                wanted[before[asked]] = True
            self.asked.append(wanted)
        self.times = np.bincount(self.triple[asked], minlength=len(triples))
        self.hashed = packed.hashes(g.words)

    def parts(self, order: int, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
        """(bucket, places) of the grams of an order that are counted or asked for."""
        there = np.flatnonzero((self.ends[order] > 0) | (self.befores[order] > 0) | self.asked[order])
        for b, at in packed.dealt(self.hashed, [c[there] for c in self.columns[order]], buckets, len(there)):
            yield order * buckets + b, there[at]

    def asks(self, order: int, buckets: int) -> Iterator[tuple[int, bytes]]:
        for b, at in self.parts(order, buckets):
            values = [self.asked[order][at], self.ends[order][at], self.befores[order][at]]
            yield b, packed.message(self.words, [c[at] for c in self.columns[order]], values)

    def told(self, answers: pa.Table, orders: range, buckets: int) -> None:
        """Put the sums of all pieces in place of the piece's own counts."""
        by_bucket = dict(zip(answers["bucket"].to_pylist(), answers["message"].to_pylist()))
        for order in orders:
            ends, befores = np.zeros_like(self.ends[order]), np.zeros_like(self.befores[order])
            for b, at in self.parts(order, buckets):
                at = at[self.asked[order][at]]
                if len(at):
                    ends[at], befores[at] = packed.unzipped(by_bucket[b])
            self.ends[order], self.befores[order] = ends, befores

    def known(self) -> dict[str, np.ndarray]:
        """:data:`KNOWN` of each distinct trigram, once the piece is told; 0 where the model has none."""
        context, pair, word = self.of_triple
        # The second word of the context.
        before = self.columns[2][1][context]
        return {
            "n3": self.ends[3], "n2": self.ends[2][pair], "n1": self.ends[1][word], "c3": self.befores[2][context],
            "c2": self.befores[1][before], "n0": np.full(len(word), self.ends[0][0]),
        }


def marked(sentences: DataFrame, trained: Column, asked: Column | None, *keep: str) -> DataFrame:
    """The sentences that are counted or scored, and which they are."""
    wanted = F.lit(True) if asked is None else F.coalesce(asked, F.lit(False))
    rows = sentences.select("piece", *keep, "words", F.coalesce(trained, F.lit(False)).alias("trained"), wanted.alias("asked"))
    return rows.where("words IS NOT NULL AND (trained OR asked)")


def answers(rows: DataFrame, begin: str, stop: str, orders: range) -> DataFrame:
    """For each piece the sums over all pieces of the grams of ``orders`` that it asks for."""
    buckets = packed.n_buckets(rows.sparkSession)

    def ask(key: tuple, table: pa.Table) -> pa.Table:
        piece = Piece(table, begin, stop)
        out = [(key[0].as_py(), b, m) for order in orders for b, m in piece.asks(order, buckets)]
        return pa.Table.from_batches([packed.message_batch(out[i : i + 64], _NAMES) for i in range(0, len(out), 64)])

    def answer(key: tuple, table: pa.Table) -> pa.Table:
        n_columns = key[0].as_py() // buckets
        got = packed.Opened(table["message"].to_pylist(), n_columns)
        asked, ends, befores = got.values
        first, inverse = got.numbered()
        ends, befores = (packed.sums(inverse, v, len(first))[inverse] for v in (ends, befores))
        out, low = [], 0
        for piece, high in zip(table["piece"].to_pylist(), got.ends):
            at = low + np.flatnonzero(asked[low:high])
            if len(at):
                out.append((piece, key[0].as_py(), packed.zipped([ends[at], befores[at]])))
            low = high
        return pa.Table.from_batches([packed.message_batch(out, _NAMES)])

    return rows.groupBy("piece").applyInArrow(ask, _ASKS).groupBy("bucket").applyInArrow(answer, _ASKS)


def known_grams(sentences: DataFrame, trained: Column, asked: Column | None, begin: str, stop: str) -> DataFrame:
    """The distinct trigrams ``w1 w2 w3`` of the ``asked`` sentences, how often they come, ``m``, and :data:`KNOWN`
    of the model of the ``trained`` ones; null where it has none, or a word is null."""
    rows = marked(sentences, trained, asked)
    buckets = packed.n_buckets(rows.sparkSession)

    def send(table: pa.Table, told: pa.Table) -> pa.Table:
        piece = Piece(table, begin, stop)
        piece.told(told, range(3), buckets)
        known = piece.known()
        known["n3"] = piece.ends[3]
        out = []
        for b, at in packed.dealt(piece.hashed, piece.columns[3], buckets, len(piece.times)):
            values = [piece.times[at], *(known[k][at] for k in ("n3", "n2", "c3", "n0"))]
            columns = [c[at] for c in piece.columns[3]]
            out.append((b, packed.message(piece.words, columns, values, [piece.ends[1], piece.befores[1]])))
        return pa.Table.from_batches([packed.message_batch(out[i : i + 64], _NAMES[1:]) for i in range(0, max(len(out), 1), 64)])

    def merge(table: pa.Table) -> pa.Table:
        got = packed.Opened(table["message"].to_pylist(), 3, 2)
        times, n3, n2, c3, n0 = got.values
        first, inverse = got.numbered()
        times, n3 = (packed.sums(inverse, v, len(first)) for v in (times, n3))
        # What else is known is told only to a piece that asks.
        asking = np.flatnonzero(got.values[0])
        place = np.zeros(len(first), np.int64)
        place[inverse[asking]] = asking
        there = np.flatnonzero(times)
        place = place[there]
        w1, w2, w3 = (c[place] for c in got.columns)
        null = len(got.words) - 1
        a, b, c = (w == null for w in (w1, w2, w3))
        columns = [
            (n3[there], a | b | c), (n2[place], b | c), (got.of_words[0][w3], c), (c3[place], a | b), (got.of_words[1][w2], b),
            (n0[place], np.zeros(len(place), bool)),
        ]
        numbers = [pa.array(v, pa.int64(), mask=nothing | (v == 0)) for v, nothing in columns]
        words = [got.words.take(pa.array(w)) for w in (w1, w2, w3)]
        return packed.in_batches(pa.table([*words, pa.array(times[there]), *numbers], ["w1", "w2", "w3", "m", *KNOWN]))

    told = answers(rows, begin, stop, range(3))
    sent = rows.groupBy("piece").cogroup(told.groupBy("piece")).applyInArrow(send, packed.MESSAGES)
    schema = "w1 string, w2 string, w3 string, m long, " + ", ".join(f"{k} long" for k in KNOWN)
    return sent.groupBy("bucket").applyInArrow(merge, schema)


def log2_likelihoods(sentences: DataFrame, trained: Column, keys: list[str], l1: float, l2: float, begin: str, stop: str) -> DataFrame:
    """``log2_likelihood`` and ``n_unseen`` per ``keys`` of sentences under the model of the ``trained`` ones among them."""
    rows = marked(sentences, trained, None, *keys)
    buckets = packed.n_buckets(rows.sparkSession)
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def score(table: pa.Table, told: pa.Table) -> pa.Table:
        piece = Piece(table, begin, stop)
        piece.told(told, range(4), buckets)
        k = {n: v.astype(float) for n, v in piece.known().items()}
        null = len(piece.words) - 1
        a, b, c = (w == null for w in piece.columns[3])
        p3 = np.where(a | b | c | (k["n3"] == 0), 0.0, k["n3"] / np.maximum(k["c3"], 1))
        p2 = np.where(b | c | (k["n2"] == 0), 0.0, k["n2"] / np.maximum(k["c2"], 1))
        p = l1 * p3 + l2 * p2 + (1 - l1 - l2) * (k["n1"] / np.maximum(k["n0"], 1))
        # A trigram with a null word has no score, as in a join.
        unseen = a | b | c | (k["n1"] == 0) | (p <= 0)
        logs = np.log2(np.where(unseen, 1.0, p))[piece.triple]
        unseen, where, n = unseen[piece.triple], piece.grams.sentence, len(table)
        seen = np.bincount(where[~unseen], minlength=n)
        found = pa.array(np.bincount(where, weights=logs, minlength=n), pa.float64(), mask=seen == 0)
        missing = pa.array(np.bincount(where[unseen], minlength=n), pa.int64())
        return packed.in_batches(pa.table([*(table[x] for x in keys), found, missing], [*keys, "log2_likelihood", "n_unseen"]))

    told = answers(rows, begin, stop, range(4))
    schema = ", ".join(f"{x} {types[x]}" for x in keys) + ", log2_likelihood double, n_unseen long"
    each = rows.groupBy("piece").cogroup(told.groupBy("piece")).applyInArrow(score, schema)
    # Sentences with equal keys count as one.
    return each.groupBy(*keys).agg(F.sum("log2_likelihood").alias("log2_likelihood"), F.sum("n_unseen").alias("n_unseen"))
