"""Encode whole texts with a slow exact tokenizer, distinct chunks of a worker about once."""

from __future__ import annotations

import os
from collections.abc import Callable, Sequence

import numpy as np

from seqlab.llm.arrow_text import chunk_bounds, gather, word_hashes

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark already uses every core

SLOTS = 1 << 19
#: Ids remembered per Python worker; when passed, all are forgotten and encoded anew.
REMEMBERED = 4_000_000


class ChunkEncoder:
    """Turns texts into ids by way of the chunks of :func:`chunk_bounds`.

    ``encode`` gives the ids of each of a list of strings. The result equals encoding whole
    texts for every tokenizer that never has a piece across a chunk bound; texts in which this
    is not certain the caller must encode whole. A chunk's ids are kept in the slot that its
    hash names, under two 64-bit hashes, until another chunk takes the slot.
    """

    def __init__(self, encode: Callable[[Sequence[str]], list[list[int]]]) -> None:
        self.encode = encode
        self.key = np.zeros((2, SLOTS), np.uint64)
        self._forget()

    def _forget(self) -> None:
        self.key[:] = 0
        self.start = np.zeros(SLOTS, np.int64)
        self.length = np.zeros(SLOTS, np.int32)
        self.ids = np.zeros(1 << 20, np.int32)
        self.used = 0

    def _store(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = self.encode(chunks)
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        total = int(lengths.sum())
        if self.used + total > len(self.ids):
            more = np.zeros(max(total, len(self.ids)), np.int32)
            self.ids = np.concatenate([self.ids, more])
        flat = np.fromiter((i for ids in found for i in ids), np.int32, total)
        self.ids[self.used : self.used + total] = flat
        starts = self.used + np.cumsum(lengths) - lengths
        self.used += total
        return starts, lengths

    def __call__(
        self, data: np.ndarray, offsets: np.ndarray, hashed: np.ndarray | None = None
    ) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts and the number of ids of each text.

        ``hashed``: bytes of which equal ones mean equal ids, such as those in lower case.
        """
        if self.used > REMEMBERED:
            self._forget()
        bounds, per_text = chunk_bounds(data, offsets)
        hashed = data if hashed is None else hashed
        one, two = (word_hashes(hashed, bounds[:-1], bounds[1:], seed) for seed in (1, 2))
        slot = (one & np.uint64(SLOTS - 1)).astype(np.int64)
        start, length = self.start[slot], self.length[slot]
        missed = np.flatnonzero((self.key[0, slot] != one) | (self.key[1, slot] != two))
        if len(missed):
            _, first, which = np.unique(one[missed], return_index=True, return_inverse=True)
            at = missed[first]
            raw = data.tobytes()
            chunks = [raw[a:b].decode() for a, b in zip(bounds[at], bounds[at + 1], strict=True)]
            new_start, new_length = self._store(chunks)
            start[missed], length[missed] = new_start[which], new_length[which]
            own = slot[at]  # of several chunks for one slot the last stays, in all four arrays
            self.key[0, own], self.key[1, own] = one[at], two[at]
            self.start[own], self.length[own] = new_start, new_length
        ids = self.ids[gather(start, length)]
        ends = np.concatenate([[0], np.cumsum(length, dtype=np.int64)])
        last = np.concatenate([[0], np.cumsum(per_text)])
        return ids, ends[last[1:]] - ends[last[:-1]]
