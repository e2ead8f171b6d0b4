"""Counts of word sequences in a trie with burstable containers, inside one task.

The trie is shallow: its inner nodes branch by four bits at a time of a code of a phrase's first two words, so
that all phrases with these words lie below one path. A container at the end of a path holds its phrases
as rows of word ids with counts, equal ones merged whenever it fills up; a container that stays too
large bursts into a node with 16 smaller ones. When the whole trie holds too much, its largest subtree
is spilled: one run sorted by code and words, cut where prefix partitions begin.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from seqlab.llm.arrow_text import list_array, mix

#: Rows of a container before it bursts, and of a trie before it spills.
BURST = 1 << 18
HOLD = 1 << 21
FAN_BITS = 4
MAX_DEPTH = 8
_SECOND = np.uint64(0xD6E8FEB86659FD93)

RUN_SCHEMA = "words int, part int, ids array<long>, counts array<long>"


def pair_code(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """64 scattered bits that stand for two words in a row."""
    return mix(mix(first) * _SECOND + second)


def merged(ids: np.ndarray, counts: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows sorted by code and words, equal phrases as one."""
    if not len(counts):
        return ids, counts, code
    order = np.lexsort((*ids.T[::-1], code))
    ids, counts, code = ids[order], counts[order], code[order]
    fresh = np.ones(len(counts), bool)
    fresh[1:] = (ids[1:] != ids[:-1]).any(axis=1)
    at = np.flatnonzero(fresh)
    return ids[at], np.add.reduceat(counts, at), code[at]


class _Node:
    def __init__(self, depth: int) -> None:
        self.depth, self.size = depth, 0
        self.rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # a container, until it bursts
        self.children: dict[int, _Node] | None = None

    def add(self, ids: np.ndarray, counts: np.ndarray, code: np.ndarray) -> None:
        if self.children is None:
            self.rows.append((ids, counts, code))
            self.size += len(counts)
            if self.size > BURST:
                self._merge()
                if self.size > BURST // 2 and self.depth < MAX_DEPTH:
                    self._burst()
            return
        branch = (code >> np.uint64(64 - FAN_BITS * (self.depth + 1))) & np.uint64((1 << FAN_BITS) - 1)
        order = np.argsort(branch, kind="stable")
        bounds = np.searchsorted(branch[order], np.arange((1 << FAN_BITS) + 1))
        for b, (low, high) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
            if high > low:
                own = order[low:high]
                child = self.children.setdefault(b, _Node(self.depth + 1))
                child.add(ids[own], counts[own], code[own])
        self.size = sum(c.size for c in self.children.values())

    def _merge(self) -> None:
        self.rows = [merged(*(np.concatenate(column) for column in zip(*self.rows, strict=True)))]
        self.size = len(self.rows[0][1])

    def _burst(self) -> None:
        rows, self.rows, self.children = self.rows, [], {}
        for batch in rows:
            self.add(*batch)

    def run(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Sorted merged rows of the subtree, container by container in the order of codes."""
        if self.children is None:
            if self.rows:
                self._merge()
                yield self.rows[0]
            return
        for b in sorted(self.children):
            yield from self.children[b].run()


class PhraseTrie:
    """Counts phrases of ``words`` words; ``add`` and ``rest`` give the runs that are spilled."""

    def __init__(self, words: int, part_bits: int) -> None:
        self.words, self.part_bits = words, part_bits
        self.root = _Node(0)

    def add(self, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Count the rows of an (n, words) array of ids."""
        if len(ids):
            code = pair_code(ids[:, 0], ids[:, 1])
            self.root.add(*merged(ids, np.ones(len(ids), np.int64), code))
        while self.root.size > HOLD:
            children = self.root.children
            if children is None:
                yield from self.rest()
            else:
                largest = max(children, key=lambda b: children[b].size)
                yield from self._spill(children.pop(largest))
                self.root.size = sum(c.size for c in children.values())

    def rest(self) -> Iterator[pa.RecordBatch]:
        yield from self._spill(self.root)
        self.root = _Node(0)

    def _spill(self, node: _Node) -> Iterator[pa.RecordBatch]:
        for ids, counts, code in node.run():
            part = (code >> np.uint64(64 - self.part_bits)).astype(np.int64) if self.part_bits else np.zeros(len(code), np.int64)
            parts, n = np.unique(part, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(parts), self.words), pa.int32()),
                    pa.array(parts, pa.int32()),
                    list_array(ids.ravel().view(np.int64), n * self.words, pa.int64()),
                    list_array(counts, n, pa.int64()),
                ],
                ["words", "part", "ids", "counts"],
            )


def merge_runs(at_least: int):
    """Merge the runs of one prefix partition; phrases with fewer occurrences go."""

    def run(table: pa.Table) -> pa.Table:
        k = table.column("words")[0].as_py()
        ids = table.column("ids").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        ids = ids.view(np.uint64).reshape(-1, k)
        counts = table.column("counts").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        ids, counts, _ = merged(ids, counts, np.zeros(len(counts), np.uint64))
        keep = counts >= at_least
        ids, counts = ids[keep], counts[keep]
        lists = list_array(ids.ravel().view(np.int64), np.full(len(counts), k), pa.int64())
        return pa.table({"ids": lists, "n": pa.array(counts, pa.int64())})

    return run
