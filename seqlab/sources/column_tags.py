"""``spark.read.format("column_tags")``: files of tagged words as a table of tokens.

Columns ``file sentence pos word tag``; ``sentence`` is the byte at which the sentence begins. Options:
``path``; ``layout``: ``conll`` (tab columns, word in column 1, tag in column 3, blank lines between sentences) or
``docs`` (word, tab, tag; units end at blank and ``-DOCSTART-`` lines); ``splitBytes``.

A file is cut into byte ranges, which are read in parallel. A range owns the sentences that follow a bound, such
as a blank line, that begins in it; the first range also what comes before any bound. So no range has to know
what others hold and nothing is numbered across them. Where a schema with fewer columns is given, only
these are made. As a stream (``spark.readStream``), files may grow: what lies after the last bound of a file waits for
its end.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from seqlab.sources.places import data_files, place

SCHEMA = "file string, sentence long, pos int, word string, tag string"
SPLIT_BYTES = 32 << 20
BLOCK_BYTES = 4 << 20
#: Word and tag columns of the layouts, and into how many parts a line is cut (0: all).
_LAYOUTS = {"conll": (1, 3, 0), "docs": (0, 1, 2)}


class Range(InputPartition):
    def __init__(self, path: str, start: int, stop: int, fresh: bool, closed: bool = False) -> None:
        super().__init__((path, start, stop))
        self.path, self.start, self.stop = path, start, stop
        self.fresh = fresh  # whether a sentence may begin right at the start
        self.closed = closed  # whether nothing is read beyond the stop, where a bound has just ended


def _ranges(path: str, start: int, stop: int, size: int, closed: bool = False) -> list[Range]:
    return [Range(path, a, min(a + size, stop), a == start, closed and a + size >= stop) for a in range(start, stop, size)]


def _whole_lines(f, start: int, size: int) -> Iterator[tuple[int, bytes]]:
    """Blocks of whole lines from the first one that begins at or after ``start``, with their places."""
    rest, at = b"", start
    if start:
        f.seek(start - 1)
        while True:
            block = f.read(size)
            if not block:
                return
            cut = block.find(b"\n")
            at = f.tell() - len(block)
            if cut >= 0:
                rest, at = block[cut + 1 :], at + cut + 1
                break
    while True:
        block = f.read(size)
        if not block:
            if rest:
                yield at, rest
            return
        rest += block
        cut = rest.rfind(b"\n") + 1
        if cut:
            yield at, rest[:cut]
            rest, at = rest[cut:], at + cut


def _bounds(lines: pa.Array, layout: str) -> np.ndarray:
    ends = pc.equal(lines, "")
    if layout == "docs":
        marked = pc.and_(pc.starts_with(lines, "-DOCSTART-"), pc.greater(pc.utf8_length(lines), 10))
        ends = pc.or_(ends, marked)
    return ends.to_numpy(zero_copy_only=False)


def _split(block: bytes) -> tuple[pa.Array, np.ndarray]:
    """The lines of a block without blanks at their ends, and where each begins."""
    raw = (block[:-1] if block.endswith(b"\n") else block).split(b"\n")
    lengths = np.fromiter(map(len, raw), np.int64, len(raw)) + 1
    lines = pc.utf8_rtrim(pa.array(raw, pa.binary()).cast(pa.string()), characters=" \t\r")
    return lines, np.cumsum(lengths) - lengths


def _field(lines: pa.Array, layout: str, which: int) -> pa.Array:
    column = _LAYOUTS[layout][which]
    cut = _LAYOUTS[layout][2]
    parts = pc.split_pattern(lines, "\t", max_splits=cut - 1) if cut else pc.split_pattern(lines, "\t")
    flat, starts = parts.flatten(), parts.offsets.to_numpy()[:-1]
    there = pc.list_value_length(parts).to_numpy(zero_copy_only=False) > column
    return flat.take(pa.array(np.where(there, starts + column, 0), mask=~there))


def read_range(part: Range, layout: str, columns: list[str]) -> Iterator[pa.RecordBatch]:
    """The tokens of the sentences that a range owns."""
    system, path = place(part.path)
    with system.open_input_file(path) as f:
        ours, sentence, pos = part.fresh, -1, 0
        for at, block in _whole_lines(f, part.start, BLOCK_BYTES):
            lines, where = _split(block)
            where = where + at
            ends = _bounds(lines, layout)
            index = np.arange(len(ends))
            beyond = np.flatnonzero((ends | part.closed) & (where >= part.stop))
            last = len(beyond) > 0
            high = int(beyond[0]) if last else len(ends)
            low = 0
            if not ours:
                found = np.flatnonzero(ends[:high])
                if not len(found):
                    if last:
                        return
                    continue
                low, ours = int(found[0]), True
            # The first line after the last bound, for each line; -1: the sentence began in an earlier block.
            begun = np.maximum.accumulate(np.where(ends, index, -1))
            keep = (index >= low) & (index < high) & ~ends
            own = begun[keep]
            if sentence < 0 and not last and (own < 0).any():
                sentence = int(where[0])
            elif sentence < 0:
                sentence = int(where[0]) if len(where) else 0
            sentences = np.where(own >= 0, where[np.minimum(own + 1, len(where) - 1)], sentence)
            places = np.where(own >= 0, index[keep] - own - 1, pos + index[keep])
            mine = lines.filter(pa.array(keep))
            if len(mine):
                made = {
                    "file": lambda n=len(mine): pa.array([part.path] * n),
                    "sentence": lambda: pa.array(sentences, pa.int64()),
                    "pos": lambda: pa.array(places, pa.int32()),
                    "word": lambda m=mine: _field(m, layout, 0),
                    "tag": lambda m=mine: _field(m, layout, 1),
                }
                yield pa.RecordBatch.from_arrays([made[c]() for c in columns], columns)
            if last:
                return
            # What the next block goes on with.
            if len(ends) and begun[-1] >= 0:
                after = int(begun[-1]) + 1
                pos = len(ends) - after
                sentence = int(where[after]) if after < len(ends) else -1
            else:
                pos += len(ends)


class _Options:
    def __init__(self, options: dict, schema: StructType) -> None:
        self.path = options["path"]
        self.layout = options.get("layout", "conll")
        if self.layout not in _LAYOUTS:
            raise ValueError(f"layout must be one of {sorted(_LAYOUTS)}")
        self.size = int(options.get("splitbytes", options.get("splitBytes", SPLIT_BYTES)))
        self.columns = schema.names
        unknown = set(self.columns) - {c.split()[0] for c in SCHEMA.split(", ")}
        if unknown:
            raise ValueError(f"no such columns: {sorted(unknown)}")


class _Reader(_Options, DataSourceReader):
    def partitions(self) -> list[Range]:
        found = [r for path, size in data_files(self.path) for r in _ranges(path, 0, size, self.size)]
        return found or [Range("", 0, 0, True)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if part.path:
            yield from read_range(part, self.layout, self.columns)


class _StreamReader(_Options, DataSourceStreamReader):
    """Offsets are JSON: for each file the place after its last bound."""

    def initialOffset(self) -> dict:
        return {"files": "{}"}

    def latestOffset(self) -> dict:
        ready = {path: _after_last_bound(path, size, self.layout) for path, size in data_files(self.path)}
        return {"files": json.dumps({p: n for p, n in sorted(ready.items()) if n})}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        done, ready = json.loads(start["files"]), json.loads(end["files"])
        found = [r for path, n in ready.items() if n > done.get(path, 0) for r in _ranges(path, done.get(path, 0), n, self.size, True)]
        return found or [Range("", 0, 0, True)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if part.path:
            yield from read_range(part, self.layout, self.columns)

    def commit(self, end: dict) -> None:
        pass


def _after_last_bound(path: str, size: int, layout: str) -> int:
    """Where the last sentence that is certainly whole has its bound behind it."""
    system, own = place(path)
    with system.open_input_file(own) as f:
        low = size
        while low > 0:
            low = max(0, low - BLOCK_BYTES)
            found = 0
            for at, block in _whole_lines(f, low, BLOCK_BYTES):
                if at >= size:
                    break
                lines, where = _split(block)
                if not block.endswith(b"\n"):  # a line that is still being written
                    lines, where = lines[:-1], where[:-1]
                ends = np.flatnonzero(_bounds(lines, layout)) if len(lines) else []
                if len(ends):
                    k = int(ends[-1])
                    found = at + (int(where[k + 1]) if k + 1 < len(where) else _end_of(block))
            if found:
                return found
            f.seek(0)
    return 0


def _end_of(block: bytes) -> int:
    return block.rfind(b"\n") + 1


class ColumnTags(DataSource):
    @classmethod
    def name(cls) -> str:
        return "column_tags"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options, schema)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _StreamReader(self.options, schema)
