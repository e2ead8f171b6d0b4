"""Whole texts as Arrow buffers: slices of bounded size, chunk and word bounds, hashes.

Everything here works on the UTF-8 bytes of an Arrow string array with numpy, so that no Python
object per word is made. White space is the ASCII one, ``[\\x20\\x09-\\x0D]``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
_MIX_1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX_2 = np.uint64(0x94D049BB133111EB)
# Odd multipliers for the place of a byte and for the first of two joined hashes.
_PLACE = np.uint64(0x9E3779B97F4A7C15)
_JOIN = np.uint64(0xD6E8FEB86659FD93)
#: Bytes hashed at a time, and places whose scattered numbers are kept.
BLOCK = 1 << 16
NEAR = 128


def slices(
    batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES
) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Cut batches so that each piece holds about ``limit`` bytes of text, or one longer text.

    Yields the piece and its texts as an array of plain strings, null as empty.
    """
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(column))
        lengths = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(lengths.astype(np.int64))
        start = 0
        while start < len(batch):
            done = int(ends[start - 1]) if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, done + limit, "right")))
            piece = batch.slice(start, stop - start)
            plain = pc.fill_null(piece.column(batch.schema.get_field_index(column)), "")
            yield piece, plain.cast(pa.string())
            start = stop


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets from 0) of a string array without nulls."""
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1]
    at = at.astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def _blank(data: np.ndarray) -> np.ndarray:
    return (data == 32) | ((data >= 9) & (data <= 13))


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and the number of words of each text."""
    inside = ~_blank(data)
    fresh = np.ones(len(data) + 1, bool)  # a word may begin here: after a blank, or a new text
    fresh[1:-1] = ~inside[:-1]
    fresh[offsets] = True
    starts = np.flatnonzero(inside & fresh[:-1])
    ends = np.flatnonzero(inside & (np.append(~inside[1:], True) | fresh[1:])) + 1
    counts = np.diff(np.searchsorted(starts, offsets))
    return starts, ends, counts


#: Kinds of bytes: 0 any other, 1 ASCII letter, 2 ASCII punctuation, 3 apostrophe, 4 white space.
_KIND = np.zeros(256, np.uint8)
_KIND[[*range(65, 91), *range(97, 123)]] = 1
_KIND[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 2
_KIND[39] = 3
_KIND[[32, *range(9, 14)]] = 4
#: Whether a text is cut between two kinds.
_CUT = np.zeros((5, 5), bool)
_CUT[:4, 4] = True
_CUT[1, 2:4] = True
_CUT[2, 1] = True


def chunk_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cut texts where word tokenizers always end a piece.

    That is before white space that follows something else, between an ASCII letter and ASCII
    punctuation, and the other way round unless the punctuation is an apostrophe (``'s``).
    Returns the chunk bounds, with the end, and the number of chunks of each text.
    """
    kind = _KIND[data]
    cut = np.zeros(len(data), bool)
    cut[1:] = _CUT.ravel()[kind[:-1] * 5 + kind[1:]]
    cut[offsets[:-1][offsets[:-1] < len(data)]] = True
    starts = np.flatnonzero(cut)
    counts = np.diff(np.searchsorted(starts, offsets))
    return np.append(starts, len(data)), counts


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters neighbouring values."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX_1
    x = x ^ (x >> np.uint64(27))
    x = x * _MIX_2
    return x ^ (x >> np.uint64(31))


def _key(seed: int) -> np.uint64:
    return mix(np.array([2 * seed + 0x1234567], np.uint64))[0]


def _scattered(place: np.ndarray, symbol: np.ndarray, seed: int) -> np.ndarray:
    return mix(place.astype(np.uint64) * _PLACE + symbol.astype(np.uint64) + np.uint64(1) + _key(seed))


@lru_cache(maxsize=8)
def _near(seed: int) -> np.ndarray:
    """The scattered numbers of the first ``NEAR`` places."""
    place, symbol = np.divmod(np.arange(NEAR * 256), 256)
    return _scattered(place, symbol, seed)


def _symbol_sums(data: np.ndarray, starts: np.ndarray, seed: int) -> np.ndarray:
    """Running sums of one scattered number per (byte, place in its range), block by block."""
    total = np.zeros(len(data) + 1, np.uint64)
    near = _near(seed)
    for low in range(0, len(data), BLOCK):
        block = data[low : low + BLOCK]
        first, last = np.searchsorted(starts, [low, low + len(block)])
        base = np.full(len(block), -low, np.int64)
        base[starts[first:last] - low] = starts[first:last] - low
        if first and (first == last or starts[first] > low):  # a range that began before
            base[0] = starts[first - 1] - low
        np.maximum.accumulate(base, out=base)
        place = np.arange(len(block)) - base
        here = near[(np.minimum(place, NEAR - 1) << 8) + block]
        far = np.flatnonzero(place >= NEAR)
        if len(far):
            here[far] = _scattered(place[far], block[far], seed)
        total[low + 1 : low + 1 + len(block)] = here
    return np.cumsum(total, out=total)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each of many byte ranges, given in order and apart from each other.

    Every byte is scattered together with its place in the range before anything is summed, so
    that no pattern of symbols cancels out. Equal ranges have equal hashes; different seeds give
    independent ones.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    total = _symbol_sums(data, starts, seed)
    lengths = (ends - starts).astype(np.uint64)
    return mix(total[ends] - total[starts] + lengths * np.uint64(0xA24BAED4963EE407))


def window_hashes(words: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """Hashes of every ``size`` consecutive words: ``len(words) - size + 1`` numbers.

    Hashes of 1, 2, 4, ... words are joined pair by pair, scattered again at each step.
    """
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    run, span, out, done = mix(words ^ _key(seed)), 1, None, 0
    while True:
        if size & span:
            part = run[done : done + n]
            out = part if out is None else mix(out * _JOIN + part)
            done += span
        if done == size:
            return mix(out + np.uint64(size))
        run = mix(run[:-span] * _JOIN + run[span:])
        span *= 2


def gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices of many ranges one after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = starts - (np.cumsum(lengths) - lengths)
    return np.repeat(shift, lengths) + np.arange(total)


def list_array(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Arrow lists from flat values and the length of each list."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=kind))
