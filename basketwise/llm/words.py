"""Words and word shingles of whole Arrow batches as 64-bit hashes, computed with NumPy.

Words are runs of bytes outside 0x20 and 0x09-0x0D, with A-Z lower-cased. A batch is worked on in slices of about
a megabyte, so memory follows the longest single text, not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit values over all bits (a bijection)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def byte_slices(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, byte offsets of its texts and their end, all bytes) of slices of a batch. Null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + SLICE_BYTES, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield first, offsets[first : last + 1], data
        first = last


class Slice(NamedTuple):
    """Consecutive units (texts, or lines of texts) of a batch."""

    rows: np.ndarray  # row of the batch that each unit belongs to
    begins: np.ndarray  # byte offset of each unit within its row's text
    hashes: np.ndarray  # one per word
    bounds: np.ndarray  # words of unit i: hashes[bounds[i]:bounds[i + 1]]
    starts: np.ndarray  # first byte of each word, within the slice
    ends: np.ndarray  # byte after each word
    offsets: np.ndarray  # byte offset of each unit within the slice, and the end
    data: np.ndarray  # the bytes


class Words:
    """Hashes of words; make one per task."""

    def __init__(self) -> None:
        random = np.random.default_rng(20240229)
        self.table = random.integers(0, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
        lower = np.arange(256, dtype=np.uint8)
        lower[65:91] += 32
        self.table = self.table[lower]  # A-Z hash as a-z
        self.space = np.zeros(256, dtype=bool)
        self.space[[0x20, *range(0x09, 0x0E)]] = True
        self.base = 0x9E3779B97F4A7C15
        self.inverse = pow(self.base, -1, 1 << 64)
        self._grow(SLICE_BYTES)

    def _grow(self, n: int) -> None:
        def powers(b: int) -> np.ndarray:
            p = np.full(n + 1, b, dtype=np.uint64)
            p[0] = 1
            return np.cumprod(p, dtype=np.uint64)

        self.up, self.down = powers(self.base), powers(self.inverse)

    def slices(self, texts: pa.Array, lines: bool = False) -> Iterator[Slice]:
        """The words of each text, or of each line of each text. Null counts as empty."""
        for first, offsets, data in byte_slices(texts):
            yield self._slice(data, offsets, first, lines)

    def _slice(self, data: np.ndarray, offsets: np.ndarray, first: int, lines: bool) -> Slice:
        b = data[offsets[0] : offsets[-1]]
        size = len(b)
        units = offsets - offsets[0]
        rows = np.arange(first, first + len(offsets) - 1)
        begins = np.zeros(len(rows), dtype=np.int64)
        if lines:
            breaks = np.flatnonzero(b == 10) + 1
            texts = units
            at = np.concatenate([texts[:-1], breaks])
            owner = np.concatenate([np.arange(len(rows)), np.searchsorted(texts, breaks - 1, side="right") - 1])
            order = np.lexsort((np.concatenate([np.zeros(len(rows)), np.ones(len(breaks))]), at, owner))
            at, owner = at[order], owner[order]
            rows, begins = rows[owner], at - texts[owner]
            units = np.append(at, size)
        if size > len(self.up) - 1:
            self._grow(size)
        blank = self.space[b]
        before = np.ones(size, dtype=bool)
        before[1:] = blank[:-1]
        before[units[:-1][units[:-1] < size]] = True
        starts = np.flatnonzero(~blank & before)
        after = np.ones(size, dtype=bool)
        after[:-1] = blank[1:]
        closing = units[1:][units[1:] > 0] - 1
        after[closing] = True
        ends = np.flatnonzero(~blank & after) + 1
        total = np.zeros(size + 1, dtype=np.uint64)
        np.cumsum(self.table[b] * self.up[:size], out=total[1:])
        hashes = mix((total[ends] - total[starts]) * self.down[starts] + (ends - starts).astype(np.uint64))
        return Slice(rows, begins, hashes, np.searchsorted(starts, units), starts, ends, units, b)


def shingles(hashes: np.ndarray, bounds: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles and the bounds of each unit; fewer than k words are one shingle, none are none."""
    lengths = np.diff(bounds)
    counts = np.where(lengths >= k, lengths - k + 1, (lengths > 0).astype(np.int64))
    out_bounds = np.concatenate([[0], np.cumsum(counts)])
    factors = [mix(np.array([t + 1], dtype=np.uint64))[0] | _U(1) for t in range(k)]
    size = max(len(hashes) - k + 1, 0)
    all_long = np.zeros(len(hashes), dtype=np.uint64)
    if size:
        total = np.zeros(size, dtype=np.uint64)
        for t in range(k):
            total += hashes[t : t + size] * factors[t]
        all_long[:size] = total
    unit = np.repeat(np.arange(len(lengths)), counts)
    at = bounds[:-1][unit] + np.arange(out_bounds[-1]) - out_bounds[:-1][unit]
    result = all_long[at] if len(at) else np.zeros(0, dtype=np.uint64)
    for n in range(1, k):
        few = np.flatnonzero(lengths == n)
        if len(few):
            total = np.full(len(few), n, dtype=np.uint64)
            for t in range(n):
                total += hashes[bounds[few] + t] * factors[t]
            result[out_bounds[few]] = total
    return mix(result), out_bounds


def distinct_per_unit(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of each unit in ascending order, and the new bounds."""
    unit = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    order = np.lexsort((values, unit))
    values, unit = values[order], unit[order]
    new = np.ones(len(values), dtype=bool)
    new[1:] = (values[1:] != values[:-1]) | (unit[1:] != unit[:-1])
    counts = np.bincount(unit[new], minlength=len(bounds) - 1)
    return values[new], np.concatenate([[0], np.cumsum(counts)])


#: 64-bit numbers of a parity mark.
MARK_WORDS = 4


def parity_marks(tokens: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """256 bits per unit, each the parity of how many tokens fall on it.

    Two sets whose marks differ in d bits differ in d tokens at least.
    """
    marks = np.zeros((len(bounds) - 1, MARK_WORDS), dtype=np.uint64)
    some = np.flatnonzero(np.diff(bounds))
    if len(some):
        place = mix(tokens + np.uint64(0x5851F42D4C957F2D)) & np.uint64(64 * MARK_WORDS - 1)
        bit = np.uint64(1) << (place & np.uint64(63))
        for word in range(MARK_WORDS):
            here = np.where(place >> np.uint64(6) == word, bit, np.uint64(0))
            marks[some, word] = np.bitwise_xor.reduceat(here, bounds[some])
    return marks


def wide_marks(tokens: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parity marks of as many bits as a unit has tokens, up to the next power of two, and the bounds of each unit's 64-bit numbers.

    The place of a token in a mark is the one in a wider mark without its highest bits, so the two halves of a mark, added bit by bit, are the mark
    of half its width, and the first MARK_WORDS that remain are the one that ``parity_marks`` makes.
    """
    n = np.diff(bounds)
    size = np.full(len(n), MARK_WORDS, dtype=np.int64)
    while (short := 64 * size < n).any():
        size[short] *= 2
    ends = np.concatenate([[0], np.cumsum(size)])
    unit = np.repeat(np.arange(len(n)), n)
    place = (mix(tokens + np.uint64(0x5851F42D4C957F2D)) & (64 * size - 1)[unit].astype(np.uint64)).astype(np.int64)
    odd = np.bincount(64 * ends[unit] + place, minlength=64 * ends[-1]) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64), ends


def list_array(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """One list per unit."""
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values))
