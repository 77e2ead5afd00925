"""Hashes of all words of an Arrow column of texts, without a Python object for any of them.

Words are what lies between ASCII white space; A to Z count as a to z. A byte has a random number, a word is the sum of
its bytes' numbers, each times a power of an odd number by its place; so differences of running sums give all words of a
block at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes that are summed at once: the running sums stay near the processor.
BLOCK = 1 << 17
#: Bytes of a slice of a column.
SLICE_BYTES = 1 << 20
SPACES = b" \t\n\x0b\f\r"
_BASE = 0x9E3779B97F4A7C15
_ALL = (1 << 64) - 1


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_numbers() -> np.ndarray:
    """A random 64-bit number for each byte, the same for a letter in both cases."""
    n = mixed((np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(_BASE))
    n[ord("A") : ord("Z") + 1] = n[ord("a") : ord("z") + 1]
    return n


_NUMBERS = byte_numbers()
_IS_SPACE = np.isin(np.arange(256), list(SPACES))
_powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse modulo 2**64."""
    global _powers
    if len(_powers[0]) < n:
        length = max(n, BLOCK)
        factors = np.full(length, _BASE, np.uint64), np.full(length, pow(_BASE, -1, 1 << 64) & _ALL, np.uint64)
        for f in factors:
            f[0] = 1
        _powers = tuple(np.multiply.accumulate(f) for f in factors)
    return _powers


def column_slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """Consecutive parts of a column of about `most` bytes each, and where they begin; a longer text is a part of its own."""
    column = pc.fill_null(column.cast(pa.string()), "")
    ends = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < len(ends):
        before = int(ends[start - 1]) if start else 0
        stop = max(start + 1, int(ends.searchsorted(before + most, side="right")))
        yield start, column.slice(start, stop - start)
        start = stop


def word_hashes(texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """63-bit hashes of all words of a column without nulls, and how many each text has; with `end`, it follows every text."""
    n = len(texts)
    _, offsets, raw = texts.buffers()
    at = np.frombuffer(offsets, np.int32, n + 1, 4 * texts.offset).astype(np.int64) if n else np.zeros(1, np.int64)
    data = np.frombuffer(raw, np.uint8, int(at[-1] - at[0]), int(at[0])) if raw is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    at -= at[0]
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = ~_IS_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True  # a text begins, or the last one ends
    new = inside.copy()
    new[1:] &= ~inside[:-1] | edge[1:]
    starts = np.flatnonzero(new)
    last = inside[:-1] & (~inside[1:] | edge[1:])
    ends = np.flatnonzero(last) + 1
    hashes = np.empty(len(starts), np.uint64)
    low = 0
    while low < len(starts):
        base = int(starts[low])
        high = max(low + 1, int(ends.searchsorted(base + BLOCK, side="right")))
        stop = int(ends[high - 1])
        power, inverse = powers(stop - base + 1)
        sums = np.zeros(stop - base + 1, np.uint64)
        np.cumsum(_NUMBERS[data[base:stop]] * power[: stop - base], out=sums[1:])
        s, e = starts[low:high] - base, ends[low:high] - base
        hashes[low:high] = (sums[e] - sums[s]) * inverse[s] + (e - s).astype(np.uint64)
        low = high
    hashes = mixed(hashes) >> np.uint64(1)
    first = starts.searchsorted(at)
    counts = np.diff(first)
    if end is None:
        return hashes, counts
    out = np.full(len(hashes) + n, end, np.uint64)
    out[np.arange(len(hashes)) + np.repeat(np.arange(n), counts)] = hashes
    return out, counts + 1


class Places:
    """Where in a list of distinct hashes others are: an open-addressed table in two arrays."""

    EMPTY = np.uint64(_ALL)

    def __init__(self, hashes: np.ndarray):
        bits = max(4, int(2 * len(hashes)).bit_length())
        self.shift, self.mask = np.uint64(63 - bits), (1 << bits) - 1
        self.keys, self.places = np.full(1 << bits, self.EMPTY), np.zeros(1 << bits, np.int64)
        todo, slot = np.arange(len(hashes)), (hashes >> self.shift).astype(np.int64)
        while len(todo):
            free = self.keys[slot] == self.EMPTY
            taken, which = np.unique(slot[free], return_index=True)
            placed = np.flatnonzero(free)[which]
            self.keys[taken], self.places[taken] = hashes[todo[placed]], todo[placed]
            left = np.ones(len(todo), bool)
            left[placed] = False
            todo, slot = todo[left], (slot[left] + 1) & self.mask

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The place of each hash, or -1."""
        slot = (hashes >> self.shift).astype(np.int64)
        key = self.keys[slot]
        out = np.where(key == hashes, self.places[slot], -1)
        todo = np.flatnonzero((key != hashes) & (key != self.EMPTY))
        slot = slot[todo]
        while len(todo):
            slot = (slot + 1) & self.mask
            key = self.keys[slot]
            hit = key == hashes[todo]
            out[todo[hit]] = self.places[slot[hit]]
            on = ~hit & (key != self.EMPTY)
            todo, slot = todo[on], slot[on]
        return out
