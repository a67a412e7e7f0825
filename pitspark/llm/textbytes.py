"""Vectorised work on the UTF-8 bytes of many texts at once, for use inside Arrow tasks.

A batch of texts is cut into slices of about ``SLICE`` bytes, so memory depends on the slice and on the
longest single text, never on the batch. In a slice the texts stand one after the other with one newline
between them; words are runs of bytes outside space and 0x09-0x0D, which are ASCII, so working on bytes
and on code points gives the same words. Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 20
#: Odd multipliers of the polynomial hashes; any odd 64-bit number would do.
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """``base ** i`` and ``base ** -i`` modulo 2**64 for i up to n."""
    if base not in _POWERS or len(_POWERS[base][0]) <= n:
        size = max(n, SLICE + SLICE // 16) + 1  # a slice and the newlines in it
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        _POWERS[base] = (both[0], both[1])
    return _POWERS[base]


class RangeHash:
    """Hash of any byte range of a buffer in constant time per range."""

    def __init__(self, data: np.ndarray, base: int = BASES[0]):
        self.up, self.down = powers(base, len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))

    def rolling(self, width: int) -> np.ndarray:
        """Hash of every range of ``width`` bytes."""
        n = len(self.sums) - width
        return mix((self.sums[width:] - self.sums[:n]) * self.down[:n])


class Slice:
    """Some texts of a batch: ``data`` holds them with a newline after each, text i is ``data[start[i]:end[i]]``."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, first: int, lower: bool):
        self.first, self.count = first, len(offsets) - 1
        lengths = np.diff(offsets)
        self.start = offsets[:-1] - offsets[0] + np.arange(self.count)
        self.end = self.start + lengths
        self.data = np.full(len(raw) + self.count, 10, np.uint8)
        self.data[np.arange(len(raw)) + np.repeat(np.arange(self.count), lengths)] = LOWER[raw] if lower else raw

    @cached_property
    def hash(self) -> RangeHash:
        return RangeHash(self.data)

    @cached_property
    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and text number of every word."""
        edge = np.diff(np.concatenate(([True], SPACE[self.data], [True])).view(np.int8))
        start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        return start, end, np.searchsorted(self.end, start, side="right")

    @cached_property
    def word_hash(self) -> np.ndarray:
        return self.hash.of(*self.words[:2])

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """How many positions of each text are set."""
        sums = np.concatenate(([0], np.cumsum(flags)))
        return sums[self.end] - sums[self.start]


def slices(texts: pa.Array | pa.ChunkedArray, lower: bool = False, size: int = SLICE) -> Iterator[Slice]:
    """The slices of a column of texts, in order."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset: texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, side="right")) - 1)
        last = min(last, first + 20_000, len(texts))
        yield Slice(data[offsets[first]: offsets[last]], offsets[first: last + 1], first, lower)
        first = last


def runs(s: Slice, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of every maximal run of the bytes marked in ``inside``, which may not mark the newline."""
    edge = np.diff(np.concatenate(([False], inside[s.data], [False])).view(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return start, end, np.searchsorted(s.end, start, side="right")
