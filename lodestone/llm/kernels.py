"""Vectorised text kernels over Arrow string buffers.

A batch of texts is one byte buffer with document offsets, so words, lines and
shingles of the whole batch are found and hashed by a few numpy passes; no
Python string is made for a word.  Hashes are 64 bits: a polynomial in an odd
base modulo 2**64 (so any substring's hash follows from prefix sums), finished
with a mixing function.

Nulls count as empty texts.  A batch is cut into pieces of at most
``PIECE_BYTES`` bytes (one longer text is its own piece), which bounds memory
whatever the length of texts or batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
PIECE_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_INV = pow(_BASE, -1, 1 << 64)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Everything in ASCII but letters and digits separates.
NOT_ALNUM = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SAME = np.arange(256, dtype=np.uint8)

_powers: tuple[np.ndarray, np.ndarray] = (np.ones(0, U), np.ones(0, U))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least n of each."""
    global _powers
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        out = []
        for x in (_BASE, _INV):
            a = np.full(size, U(x))
            a[0] = 1
            out.append(np.multiply.accumulate(a))
        _powers = (out[0], out[1])
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser with full avalanche (the public splitmix64 constants)."""
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(31)
    return h


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array and its len + 1 offsets into them, nulls as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    o = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, o


def pieces(column: pa.Array, most: int = PIECE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets from 0) of consecutive pieces."""
    raw, o = buffers(column)
    n, lo = len(o) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(o, o[lo] + most, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, raw[o[lo] : o[hi]], o[lo : hi + 1] - o[lo]
        lo = hi


class Words:
    """Words of a piece: byte bounds, mixed hashes, and each document's range of words."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, fold: np.ndarray = SAME, separators: np.ndarray = SPACE):
        n = len(raw)
        self.raw, self.offsets, self.n_docs = raw, offsets, len(offsets) - 1
        self.folded = raw if fold is SAME else fold[raw]
        inside = ~separators[raw]
        cut = np.zeros(n + 1, bool)
        cut[offsets] = True
        before = np.empty(n, bool)
        after = np.empty(n, bool)
        if n:
            before[0], before[1:] = False, inside[:-1]
            after[-1], after[:-1] = False, inside[1:]
            before &= ~cut[:n]
            after &= ~cut[1 : n + 1]
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.inside = inside
        self._sums: np.ndarray | None = None
        self.first = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.first)

    def substrings(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Mixed hashes of byte ranges."""
        pw, inv = powers(len(self.raw) + 1)
        if self._sums is None:
            s = np.empty(len(self.raw) + 1, U)
            s[0] = 0
            np.cumsum((self.folded.astype(U) + U(1)) * pw[: len(self.raw)], out=s[1:])
            self._sums = s
        return mix((self._sums[end] - self._sums[start]) * inv[start] + (end - start).astype(U))

    @property
    def hashes(self) -> np.ndarray:
        return self.substrings(self.start, self.end)

    def per_doc(self, flags: np.ndarray) -> np.ndarray:
        """Sum over each document of a value per byte."""
        s = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=s[1:])
        return s[self.offsets[1:]] - s[self.offsets[:-1]]


def windows(h: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the ``width`` words from each word on, and whether they lie in one document."""
    n = len(h)
    out = np.zeros(n, U)
    for k in range(width):
        out[: max(n - k, 0)] = mix(out[: max(n - k, 0)] + h[k:] * U(2 * k + 3)) if k else mix(h)
    last = np.repeat(first[1:], np.diff(first))
    whole = np.arange(n) + width <= last
    return out, whole


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all documents, one after another, and the
    len + 1 offsets of each.  Fewer words than ``width`` make one shingle of all of
    them; no words make the empty set."""
    w = Words(raw, offsets, LOWER)
    h = w.hashes
    grams, whole = windows(h, w.first, width)
    for i in np.flatnonzero((w.count > 0) & (w.count < width)):
        lo, hi = w.first[i], w.first[i + 1]
        x = np.array([0x51ED270B0F5C1D3B + int(hi - lo)], U)
        for v in h[lo:hi]:
            x = mix(x * U(31) + v)
        grams[lo], whole[lo] = x[0], True
    grams = grams[whole]
    n = np.zeros(len(whole) + 1, np.int64)
    np.cumsum(whole, out=n[1:])
    ends = n[w.first]
    keep = np.ones(len(grams), bool)
    for i in np.flatnonzero(np.diff(ends) > 1):
        grams[ends[i] : ends[i + 1]].sort()
    keep[1:] = grams[1:] != grams[:-1]
    keep[ends[:-1][ends[:-1] < len(grams)]] = True
    n = np.zeros(len(grams) + 1, np.int64)
    np.cumsum(keep, out=n[1:])
    return grams[keep], n[ends]


def fingerprints(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit sums over each set of hashes, as signed integers."""
    out = []
    for h in (mix(values ^ U(0xA5A5A5A55A5A5A5A)), mix(values + U(0x632BE59BD9B4E019))):
        s = np.zeros(len(h) + 1, U)
        np.cumsum(h, out=s[1:])
        out.append((s[offsets[1:]] - s[offsets[:-1]]).view(np.int64))
    return out[0], out[1]
