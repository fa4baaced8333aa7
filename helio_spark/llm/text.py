"""Words and word n-grams of Arrow text columns, as numpy arrays.

Texts are handled as UTF-8 bytes, many documents at a time. A word or n-gram is
a 64-bit value, so two different ones meet by chance in about n^2 / 2^65 cases.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; one longer document is handled alone.
SLICE_BYTES = 1 << 20

_RNG = np.random.default_rng(20_240_229)
_BYTE_VALUES = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_WORD_BASE = 0xC2B2AE3D27D4EB4F
_WORD_INVERSE = pow(_WORD_BASE, -1, 2**64)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def byte_class(pattern_bytes: bytes) -> np.ndarray:
    """True for the bytes that end a word."""
    out = np.zeros(256, bool)
    out[np.frombuffer(pattern_bytes, np.uint8)] = True
    return out


#: ASCII white space: x20 and x09 to x0D.
WHITE = byte_class(b" \t\n\x0b\x0c\r")
#: Everything in ASCII but letters and digits (after lower-casing).
NOT_ALNUM = byte_class(
    bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    if n > 1:
        out[1:] = base
        np.multiply.accumulate(out, out=out)
    return out


_TABLES: dict[tuple[int, int], np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** (0 .. n - 1) modulo 2^64; kept up to the usual slice, built anew beyond it."""
    usual = SLICE_BYTES + 8
    if n > usual:
        return _powers(base, n)
    if (base, usual) not in _TABLES:
        _TABLES[base, usual] = _powers(base, usual)
    return _TABLES[base, usual][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads close values (splitmix finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the n + 1 places where they begin and end; null is empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about ``size`` bytes each."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


class Words:
    """Words of a slice of documents: places of their bytes, hashes, and the document of each."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, ends_word: np.ndarray):
        """``offsets`` begin at 0 and refer to ``data``; letters A-Z are lower-cased."""
        low = _LOWER[data]
        self.data, self.n_docs, size = low, len(offsets) - 1, len(low)
        inside = ~ends_word[low]
        border = np.zeros(size + 1, bool)
        border[offsets] = True
        before = np.empty(size, bool)
        after = np.empty(size, bool)
        if size:
            before[0], after[-1] = False, False
            before[1:], after[:-1] = inside[:-1], inside[1:]
            before[border[:-1]] = False
            after[border[1:]] = False
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.start, offsets)  # first word of each document
        total = np.zeros(size + 1, np.uint64)
        np.cumsum(_BYTE_VALUES[low] * powers(_BASE, size), out=total[1:])
        self.hash = mixed((total[self.end] - total[self.start]) * powers(_INVERSE, size + 1)[self.start])

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def ngrams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """n-gram hashes and first n-gram of each document; fewer words make one n-gram."""
        words = len(self.hash)
        total = np.zeros(words + 1, np.uint64)
        np.cumsum(self.hash * powers(_WORD_BASE, words or 1)[:words], out=total[1:])
        have = self.counts()
        grams = np.where(have >= n, have - n + 1, (have > 0).astype(np.int64))
        first = np.zeros(self.n_docs + 1, np.int64)
        np.cumsum(grams, out=first[1:])
        doc = np.repeat(np.arange(self.n_docs), grams)
        at = np.arange(first[-1]) - first[:-1][doc] + self.first[:-1][doc]
        to = np.minimum(at + n, self.first[1:][doc])
        hashes = mixed((total[to] - total[at]) * powers(_WORD_INVERSE, words + 1)[at] + (to - at).astype(np.uint64))
        return hashes, first


def word_slices(column: pa.Array, ends_word: np.ndarray) -> Iterator[tuple[int, int, Words]]:
    """(first document, last document, their words) for slices of a text column."""
    data, offsets = utf8(column)
    for first, last in slices(offsets):
        at = offsets[first : last + 1]
        yield first, last, Words(data[at[0] : at[-1]], at - at[0], ends_word)
