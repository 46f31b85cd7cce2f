"""Vectorised hashing of UTF-8 text held in Arrow buffers.

Substring hashes are polynomial over random 64-bit byte values, so that any substring of a batch is
hashed in constant time from one prefix sum. Two different strings share a 64-bit hash with
probability near 2**-64; operators that must be exact state where they rely on that.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """True for the bytes that belong to words: all but the given inclusive ranges."""
    word = np.ones(256, dtype=bool)
    for lo, hi in ranges:
        word[lo : hi + 1] = False
    return word


#: Words without ASCII white space; words of lower-case ASCII letters, digits and all other scripts.
SPACED = byte_class((0x20, 0x20), (0x09, 0x0D))
ALNUM = byte_class((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


BYTE_VALUES = mix(np.arange(1, 257, dtype=U) * U(0xD1342543DE82EF95))


_power_tables = [np.ones(1, U), np.ones(1, U)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, n at least; the largest tables asked for are kept."""
    if len(_power_tables[0]) < n:
        for i, base in enumerate((_BASE, _INV)):
            p = np.full(n + n // 8, base, dtype=U)
            p[0] = 1
            _power_tables[i] = np.cumprod(p)
    return _power_tables[0], _power_tables[1]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and its row offsets; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), offsets


def chunks(column: pa.Array, limit: int = 1 << 20, rows: int = 4096):
    """Runs of whole rows of about ``limit`` bytes, ``rows`` at most: (first row, end row, bytes, offsets from 0)."""
    if not len(column):
        return
    data, offsets = utf8(column)
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1
        hi = min(n, lo + rows, max(lo + 1, hi))
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """Prefix sums of position-weighted values, for ``span_hash``."""
    p, _ = powers(len(values) + 1)
    out = np.zeros(len(values) + 1, dtype=U)
    np.multiply(values, p[: len(values)], out=out[1:])
    return np.cumsum(out, out=out)


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the values from start to end (exclusive), whatever their position; not yet mixed."""
    _, inv = powers(len(sums))
    return (sums[end] - sums[start]) * inv[start]


class Words:
    """The words of a run of documents: hashes, owners and byte spans; ``first[d]`` is document d's first word."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, word: np.ndarray):
        self.low = low = LOWER[data]
        own = word[low]
        before, after = np.zeros_like(own), np.zeros_like(own)
        before[1:], after[:-1] = own[:-1], own[1:]
        inner = offsets[(offsets > 0) & (offsets < len(data))]
        before[inner], after[inner - 1] = False, False
        self.start, self.end = np.flatnonzero(own & ~before), np.flatnonzero(own & ~after) + 1
        sums = prefix_sums(BYTE_VALUES[low])
        self.hash = mix(span_hash(sums, self.start, self.end) + (self.end - self.start).astype(U))
        self.first = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(offsets) - 1), self.count)


def shingles(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct k-word shingles, sorted within each document, and their offsets by document.

    A document of fewer words, but not none, has its whole sequence as one shingle.
    """
    n = len(w.hash) - k + 1
    if n > 0:
        acc = w.hash[:n].copy()
        for j in range(1, k):
            acc = mix(acc * U(0xA24BAED4963EE407) + w.hash[j : j + n])
        fits = w.doc[:n] == w.doc[k - 1 :]
        acc, owner = acc[fits], w.doc[:n][fits]
    else:
        acc, owner = np.zeros(0, U), np.zeros(0, np.int64)
    short = np.flatnonzero((w.count > 0) & (w.count < k))
    if len(short):
        whole = []
        for d in short:
            x = np.array([U(w.count[d])])
            for h in w.hash[w.first[d] : w.first[d + 1]]:
                x = mix(x * U(0xA24BAED4963EE407) + h)
            whole.append(x[0])
        owner = np.concatenate([owner, short])
        acc = np.concatenate([acc, np.array(whole, dtype=U)])
        order = np.argsort(owner, kind="stable")
        acc, owner = acc[order], owner[order]
    at = np.searchsorted(owner, np.arange(len(w.count) + 1))
    for d in np.flatnonzero(np.diff(at) > 1):
        acc[at[d] : at[d + 1]].sort()
    new = np.ones(len(acc), dtype=bool)
    new[1:] = (acc[1:] != acc[:-1]) | (owner[1:] != owner[:-1])
    return acc[new], np.concatenate([[0], np.cumsum(np.bincount(owner[new], minlength=len(w.count)))]).astype(np.int64)
