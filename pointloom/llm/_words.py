"""Words, shingles and their hashes over whole Arrow batches, without a Python object for any word.

Everything is arithmetic modulo 2**64 on flat arrays: a polynomial hash of a run of bytes (or of words) is the
difference of two prefix sums, scaled back to exponent zero and mixed. Batches are walked in slices of about
``SLICE`` bytes of text, so memory stays bounded; only a single longer text makes a longer slice.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE = 1 << 19
_BASE = 0x9E3779B97F4A7C15 | 1  # odd, so that it has an inverse
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
U = np.uint64


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i for i < n."""
    if len(_powers[0]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        for k, b in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, b, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> U(33))
    x *= U(0xFF51AFD7ED558CCD)
    x ^= x >> U(33)
    x *= U(0xC4CEB9FE1A85EC53)
    x ^= x >> U(33)
    return x


def prefix(values: np.ndarray) -> np.ndarray:
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(len(values))[0], out=out[1:], dtype=np.uint64)
    return out


def runs(sums: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Mixed hash of each run [lo, hi) of what ``sums`` was made from."""
    return mix((sums[hi] - sums[lo]) * powers(len(sums))[1][lo])


@dataclass
class Flat:
    """A slice of documents: bytes, words and where each document's begin."""

    buf: np.ndarray  # uint8
    at: np.ndarray  # byte offset of each document, and the end
    start: np.ndarray  # of each word, in bytes
    end: np.ndarray
    first: np.ndarray  # index of each document's first word, and the end
    doc: np.ndarray  # document of each word
    word: np.ndarray  # hash of each word

    @property
    def n(self) -> int:
        return len(self.at) - 1

    def count(self) -> np.ndarray:
        return np.diff(self.first)

    def per_doc(self, flags: np.ndarray) -> np.ndarray:
        """Sum of a number per byte, by document."""
        sums = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=sums[1:])
        return sums[self.at[1:]] - sums[self.at[:-1]]

    def per_word_doc(self, values: np.ndarray) -> np.ndarray:
        """Sum of a number per word, by document."""
        sums = np.zeros(len(values) + 1, np.int64)
        np.cumsum(values, out=sums[1:])
        return sums[self.first[1:]] - sums[self.first[:-1]]

    def left(self) -> np.ndarray:
        """For each word, how many words of its document begin there or later."""
        return self.first[1:][self.doc] - np.arange(len(self.doc))


def lower(buf: np.ndarray) -> np.ndarray:
    """A-Z to a-z, byte by byte; other bytes as they are."""
    return np.where((buf >= 65) & (buf <= 90), buf | 32, buf).astype(np.uint8)


def flatten(buf: np.ndarray, at: np.ndarray, hashed: bool = True) -> Flat:
    space = _SPACE[buf]
    edge = np.ones(len(buf) + 1, bool)
    if len(buf):
        begin = ~space
        edge[1:-1] = space[:-1]
        edge[at] = True
        begin &= edge[:-1]
        after = np.ones(len(buf), bool)
        after[:-1] = space[1:]
        inner = at[(at > 0) & (at <= len(buf))]
        after[inner - 1] = True
        start, end = np.flatnonzero(begin), np.flatnonzero(~space & after) + 1
    else:
        start = end = np.zeros(0, np.int64)
    first = np.searchsorted(start, at, "left")
    doc = np.repeat(np.arange(len(at) - 1), np.diff(first))
    word = runs(prefix(buf.astype(np.uint64) + U(1)), start, end) if hashed else np.zeros(0, np.uint64)
    return Flat(buf, at, start, end, first, doc, word)


def word_array(flat: Flat) -> pa.Array:
    """The words of a slice as an array of their bytes."""
    size = flat.end - flat.start
    at = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=at[1:])
    inside = np.zeros(len(flat.buf) + 1, np.int8)
    inside[flat.start] += 1
    inside[flat.end] -= 1  # a word may begin where another document's ends
    data = flat.buf[np.cumsum(inside[:-1], dtype=np.int8).astype(bool)]
    return pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(at.tobytes()), pa.py_buffer(data.tobytes())])


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; a null is an empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offsets, data = col.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), at


def slices(col: pa.Array, size: int = SLICE, rows: int = 1 << 30) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from row, to row, bytes, offsets) in slices of about ``size`` bytes and ``rows`` rows at most."""
    if not len(col):
        return
    data, at = buffers(col)
    lo = 0
    while lo < len(col):
        hi = min(len(col), lo + rows, max(lo + 1, int(np.searchsorted(at, at[lo] + size, "right")) - 1))
        yield lo, hi, data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


def grams(flat: Flat, n: int, values: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Positions at which n words of one document begin, and their hashes."""
    at = np.flatnonzero(flat.left() >= n)
    sums = prefix(flat.word if values is None else values)
    return at, runs(sums, at, at + n)


def shingles(flat: Flat, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Document and hash of every n-word shingle; the whole sequence where a document has fewer words."""
    at, h = grams(flat, n)
    doc = flat.doc[at]
    few = np.flatnonzero((flat.count() > 0) & (flat.count() < n))
    if len(few):
        sums = prefix(flat.word)
        short = runs(sums, flat.first[few], flat.first[few + 1])
        doc, h = np.concatenate([doc, few]), np.concatenate([h, short])
    return doc, h
