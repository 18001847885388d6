"""Vectorised scanning of Arrow text columns: byte buffers, word boundaries and polynomial hashes.

Everything here works on the UTF-8 bytes of a slice of documents at a time. Slices are bounded by
``SLICE_BYTES`` (one longer document forms a slice of its own), so a worker's memory follows that
bound and the longest single document, never the batch or the corpus.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1_000_000

#: Odd multiplier of the polynomial hashes modulo 2**64, its inverse, and a seed for the byte values.
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INV = pow(BASE, -1, 1 << 64)
MASK = (1 << 64) - 1

#: Longer words are hashed by BLAKE2b: polynomials modulo a power of two let some long words collide whatever the multiplier.
LONG = 64

_BYTE_CODES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[int, np.ndarray] = {}

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of words: everything but white space, and letters, digits and non-ASCII only.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the whole word."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; grown by doubling and kept per process."""
    got = _powers.get(base)
    if got is None or len(got) < n:
        size = max(n, SLICE_BYTES + 1024)
        got = np.empty(size, dtype=np.uint64)
        got[0] = 1
        done = 1
        while done < size:
            step = min(done, size - done)
            got[done : done + step] = got[:step] * np.uint64(pow(base, done, 1 << 64))
            done += step
        _powers[base] = got
    return got[:n]


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """c with c[e] - c[s] = sum of code(byte j) * BASE**j over s <= j < e."""
    out = np.empty(len(data) + 1, dtype=np.uint64)
    out[0] = 0
    np.cumsum(_BYTE_CODES[data] * powers(BASE, len(data)), out=out[1:])
    return out


def range_hashes(c: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the byte ranges [start, end), equal for equal bytes wherever they stand."""
    return (c[end] - c[start]) * powers(BASE_INV, len(c))[start]


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its offsets; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.empty(0, np.uint8), at


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets from 0) for runs of rows of at most limit bytes, or one longer row."""
    if len(column) == 0:
        return
    data, at = text_buffers(column)
    first, n = 0, len(at) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(at, at[first] + limit, side="right")) - 1)
        last = min(last, n)
        yield first, last, data[at[first] : at[last]], at[first : last + 1] - at[first]
        first = last


class Words:
    """Word boundaries and hashes of a slice. first[d]:first[d + 1] are the words of document d."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, word_bytes: np.ndarray, lower: bool = True):
        self.data = LOWER[data] if lower else data
        inside = np.zeros(len(data) + 1, dtype=bool)
        inside[:-1] = word_bytes[self.data]
        starts = inside.copy()
        starts[1:] &= ~inside[:-1]
        cuts = offsets[1:-1]
        starts[cuts] |= inside[cuts]  # a document's first byte never continues the previous document's word
        self.start = np.flatnonzero(starts)
        stops = ~inside
        stops[0] = False
        stops[1:] &= inside[:-1]
        joined = cuts[(cuts > 0) & (cuts < len(data))]
        stops[joined] |= inside[joined - 1]
        self.end = np.flatnonzero(stops)
        self.first = np.searchsorted(self.start, offsets)
        c = prefix_hashes(self.data)
        self.hash = mix(range_hashes(c, self.start, self.end))
        self.offsets = offsets
        for i in np.flatnonzero(self.end - self.start > LONG).tolist():
            self.hash[i] = int.from_bytes(hashlib.blake2b(self.bytes_of(i), digest_size=8).digest(), "little")

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def bytes_of(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()

    def window(self, i: int, n: int) -> bytes:
        """Words i .. i+n-1 joined by single spaces."""
        return b" ".join(self.bytes_of(j) for j in range(i, i + n))

    def plain(self) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all documents with their words joined by single spaces, and where each document begins."""
        last = np.zeros(len(self.start), dtype=bool)
        last[self.first[1:][self.counts() > 0] - 1] = True
        keep = np.zeros(len(self.data) + 1, dtype=np.int8)
        np.add.at(keep, self.start, 1)
        np.add.at(keep, np.minimum(self.end + ~last, len(self.data)), -1)
        keep = np.cumsum(keep[:-1], dtype=np.int8) > 0
        out = self.data.copy()
        out[self.end[~last]] = 0x20
        at = np.concatenate([[0], np.cumsum(keep)])
        return out[keep], at[self.offsets]
