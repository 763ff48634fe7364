"""Vectorised word handling over UTF-8 bytes, shared by the text operators.

Every function works on one *chunk*: the texts of some documents joined by a
space byte, which no word class contains. Word classes are byte tables, which
is exact for classes that treat all non-ASCII characters alike, because each
byte of a multi-byte UTF-8 character is 0x80 or more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _byte_class(member) -> np.ndarray:
    return np.array([member(b) for b in range(256)])


#: ``[^\x20\x09-\x0D]+``: everything but ASCII white space.
NON_SPACE = _byte_class(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing: digits, a-z, non-ASCII.
ALNUM = _byte_class(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)

_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values (multiply / xor-shift rounds)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of the base and of its inverse modulo 2^64, grown on demand."""
    if len(_POWERS[0]) < n:
        size = max(n, CHUNK_BYTES * 2)
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            p = np.full(size, base & _MASK, np.uint64)
            p[0] = 1
            np.cumprod(p, out=p)
            _POWERS[k] = p
    return _POWERS[0][:n], _POWERS[1][:n]


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    """Prefix sums that give the hash of any slice in constant time (see ``slice_hash``)."""
    h = np.zeros(len(buf) + 1, np.uint64)
    if len(buf):
        np.cumsum(_BYTE_VALUE[buf] * _powers(len(buf))[0], out=h[1:])
    return h


def slice_hash(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte slices [start, end) from their chunk's prefix sums."""
    inv = _powers(len(h))[1]
    x = (h[end] - h[start]) * inv[start]
    return mix(x + (end - start).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


class Words:
    """Words of a chunk: byte bounds, document index and 64-bit hash of each, in text order."""

    def __init__(self, texts: list[bytes], member: np.ndarray, lower: bool = True):
        raw = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        self.buf = _LOWER[raw] if lower else raw
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.doc_start = np.concatenate([[0], np.cumsum(sizes + 1)])
        inside = member[self.buf]
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if len(inside) and inside[0]:
            edge = np.concatenate([[0], edge])
        self.start, self.end = edge[0::2], edge[1::2]
        self.prefix = prefix_hash(self.buf)
        self.hash = slice_hash(self.prefix, self.start, self.end)
        #: words of document d are [first[d], first[d + 1])
        self.first = np.searchsorted(self.start, self.doc_start)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(texts)), self.count)

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the first words of all n-word windows inside one document, and the windows' hashes."""
        m = len(self.hash) - n + 1
        if m <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.flatnonzero(self.doc[:m] == self.doc[n - 1 :])
        return at, self.window_hash(at, n)

    def window_hash(self, at: np.ndarray, n: int) -> np.ndarray:
        x = np.zeros(len(at), np.uint64)
        for k in range(n):
            x = x * np.uint64(_BASE) + self.hash[at + k]
        return mix(x + np.uint64(n))


def chunks(batches, limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of Arrow batches with at most ``limit`` bytes of their ``text`` column (one document at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index("text")).cast(pa.large_binary())
        sizes = col.fill_null(b"")
        size = pc.binary_length(sizes).to_numpy()
        begin, total = 0, 0
        for i, n in enumerate(size):
            if i > begin and total + n > limit:
                yield batch.slice(begin, i - begin), sizes.slice(begin, i - begin).to_pylist()
                begin, total = i, 0
            total += n
        yield batch.slice(begin), sizes.slice(begin).to_pylist()
