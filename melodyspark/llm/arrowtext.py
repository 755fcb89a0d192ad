"""Vectorised word work on Arrow string columns: tokens, hashes and word windows as numpy arrays.

Texts are handled as UTF-8 bytes. A chunk is a run of whole rows of about ``limit`` bytes, so
memory follows the chunk and the longest single text, never the table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
_MASK = (1 << 64) - 1
_P, _Q = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_rng = np.random.Generator(np.random.PCG64(20260105))
_BYTE = _rng.integers(0, 1 << 64, 256, dtype=np.uint64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: bytes of words between ASCII white space
SPACED = np.ones(256, bool)
SPACED[[32, 9, 10, 11, 12, 13]] = False
#: bytes of words of ASCII letters, digits and everything beyond ASCII
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that every bit depends on every input bit."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U64(33))
    x = x * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(12, int(n - 1).bit_length())
        have = np.full(size, base, U64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if size <= 1 << 23:
            _powers[base] = have
    return have[:n]


def strings(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if len(col) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
    _, at, data = col.buffers()
    offsets = np.frombuffer(at, kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)), offsets


def chunks(col: pa.Array, limit: int = 2 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of runs of rows; one row may exceed ``limit``."""
    data, at = strings(col)
    lo, n = 0, len(at) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, "right")) - 1)
        yield lo, hi, data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi
    # a worker lives on after its batch: what Arrow holds in reserve goes back
    pa.default_memory_pool().release_unused()


@dataclass
class Words:
    """Words of a chunk: byte ranges, 64-bit hashes, and ``first[d]:first[d+1]`` of each row d."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def words(data: np.ndarray, at: np.ndarray, kind: np.ndarray, lower: bool, salt: int = 0) -> Words:
    """Split every row into maximal runs of bytes of ``kind``; hashes ignore A-Z case if ``lower``."""
    n = len(data)
    if n == 0:
        none = np.empty(0, np.int64)
        return Words(none, none, np.empty(0, U64), np.zeros(len(at), np.int64))
    inside = kind[data]
    before = np.empty(n, bool)
    before[0], before[1:] = False, inside[:-1]
    before[at[:-1][at[:-1] < n]] = False
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, inside[1:]
    after[at[1:][at[1:] > 0] - 1] = False
    start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    table = (_BYTE if not salt else mix(_BYTE + U64(salt)))[LOWER if lower else slice(None)]
    total = np.empty(n + 1, U64)
    total[0] = 0
    np.cumsum(table[data] * powers(_P, n), out=total[1:])
    inverse = powers(pow(_P, -1, 1 << 64), n)
    hashes = mix((total[end] - total[start]) * inverse[start] + (end - start).astype(U64) * U64(_Q))
    return Words(start, end, hashes, np.searchsorted(start, at))


def windows(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices of words that begin a window of ``k`` words within their row, and the windows' hashes."""
    n = len(w.hash)
    if n < k:
        return np.empty(0, np.int64), np.empty(0, U64)
    last = np.repeat(w.first[1:], np.diff(w.first)) - k
    begin = np.flatnonzero(np.arange(n) <= last)
    total = np.empty(n + 1, U64)
    total[0] = 0
    np.cumsum(w.hash * powers(_Q, n), out=total[1:])
    inverse = powers(pow(_Q, -1, 1 << 64), n)
    return begin, mix((total[begin + k] - total[begin]) * inverse[begin] + U64(k))


def joined(data: np.ndarray, w: Words, lo: int, hi: int, lower: bool) -> bytes:
    """Words ``lo:hi`` of a chunk joined by one space."""
    text = data[w.start[lo] : w.end[hi - 1]]
    text = (LOWER[text] if lower else text).tobytes()
    base = int(w.start[lo])
    return b" ".join(text[s - base : e - base] for s, e in zip(w.start[lo:hi].tolist(), w.end[lo:hi].tolist(), strict=True))
