"""A compressed FM-index over word sequences: Burrows-Wheeler transform in a wavelet matrix.

One index holds the segments of one shard, a few million words at most. All queries run in lockstep
as numpy arrays: one backward step moves every active query.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64


class BitRank:
    """Bits packed into 64-bit words with a running count, for rank in two lookups."""

    def __init__(self, bits: np.ndarray) -> None:
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(U64)
        self.upto = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)]).astype(np.int32)

    def ones(self, i: np.ndarray) -> np.ndarray:
        """How many ones stand before position i."""
        block = i >> 6
        mask = (U64(1) << (i & 63).astype(U64)) - U64(1)
        return self.upto[block] + np.bitwise_count(self.words[block] & mask)


class FMIndex:
    """Index over ``text`` (symbols from 1; 0 ends each segment), sorted to more than ``depth`` symbols."""

    def __init__(self, text: np.ndarray, depth: int) -> None:
        n = len(text)
        ranks = {1: text.astype(np.int64)}
        length = 1
        while length * 2 <= depth:
            ranks[length * 2] = self._joined(ranks[length], ranks[length], length)
            length *= 2
        full = self._joined(ranks[length], ranks[length], length)  # sorted to 2 * length > depth symbols
        self.rows = np.argsort(full, kind="stable")
        self._group(ranks, length, depth - 1)
        before = text[self.rows - 1]
        counts = np.bincount(text, minlength=int(text.max(initial=0)) + 1)
        self.first = np.concatenate([[0], np.cumsum(counts)[:-1]])
        self.levels: list[tuple[int, BitRank, int]] = []
        order = before
        for bit in reversed(range(max(1, int(len(counts) - 1).bit_length()))):
            bits = ((order >> bit) & 1).astype(np.uint8)
            zeros = int(n - bits.sum())
            self.levels.append((bit, BitRank(bits), zeros))
            order = np.concatenate([order[bits == 0], order[bits == 1]])
        symbols = np.arange(len(counts))
        self.base = self._descend(symbols, np.zeros(len(counts), np.int64))

    @staticmethod
    def _joined(a: np.ndarray, b: np.ndarray, shift: int) -> np.ndarray:
        """Ranks of pairs (a[i], b[i + shift]); past the end stands the smallest."""
        later = np.zeros_like(b)
        if shift < len(b):
            later[:-shift] = b[shift:] + 1
        _, out = np.unique(a * (int(b.max(initial=0)) + 2) + later, return_inverse=True)
        return out.astype(np.int64)

    def _group(self, ranks: dict[int, np.ndarray], length: int, size: int) -> None:
        """For each row: the first and the end row of those that agree on ``size`` symbols."""
        n = len(self.rows)
        differs = np.zeros(n, bool)
        differs[:1] = True
        done, left = 0, size
        while left:
            part = min(length, 1 << (left.bit_length() - 1))
            at = np.minimum(self.rows + done, n - 1)
            value = ranks[part][at]
            differs[1:] |= value[1:] != value[:-1]
            done, left = done + part, left - part
        start = np.flatnonzero(differs)
        number = np.cumsum(differs) - 1
        self.group_start = start[number]
        self.group_end = np.concatenate([start[1:], [n]])[number]

    def _descend(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for bit, rank, zeros in self.levels:
            ones = rank.ones(i)
            i = np.where((symbol >> bit) & 1, zeros + ones, i - ones)
        return i

    def step(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search: rows of a pattern become rows of symbol + pattern."""
        shift = self.first[symbol] - self.base[symbol]
        return shift + self._descend(symbol, lo), shift + self._descend(symbol, hi)


def repeated_windows(segments: list[np.ndarray], weights: np.ndarray, size: int) -> list[np.ndarray]:
    """For each segment of at least ``size`` symbols: which of its windows occur twice or more by weight.

    Matching statistics are taken window by window from the right: rows of the window to the right
    widen to all that share its first size - 1 symbols, then one backward step adds the symbol on
    the left.
    """
    order = np.argsort([-len(s) for s in segments], kind="stable")
    lengths = np.array([len(segments[i]) for i in order], np.int64)
    total = int(lengths.sum()) + len(order)
    starts = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
    words = np.concatenate([segments[i] for i in order])
    _, ids = np.unique(words, return_inverse=True)
    text = np.zeros(total, np.int64)
    inside = np.ones(total, bool)
    inside[starts + lengths] = False
    text[inside] = ids + 1
    index = FMIndex(text, size)
    owner = np.repeat(np.arange(len(order)), lengths + 1)
    upto = np.concatenate([[0], np.cumsum(weights[order][owner[index.rows]])])
    windows = lengths - size + 1
    out = np.zeros(int(windows.sum()), bool)
    base = np.concatenate([[0], np.cumsum(windows)[:-1]])
    lo, hi = np.zeros(len(order), np.int64), np.full(len(order), total, np.int64)
    for k in range(1, size + 1):
        lo, hi = index.step(text[starts + lengths - k], lo, hi)
    active = len(order)
    for k in range(int(windows[0])):
        if k:
            active = int(np.searchsorted(-windows, -k, "left"))
            row = lo[:active]
            lo, hi = index.step(text[starts[:active] + windows[:active] - 1 - k], index.group_start[row], index.group_end[row])
        out[base[:active] + windows[:active] - 1 - k] = upto[hi[:active]] - upto[lo[:active]] > 1
    found: list[np.ndarray] = [np.empty(0, bool)] * len(order)
    for i, b, w in zip(order.tolist(), base.tolist(), windows.tolist(), strict=True):
        found[i] = out[b : b + w]
    return found
