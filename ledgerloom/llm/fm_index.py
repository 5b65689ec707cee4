"""A compressed full-text index over word sequences: suffix order, Burrows-Wheeler transform, wavelet matrix.

The wavelet matrix keeps one bit per symbol and level, packed, with a count for each 64 bits. Backward search runs for
many patterns at once.
"""

from __future__ import annotations

import numpy as np

ONE = np.uint64(1)


class _Bits:
    """Packed bits with counts before each 64."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros(-(-len(bits) // 64) * 64 + 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])[:-1].astype(np.int32)

    def ones(self, at: np.ndarray) -> np.ndarray:
        """How many of the first `at` bits are set."""
        word = at >> 6
        below = (ONE << (at & 63).astype(np.uint64)) - ONE
        return self.before[word] + np.bitwise_count(self.words[word] & below).astype(np.int32)


class Index:
    """Sequences end to end; symbol 0 ends each of them. Other symbols are dense numbers from 1."""

    def __init__(self, sequences: np.ndarray, ends: np.ndarray):
        """sequences: symbols one after the other, without ends; ends: where each stops."""
        n, count = len(sequences), len(ends)
        text = np.zeros(n + count, np.int64)
        inside = np.ones(n + count, bool)
        stops = ends + np.arange(count)
        inside[stops] = False
        text[inside] = sequences
        longest = int(np.diff(np.concatenate([[0], ends])).max()) + 1
        order = _suffix_order(text, stops, longest)
        self.size = n + count
        last = text[order - 1]
        self.symbols = int(text.max()) + 1
        self.smaller = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=self.symbols))])[:-1].astype(np.int32)
        self.levels: list[tuple[int, int, _Bits]] = []
        for level in range(max(1, (self.symbols - 1).bit_length()) - 1, -1, -1):
            bits = (last >> level) & 1
            zeros = int(len(bits) - bits.sum())
            self.levels.append((level, zeros, _Bits(bits.astype(np.uint8))))
            last = np.concatenate([last[bits == 0], last[bits == 1]])
        self.bottom = self._descend(np.arange(self.symbols), np.zeros(self.symbols, np.int64)).astype(np.int32)

    def _descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level, zeros, bits in self.levels:
            ones = bits.ones(at)
            at = np.where((symbol >> level) & 1, zeros + ones, at - ones)
        return at

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows whose suffixes begin with the symbol followed by what the rows low to high begin with."""
        k = len(symbol)
        at = self._descend(np.concatenate([symbol, symbol]), np.concatenate([low, high]))
        shift = self.smaller[symbol] - self.bottom[symbol]
        return at[:k] + shift, at[k:] + shift


def _suffix_order(text: np.ndarray, stops: np.ndarray, longest: int) -> np.ndarray:
    """Suffixes in order. The end of each sequence is a symbol of its own, so no order reaches beyond it."""
    rank = text + len(stops)
    rank[stops] = np.arange(len(stops))
    n, reach = len(text), 1
    while True:
        further = np.full(n, -1, np.int64)
        further[: n - reach] = rank[reach:] if reach < n else rank[:0]
        key = rank * (n + len(stops) + int(text.max()) + 2) + further + 1
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        fresh = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = fresh
        reach *= 2
        if reach >= longest or fresh[-1] == n - 1:
            return order


def repeated_windows(index: Index, text: np.ndarray, begins: np.ndarray, windows: np.ndarray, width: int) -> np.ndarray:
    """For each pattern a bit mask of its windows that occur twice or more in the index.

    text holds the symbols; a pattern begins at `begins` and has `windows` windows of `width` symbols. A window is
    matched backwards from its end. The matching length tells where it stops: if the symbols from p on don't occur
    twice, no window that begins at p or before and reaches as far can, and the search goes on behind p.
    """
    found = np.zeros(len(begins), np.int64)
    who = np.flatnonzero(windows > 0)
    first = np.zeros(len(who), np.int64)
    at = np.full(len(who), width - 1)
    low, high = np.zeros(len(who), np.int64), np.full(len(who), index.size)
    while len(who):
        low, high = index.extend(text[begins[who] + at], low, high)
        twice = high - low >= 2
        whole = twice & (at == first)
        found[who[whole]] |= np.int64(1) << first[whole]
        again = whole | ~twice
        first = np.where(whole, first + 1, np.where(twice, first, at + 1))
        at = np.where(again, first + width - 1, at - 1)
        low, high = np.where(again, 0, low), np.where(again, index.size, high)
        alive = first < windows[who]
        if not alive.all():
            who, first, at, low, high = who[alive], first[alive], at[alive], low[alive], high[alive]
    return found
