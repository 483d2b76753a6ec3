"""Compressed full-text index of integer sequences: Burrows-Wheeler transform in a wavelet matrix.

Everything is vectorised over many searches at a time: a step of backward search is a few passes
over arrays with one entry per search.
"""

from __future__ import annotations

import numpy as np


class BitVector:
    """Packed bits with the number of ones before each 64-bit word."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        counts = np.bitwise_count(self.words).astype(np.int32)
        self.before = np.cumsum(counts, dtype=np.int32) - counts

    def ones(self, at: np.ndarray) -> np.ndarray:
        """Set bits before each place."""
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)


class WaveletMatrix:
    """Occurrences of a symbol before a place, one bit vector per bit of the symbols."""

    def __init__(self, sequence: np.ndarray, symbols: int):
        self.levels = []
        for bit in range(max(1, int(symbols - 1).bit_length()) - 1, -1, -1):
            on = (sequence >> bit & 1).astype(bool)
            self.levels.append((bit, BitVector(on), int(len(on) - on.sum())))
            sequence = np.concatenate([sequence[~on], sequence[on]])
        zero = np.zeros(symbols, np.int32)
        self.start = self._place(np.arange(symbols, dtype=np.int32), zero)

    def _place(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for bit, vector, zeros in self.levels:
            ones = vector.ones(at)
            at = np.where(symbol & (1 << bit), ones + np.int32(zeros), at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self._place(symbol, at) - self.start[symbol]


def suffix_order(ranks: np.ndarray, longest: int) -> np.ndarray:
    """Order of the suffixes of a sequence in which no two are equal over ``longest`` symbols."""
    n, k = len(ranks), 1
    order = np.argsort(ranks, kind="stable")
    while k <= longest:
        later = np.zeros(n, np.int64)
        later[: max(0, n - k)] = ranks[k:] + 1
        key = ranks * (n + 2) + later
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        new = np.concatenate([[0], np.cumsum(sorted_key[1:] != sorted_key[:-1])])
        ranks = np.empty(n, np.int64)
        ranks[order] = new
        if new[-1] == n - 1:
            break
        k *= 2
    return order


class FMIndex:
    """Index of sequences of word numbers 0..words-1.  Matches never cross sequences."""

    def __init__(self, sequences: list[np.ndarray], words: int):
        sizes = np.array([len(s) for s in sequences], np.int64)
        # One separator (symbol 0) after each sequence; words are shifted by one.
        self.starts = np.cumsum(sizes + 1) - (sizes + 1)
        # Places and symbols of a shard fit 32 bits.
        self.text = np.zeros(int((sizes + 1).sum()), np.int32)
        inside = np.ones(len(self.text), bool)
        inside[self.starts + sizes] = False
        if len(sequences):
            self.text[inside] = np.concatenate(sequences) + 1
        # For the order, each separator is a symbol of its own: a suffix ends with it.
        ranks = np.where(inside, self.text.astype(np.int64) + len(sizes), np.cumsum(~inside) - 1)
        ranks = np.unique(ranks, return_inverse=True)[1].astype(np.int64)
        order = suffix_order(ranks, int(sizes.max(initial=0)) + 1)
        counts = np.bincount(self.text, minlength=words + 1)
        self.first = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
        self.matrix = WaveletMatrix(self.text[order - 1], words + 1)

    def intervals(self, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Backward search of ``length`` symbols from each text place ``at``.

        Returns the suffix intervals [low, high); a search whose interval shrinks to its own
        suffix alone stops there, with high - low = 1.
        """
        symbol = self.text[at + length - 1]
        low, high = self.first[symbol].copy(), self.first[symbol + 1].copy()
        live = np.flatnonzero(high - low > 1)
        for j in range(length - 2, -1, -1):
            symbol = self.text[at[live] + j]
            both = self.matrix.rank(
                np.concatenate([symbol, symbol]), np.concatenate([low[live], high[live]])
            )
            both += np.concatenate([self.first[symbol]] * 2)
            low[live], high[live] = both[: len(live)], both[len(live) :]
            live = live[high[live] - low[live] > 1]
        return low, high
