"""Minimal perfect hashing of 64-bit keys by cascaded bit arrays, in numpy.

Level by level, the keys still left are hashed into ``gamma`` times as many positions; a key
alone on its position sets the bit there, the others go on to the next level.  The number of
a key is the rank of its bit.  About three bits per key; a lookup tries 1.6 levels on average.
"""

from __future__ import annotations

import numpy as np

GAMMA = 2.0
FINGERPRINT_LEVEL = 1_000_003  # a level that no build reaches


def hashed(keys: np.ndarray, level: int) -> np.ndarray:
    """64-bit mix of the keys, another one for each level."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64) + np.uint64((level + 1) * 0x9E3779B97F4A7C15 % 2**64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (hashed(keys, FINGERPRINT_LEVEL) & np.uint64(0xFFFFFFFF)).astype(np.uint32)


class PerfectHash:
    """Maps each of the keys it was built from to its own number in 0..n-1.

    Another key may get any number or -1, so callers compare a stored fingerprint.
    """

    def __init__(self, bits: np.ndarray, sizes: list[int]):
        self.bits, self.sizes = bits, sizes
        counts = np.bitwise_count(bits).astype(np.int64)
        self.before = np.cumsum(counts) - counts

    @classmethod
    def build(cls, keys: np.ndarray, gamma: float = GAMMA) -> PerfectHash:
        """``keys`` are distinct."""
        left, parts, sizes = keys.astype(np.uint64), [], []
        while len(left):
            size = 64 * max(1, int(np.ceil(gamma * len(left) / 64)))
            at = (hashed(left, len(sizes)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size)[at] == 1
            flags = np.zeros(size, np.uint8)
            flags[at[alone]] = 1
            parts.append(np.packbits(flags, bitorder="little").view("<u8"))
            sizes.append(size)
            left = left[~alone]
        return cls(np.concatenate(parts) if parts else np.zeros(0, "<u8"), sizes)

    def numbers(self, keys: np.ndarray) -> np.ndarray:
        keys = keys.astype(np.uint64)
        out = np.full(len(keys), -1, np.int64)
        left, base = np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes):
            at = base + (hashed(keys[left], level) % np.uint64(size)).astype(np.int64)
            word, bit = self.bits[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            below = word & ((np.uint64(1) << bit) - np.uint64(1))
            out[left[hit]] = (self.before[at >> 6] + np.bitwise_count(below))[hit]
            left, base = left[~hit], base + size
        return out
