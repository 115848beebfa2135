"""Minimal perfect hash of distinct 128-bit digests, in levels of bit arrays.

Every level hashes the keys that are left to a bit array; keys alone on their bit stay there,
the others go on. A key's number is the count of set bits before its own, so n keys get the
numbers 0 to n - 1 in some 4 bits each. Digests outside the set may get a number too: who asks
compares a fingerprint stored under it.
"""

from __future__ import annotations

import numpy as np

#: Bits of a level for each key that enters it.
ROOM = 2.0


def _place(hi: np.ndarray, lo: np.ndarray, level: int, size: int) -> np.ndarray:
    """Bit of each digest in a level."""
    x = hi ^ (lo + np.uint64((level * 0x9E3779B97F4A7C15 + 1) & (2**64 - 1)))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return (x ^ (x >> np.uint64(31))) % np.uint64(size)


class PerfectHash:
    """``sizes`` holds the bits of each level, ``words`` all levels' bits, each padded to 64."""

    def __init__(self, sizes: np.ndarray, words: np.ndarray) -> None:
        self.sizes, self.words = sizes, words
        ends = np.cumsum(np.bitwise_count(words).astype(np.int64))
        self._before = np.concatenate([np.zeros(1, np.int64), ends])
        self._first = np.concatenate([[0], np.cumsum((sizes + 63) // 64)]).astype(np.int64)

    @classmethod
    def build(cls, hi: np.ndarray, lo: np.ndarray) -> PerfectHash:
        """Of distinct digests, given as their two unsigned halves."""
        sizes, parts = [], []
        while len(hi):
            size = max(64, int(ROOM * len(hi)))
            at = _place(hi, lo, len(sizes), size)
            alone = np.bincount(at.astype(np.int64), minlength=size) == 1
            bits = np.zeros((size + 63) // 64 * 64, np.uint8)
            bits[:size] = alone
            sizes.append(size)
            parts.append(np.packbits(bits, bitorder="little").view("<u8"))
            rest = ~alone[at.astype(np.int64)]
            hi, lo = hi[rest], lo[rest]
        return cls(np.array(sizes, np.int64), np.concatenate(parts) if parts else np.zeros(0, np.uint64))

    def numbers(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """The number of each digest, -1 where no level has it."""
        out = np.full(len(hi), -1, np.int64)
        left = np.arange(len(hi))
        for level, size in enumerate(self.sizes.tolist()):
            at = _place(hi[left], lo[left], level, size)
            word = (self._first[level] + (at >> np.uint64(6)).astype(np.int64)).astype(np.int64)
            bit = np.uint64(1) << (at & np.uint64(63))
            there = (self.words[word] & bit) != 0
            here = word[there]
            below = np.bitwise_count(self.words[here] & (bit[there] - np.uint64(1)))
            out[left[there]] = self._before[here] + below
            left = left[~there]
        return out
