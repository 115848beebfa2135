"""An FM-index over a sequence of small numbers, with every step done for many queries at once."""

from __future__ import annotations

import numpy as np


def suffix_array(seq: np.ndarray, step: int = 1) -> np.ndarray:
    """Places of the suffixes in order; a suffix that ends is smaller than one that goes on.

    Prefix doubling. Only places whose rank still is shared are sorted again, so the cost of a
    round falls with what is left. ``seq`` may hold ``step`` symbols in each number already.
    """
    n = len(seq)
    if n < 2:
        return np.arange(n)
    order = np.argsort(seq)
    rank, open_ = _ranked(order, seq[order], np.arange(n), n)
    while len(open_):
        # Within a run of equal ranks, order by the rank one step on.
        places = order[open_]
        ahead = places + step
        next_ = np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
        if n < 1 << 21:  # ranks and place fit one number, and numbers sort faster than places
            packed = rank[places] << 42 | next_ << 21 | np.arange(len(places))
            packed.sort()
            sort, key = packed & (1 << 21) - 1, packed >> 21
        else:
            key = rank[places] * (n + 1) + next_
            sort = np.argsort(key)
            key = key[sort]
        order[open_] = places[sort]
        rank, open_ = _ranked(order, key, open_, n, rank)
        step *= 2
    return order


def _ranked(order: np.ndarray, key: np.ndarray, rows: np.ndarray, n: int, rank: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ranks after ``rows`` of the order were sorted by ``key``, and the rows that share one.

    A rank is the first row that has it.
    """
    new = np.concatenate(([True], key[1:] != key[:-1]))
    first = rows[np.flatnonzero(new)]
    if rank is None:
        rank = np.empty(n, np.int64)
    else:
        rank = rank.copy()
    rank[order[rows]] = first[np.cumsum(new) - 1]
    shared = ~new
    shared[:-1] |= ~new[1:]
    return rank, rows[shared]


class WaveletTree:
    """Counts of each symbol in any prefix, from one bit row with running counts per level."""

    def __init__(self, seq: np.ndarray, symbols: int):
        self.levels = max(1, int(symbols - 1).bit_length())
        self.ones, self.zeros = [], []
        for level in reversed(range(self.levels)):
            bit = (seq >> level) & 1
            self.ones.append(np.concatenate(([0], np.cumsum(bit, dtype=np.int32))))
            self.zeros.append(len(seq) - int(self.ones[-1][-1]))
            seq = np.concatenate((seq[bit == 0], seq[bit == 1]))

    def rank(self, symbol: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each end."""
        begin = np.zeros_like(end)
        for i, level in enumerate(reversed(range(self.levels))):
            bit = (symbol >> level) & 1
            one_b, one_e = self.ones[i][begin], self.ones[i][end]
            begin = np.where(bit, self.zeros[i] + one_b, begin - one_b)
            end = np.where(bit, self.zeros[i] + one_e, end - one_e)
        return end - begin

    def access(self, place: np.ndarray) -> np.ndarray:
        """The symbol at each place."""
        symbol = np.zeros_like(place)
        for i in range(self.levels):
            before, after = self.ones[i][place], self.ones[i][place + 1]
            bit = after - before
            symbol = symbol * 2 + bit
            place = np.where(bit, self.zeros[i] + before, place - before)
        return symbol


class FMIndex:
    """Backward search and locating in a sequence of numbers over 0, below ``symbols``."""

    def __init__(self, seq: np.ndarray, symbols: int, sample: int = 8):
        seq = np.append(seq, 0).astype(np.int64)  # the end, smaller than all
        order = suffix_array(seq)
        last = seq[order - 1]
        self.tree = WaveletTree(last, symbols)
        self.before = np.concatenate(([0], np.cumsum(np.bincount(seq, minlength=symbols))))
        kept = order % sample == 0
        self.kept = kept
        self.kept_before = np.cumsum(kept) - kept
        self.kept_place = order[kept]
        self.size = len(seq)

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix range of each pattern; patterns are rows, filled up behind their length."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.size)
        for i in reversed(range(patterns.shape[1])):
            on = np.flatnonzero((i < lengths) & (low < high))
            symbol = patterns[on, i]
            low[on] = self.before[symbol] + self.tree.rank(symbol, low[on])
            high[on] = self.before[symbol] + self.tree.rank(symbol, high[on])
        return low, np.maximum(high, low)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The place in the sequence of each row, by steps back to a sampled one."""
        rows, steps = rows.copy(), np.zeros(len(rows), np.int64)
        open_ = np.flatnonzero(~self.kept[rows])
        while len(open_):
            symbol = self.tree.access(rows[open_])
            rows[open_] = self.before[symbol] + self.tree.rank(symbol, rows[open_])
            steps[open_] += 1
            open_ = open_[~self.kept[rows[open_]]]
        return self.kept_place[self.kept_before[rows]] + steps
