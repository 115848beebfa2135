"""A run-compressed Burrows-Wheeler transform of repetitive bytes, and what it tells of matches."""

from __future__ import annotations

import numpy as np

from tidemark.llm.fm_index import suffix_array

PACKED = 7
"""Symbols of nine bits that fit one number."""


def _packed(seq: np.ndarray) -> np.ndarray:
    n = len(seq)
    padded = np.concatenate((seq.astype(np.int64) + 1, np.zeros(PACKED, np.int64)))  # 0 is the end
    out = np.zeros(n, np.int64)
    for i in range(PACKED):
        out = out << 9 | padded[i : i + n]
    return out


def common_prefixes(words: np.ndarray, a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Length of the common prefix of the suffixes at paired places; ``words`` are packed symbols."""
    length = np.zeros(len(a), np.int64)
    open_ = np.arange(len(a))
    while len(open_):
        x, y = a[open_] + length[open_], b[open_] + length[open_]
        inside = np.maximum(x, y) + PACKED <= n
        same = inside & (words[np.minimum(x, n - 1)] == words[np.minimum(y, n - 1)])
        length[open_[same]] += PACKED
        rest = open_[~same]
        differ = words[np.minimum(a[rest] + length[rest], n - 1)] ^ words[np.minimum(b[rest] + length[rest], n - 1)]
        off = np.maximum(a[rest], b[rest]) + length[rest] >= n
        lead = np.full(len(rest), PACKED)
        for k in range(PACKED):  # the first symbol that differs
            lead = np.where((differ >> (9 * k)) & 511 != 0, PACKED - 1 - k, lead)
        lead = np.minimum(lead, n - np.maximum(a[rest], b[rest]) - length[rest])
        length[rest] += np.where(off, 0, np.maximum(lead, 0))
        open_ = open_[same]
    return length


class RunIndex:
    """Runs of the transform of ``seq`` (symbols from 1, separators 0), sampled at their ends.

    ``heads`` and ``tails`` are the text places at the first and last row of each run, in text
    order, with the common prefix of their suffix and the one above or below. Within a run the
    suffixes one place on are neighbours too, so the common prefixes of all other places follow:
    each is one less than that of the place before.
    """

    def __init__(self, seq: np.ndarray):
        self.size = len(seq)
        words = _packed(seq)
        self.order = suffix_array(words, PACKED)
        last = np.where(self.order > 0, seq[self.order - 1], -1)  # nothing stands before the first
        new = np.flatnonzero(np.concatenate(([True], last[1:] != last[:-1])))
        self.runs = len(new)
        self.heads = self._sampled(words, new, -1)
        self.tails = self._sampled(words, np.append(new[1:], self.size) - 1, 1)

    def _sampled(self, words: np.ndarray, rows: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
        places = self.order[rows]
        other = rows + step
        on = (other >= 0) & (other < self.size)
        length = np.zeros(len(rows), np.int64)
        length[on] = common_prefixes(words, places[on], self.order[other[on]], self.size)
        sort = np.argsort(places)
        return places[sort], length[sort]

    def _streamed(self, sampled: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """The common prefix at every place, from the sampled ones in text order."""
        places, length = sampled
        at = np.searchsorted(places, np.arange(self.size), side="right") - 1
        known = at >= 0
        value = length[at] - (np.arange(self.size) - places[at])
        return np.where(known, np.maximum(value, 0), 0)

    def statistics(self) -> tuple[np.ndarray, np.ndarray]:
        """For each place the longest match elsewhere, and the match with the suffix above."""
        above = self._streamed(self.heads)
        return np.maximum(above, self._streamed(self.tails)), above


def repeated_starts(seq: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places whose string of that length occurs elsewhere, and a number for each such string.

    A string with a separator in it doesn't count.
    """
    index = RunIndex(seq)
    longest, above = index.statistics()
    stops = np.append(np.flatnonzero(seq == 0), len(seq))
    room = stops[np.searchsorted(stops, np.arange(len(seq)))] - np.arange(len(seq))
    places = np.flatnonzero((longest >= length) & (room >= length))
    kind = np.empty(len(seq), np.int64)
    kind[index.order] = np.cumsum(above[index.order] < length)
    return places, kind[places]
