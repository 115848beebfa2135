"""The indexes that operators build, against sorted lists and counts."""

import random
from collections import defaultdict

import numpy as np
import pytest

from tidemark.llm.fm_index import FMIndex, WaveletTree, suffix_array
from tidemark.llm.long_matches import LENGTH, anchors, without_inner
from tidemark.llm.run_index import RunIndex, repeated_starts


def sequences():
    random.seed(5)
    for i in range(120):
        n, k = random.randrange(0, 90), random.choice([1, 2, 3, 20])
        own = [random.randrange(1, k + 1) for _ in range(n)]
        yield np.array(own + own[: n // 2] + own if i % 3 == 0 else own, np.int64)


def test_suffix_array_sorts_suffixes():
    for seq in sequences():
        assert suffix_array(seq).tolist() == sorted(range(len(seq)), key=lambda i, s=seq.tolist(): s[i:])


def test_wavelet_tree_counts_and_gives_symbols():
    seq = np.array([random.Random(1).randrange(9) for _ in range(200)])
    tree = WaveletTree(seq, 9)
    for end in (0, 1, 77, 200):
        for symbol in range(9):
            assert tree.rank(np.array([symbol]), np.array([end]))[0] == (seq[:end] == symbol).sum()
    assert tree.access(np.arange(200)).tolist() == seq.tolist()


def test_search_and_locate_find_every_occurrence():
    for seq in sequences():
        if not len(seq):
            continue
        index, symbols = FMIndex(seq, int(seq.max()) + 2), seq.tolist()
        for n in (1, 2, 4):
            patterns = np.array([symbols[i : i + n] for i in range(len(symbols) - n + 1)] + [[int(seq.max()) + 1] * n])
            low, high = index.search(patterns, np.array([n] * len(patterns)))
            for p, a, b in zip(patterns.tolist(), low, high, strict=True):
                want = [i for i in range(len(symbols) - n + 1) if symbols[i : i + n] == p]
                assert sorted(index.locate(np.arange(a, b)).tolist()) == want


@pytest.mark.parametrize("length", [1, 3, 8])
def test_matching_statistics_find_repeated_strings(length):
    for n, seq in enumerate(sequences()):
        if len(seq) < 2:
            continue
        seq = seq.copy()
        if n % 2:
            seq[:: max(3, len(seq) // 4)] = 0
        where, symbols = defaultdict(list), seq.tolist()
        for i in range(len(symbols) - length + 1):
            if 0 not in symbols[i : i + length]:
                where[tuple(symbols[i : i + length])].append(i)
        places, kinds = repeated_starts(seq, length)
        assert places.tolist() == sorted(i for x in where.values() if len(x) > 1 for i in x)
        of = {(tuple(symbols[p : p + length]), k) for p, k in zip(places.tolist(), kinds.tolist(), strict=True)}
        assert len(of) == len({s for s, _ in of}) == len({k for _, k in of})


def test_repetition_makes_few_runs():
    own = np.random.default_rng(0).integers(1, 30, 500)
    assert RunIndex(np.tile(own, 20)).runs < 2 * RunIndex(own).runs


def test_equal_strings_have_equal_anchors():
    random.seed(9)
    shared = bytes(random.randrange(256) for _ in range(LENGTH))
    found = []
    for n in (0, 50, 333):
        data = np.frombuffer(random.randbytes(n) + shared + random.randbytes(70), np.uint8)
        places, values = anchors(data)
        found.append({(int(p) - n, int(v)) for p, v in zip(places, values, strict=True) if n <= p <= n + 200})
    assert set.intersection(*found)


def test_periodic_stretches_keep_few_anchors():
    data = np.frombuffer(b"begin" + b"abcdefg" * 3000 + b"end", np.uint8)
    places, _, stretches = without_inner(*anchors(data))
    assert len(places) < 20 and sum(b - a for a, b in stretches) > 20_000
