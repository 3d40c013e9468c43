"""The radix sort of windows alone."""

import random

import numpy as np

from phasegrid.llm import substrings


def test_radix_finds_equal_windows():
    rnd = random.Random(8)
    parts = [bytes(rnd.choice(b"ab") for _ in range(rnd.randint(60, 140))) for _ in range(4)]
    for _ in range(30):
        data = b"".join(rnd.choice(parts) for _ in range(rnd.randint(3, 12))) + bytes(rnd.randint(0, 9))
        n = len(data) - substrings.WINDOW + 1
        if n < 1:
            continue
        begin = np.array([rnd.randrange(n) for _ in range(300)])
        group = np.array([rnd.randrange(3) for _ in range(300)])
        windows = [(g, data[b : b + substrings.WINDOW]) for b, g in zip(begin.tolist(), group.tolist())]
        got = substrings.radix(np.frombuffer(data, np.uint8), begin, group)
        assert got.tolist() == [windows.count(w) > 1 for w in windows]
    none = substrings.radix(np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64))
    assert none.tolist() == []


def test_radix_tells_the_last_byte():
    one = bytes(range(199))
    data = np.frombuffer(one + b"x" + one + b"y" + one + b"x", np.uint8)
    assert substrings.radix(data, np.array([0, 200, 400]), np.zeros(3, np.int64)).tolist() == [True, False, True]


def test_equal_hashes_are_not_equal_runs(monkeypatch):
    raw = b"a" * 250 + b"b" * 250
    first, n = np.array([0, 250, 0]), np.array([51, 51, 51])
    assert substrings._same(raw, first, n, np.zeros(3, np.uint64)).tolist() == [0, 1, 0]
