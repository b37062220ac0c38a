"""Maximal repeats by intervals of the suffix array, against all substrings of small texts."""

import random
from collections import defaultdict

import numpy as np
import pyarrow as pa

from allelix.llm import quality_rules


def brute(words, least):
    """Substrings of ``least`` words or more that occur twice and lose an occurrence when prolonged to either side."""
    places = defaultdict(list)
    for a in range(len(words)):
        for b in range(a + least, len(words) + 1):
            places[tuple(words[a:b])].append(a)
    out = {}
    for w, at in places.items():
        left = {words[a - 1] if a else None for a in at}
        right = {words[a + len(w)] if a + len(w) < len(words) else None for a in at}
        if len(at) > 1 and (len(left) > 1) and (len(right) > 1):
            out[w] = at
    return out


def test_maximal_repeats():
    r = random.Random(4)
    for least in (3, 4, 8):
        limits = quality_rules.Limits(min_repeat=least)
        for _ in range(150):
            docs = [" ".join(r.choices("abcd"[: r.randint(1, 4)], k=r.choice((0, 5, 40)))) for _ in range(3)]
            got = quality_rules.measure(pa.array(docs), limits)
            for d, text in enumerate(docs):
                want = brute(text.split(), least)
                assert got["n_maximal_repeats"][d] == len(want), text
                assert got["longest_repeat"][d] == max(map(len, want), default=0)
                assert got["covered_words"][d] == len({a + k for w, at in want.items() for a in at for k in range(len(w))})


def test_one_word_many_times():
    n = 200_000
    got = quality_rules.measure(pa.array(["word " * n]), quality_rules.Limits())
    assert got["n_maximal_repeats"][0] == n - 8 and got["longest_repeat"][0] == n - 1 and got["covered_words"][0] == n
    assert sorted(quality_rules.intervals(np.array([2, 3, 3, 0, 1])).tolist()) == [[0, 3, 2], [1, 3, 3], [4, 5, 1]]
