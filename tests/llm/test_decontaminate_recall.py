"""Recall of decontamination on edited items that stand between other words, by item length."""

import random

import pyarrow as pa
import pytest

from allelix.llm import decontaminate


def between_words(lengths, rate, n=300, seed=5):
    """Share of n items of these lengths found after edits, with 30 other words before and after."""
    r = random.Random(seed)
    new = lambda: f"w{r.randrange(10**9)}"
    words = [[new() for _ in range(r.choice(lengths))] for _ in range(n)]
    items = decontaminate.Items(list(range(n)), pa.array([" ".join(w) for w in words]), decontaminate.Plan())
    texts = []
    for w in words:
        w = list(w)
        for _ in range(int(rate * len(w))):
            at, kind = r.randrange(len(w)), r.randrange(3)
            w[at : at + (kind != 1)] = [] if kind == 2 else [new()]
        texts.append(" ".join([new() for _ in range(30)] + w + [new() for _ in range(30)]))
    values, doc = decontaminate.normal_words(pa.array(texts))
    return sum(d == i for d, i, _, _ in items.verified(values, doc, n)) / n


@pytest.mark.parametrize("lengths", [range(15, 20), range(20, 30), range(30, 60), range(15, 60)])
def test_edited_items_between_words(lengths):
    assert between_words(lengths, 0.2) >= 0.98


@pytest.mark.parametrize("n", range(5, 20))
def test_short_items_are_all_found(n):
    assert between_words([n], 0) == 1 and between_words([n], 0.2) == 1


def test_class_that_walks_miss_goes_by_pieces():
    few = decontaminate.Plan(most=1, recall=1.0)
    items = decontaminate.Items([1], pa.array([" ".join(f"w{k}" for k in range(25))]), few)
    assert not items.tables and items.pieces
    values, doc = decontaminate.normal_words(pa.array(["a b " + " ".join(f"w{k}" if k % 5 else "new" for k in range(25)) + " c d"]))
    assert [(i, x) for _, i, x, _ in items.verified(values, doc, 1)] == [(0, 5)]
