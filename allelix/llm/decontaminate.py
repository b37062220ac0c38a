"""Benchmark decontamination by CGK embedding and bit sampling, with exact edit verification.

Texts and items are sequences of words in lower case without punctuation. A CGK random walk reads a sequence from a
start: at each step it writes the word it stands on, and a hash of step and word says whether it moves on; few edits of
the sequence leave most written positions alike, so edit distance becomes Hamming distance. Sampled positions of the
walk give a key. The walk is started at every word of every text, and at every word of every item that has a window
left to read; equal keys make candidates. Walks are repeated with other hashes until the recall reaches its target in
every class of item lengths. It is measured on the items themselves, edited at the highest rate allowed and put between
other words.

A walk of ``steps`` steps has no room in an item of fewer words. Such items, and those of a class that the walks do not
serve, are found by exact pieces instead: an item that may have k edits is cut into k + 1 pieces, of which k edits leave
one whole, so every place within the limit is a candidate. Nothing is lost there; common pieces cost time only. An item of
fewer words than allow an edit is one piece: it is found where it stands word for word.

Each candidate names a text, an item and a place; the least edit distance (in words) between the whole item and any
stretch of the text around that place is then computed exactly, for many candidates at once. An item is found if
that distance is at most ``rate`` times its words.

Texts are judged alone in the task that reads them: no shuffle. Items go to the tasks in blocks of at most
``block_bytes`` of text; more blocks mean more passes over the texts, so what a task holds has a proven bound.

Defined results: null and empty texts have no items; items with fewer than ``least_words`` words (or null) are not
looked for; repeated items count under each id; repeated rows give repeated results; empty tables an empty result;
other columns are not read.
"""

from __future__ import annotations

import random
from bisect import bisect
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, ids_and_text, mapped, mix, string_hashes

SCHEMA = "doc_id long, item_id long, item_words int, distance int, end_word int"


#: The least words of the classes of item lengths in which recall is measured, and the edited items of each.
CLASSES, TRIALS = (0, 8, 12, 16, 20, 30, 45), 300


@dataclass(frozen=True)
class Plan:
    """rate: edits per word of an item allowed. steps, samples: of a walk, and how many of its positions make a key.
    recall: the target, and most: the walks at most. least_words: of an item. block_bytes: of items at once.
    """

    rate: float = 0.2
    steps: int = 20
    samples: int = 8
    recall: float = 0.99
    most: int = 12
    least_words: int = 1
    seed: int = 3
    block_bytes: int = 8 << 20


def normal_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words in lower case without punctuation, and each one's text."""
    words = Words(texts)
    coded = words.values.dictionary_encode()
    plain = pc.replace_substring_regex(pc.utf8_lower(coded.dictionary), r"[^\pL\pN]+", "")
    hashed = string_hashes(plain) | np.uint64(1)
    code = coded.indices.to_numpy(zero_copy_only=False)
    full = (pc.binary_length(plain).to_numpy(zero_copy_only=False) > 0)[code] if len(code) else np.empty(0, bool)
    return hashed[code[full]] if len(code) else np.empty(0, np.uint64), words.doc[full]


class Walks:
    """The walks' constants and sampled steps."""

    def __init__(self, plan: Plan, n: int):
        draw = np.random.default_rng(plan.seed)
        self.steps = plan.steps
        self.turn = draw.integers(1, 1 << 63, (plan.most, plan.steps)).astype(np.uint64)[:n] * np.uint64(2) + np.uint64(1)
        self.taken = [set(draw.choice(plan.steps, plan.samples, replace=False).tolist()) for _ in range(plan.most)][:n]

    def keys(self, words: np.ndarray, starts: np.ndarray):
        """For each walk, the key from each start; words must end with as many zeros as there are steps."""
        for turn, taken in zip(self.turn, self.taken, strict=True):
            at, key = starts.copy(), np.zeros(len(starts), np.uint64)
            for j in range(max(taken) + 1):
                on = words[at]
                if j in taken:
                    key = key * np.uint64(0x9E3779B97F4A7C15) ^ on
                at += (on * turn[j] >> np.uint64(63)).astype(np.int64)
            yield key


def _laid(parts: list[np.ndarray], gap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sequences in one array with gap zeros after each, where their words stand, and which one each word is of."""
    which = np.repeat(np.arange(len(parts)), [len(x) for x in parts])
    starts = np.arange(len(which)) + gap * which
    laid = np.zeros(len(which) + gap * (len(parts) + 1), np.uint64)
    laid[starts] = np.concatenate(parts)
    return laid, starts, which


def _starts(n: int) -> np.ndarray:
    return np.arange(max(1, n - 4))


def _class(n: int) -> int:
    return CLASSES[bisect(CLASSES, n) - 1]


def _pieces(n: int, edits: int) -> list[tuple[int, int]]:
    """First word and words of each of the edits + 1 pieces that n words are cut into."""
    cut = np.arange(edits + 2) * n // (edits + 1)
    return [(int(a), int(b - a)) for a, b in zip(cut[:-1], cut[1:], strict=True)]


def _piece_keys(words: np.ndarray, starts: np.ndarray, most: int) -> Iterator[tuple[int, np.ndarray]]:
    """For 1, 2, ... most words from each start, the key; words must end with as many zeros."""
    key = np.zeros(len(starts), np.uint64)
    for n in range(1, most + 1):
        key = key * np.uint64(0x9E3779B97F4A7C15) ^ words[starts + (n - 1)]
        yield n, key


def _table(key: np.ndarray, which: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, ...]:
    """Keys in order, their items and places, and the leading bits that occur."""
    order = np.argsort(key, kind="stable")
    some = np.zeros(1 << 20, bool)
    some[key >> np.uint64(44)] = True
    return key[order], which[order], place[order], some


class Items:
    """Benchmark items of one block, their keys, and what is needed to verify candidates."""

    def __init__(self, ids: list, texts: pa.Array, plan: Plan):
        words, item = normal_words(texts)
        cut = np.searchsorted(item, np.arange(len(ids) + 1))
        own = [(i, words[a:b]) for i, a, b in zip(ids, cut[:-1], cut[1:], strict=True) if b - a >= plan.least_words]
        self.ids, self.words = [i for i, _ in own], [w for _, w in own]
        self.allowed = [int(plan.rate * len(w)) for w in self.words]
        self.plan = plan
        n, served = self._repeats(plan)
        long = np.array([i for i, w in enumerate(self.words) if len(w) >= plan.steps and _class(len(w)) in served], int)
        self.walks, self.tables = Walks(plan, n), []
        found = [list(self.walks.keys(np.append(self.words[i], np.zeros(plan.steps, np.uint64)), _starts(len(self.words[i])))) for i in long]
        for k in range(n):
            key = np.concatenate([x[k] for x in found])
            place = np.concatenate([_starts(len(self.words[i])) for i in long])
            self.tables.append(_table(key, np.repeat(long, [len(x[k]) for x in found]), place))
        cut = defaultdict(list)
        for i in np.setdiff1d(np.arange(len(self.words)), long):
            for at, size in _pieces(len(self.words[i]), self.allowed[i]):
                cut[min(size, plan.steps)].append((i, at))
        self.pieces = {}
        for size, places in cut.items():
            which, place = np.array(places).T
            key = dict(_piece_keys(np.concatenate([self.words[i][a : a + size] for i, a in places]), np.arange(len(places)) * size, size))[size]
            self.pieces[size] = _table(key, which, place)

    def recalls(self, plan: Plan) -> dict[int, np.ndarray]:
        """For each class of items with room for a walk, the share that the first 1, 2, ... walks find, edited and between other words."""
        draw, walks, by_class = random.Random(plan.seed), Walks(plan, plan.most), defaultdict(list)
        for w in self.words:
            if len(w) >= plan.steps:
                by_class[_class(len(w))].append(w)
        new = lambda n: [np.uint64(draw.getrandbits(63) | 1) for _ in range(n)]
        out = {}
        for least, own in sorted(by_class.items()):
            trial, texts = draw.choices(own, k=TRIALS), []
            for w in trial:
                edited = list(w)
                for _ in range(int(plan.rate * len(w))):
                    at, kind = draw.randrange(len(edited)), draw.randrange(3)
                    edited[at : at + (kind != 1)] = [] if kind == 2 else new(1)
                texts.append(np.array(new(plan.steps) + edited + new(plan.steps), np.uint64))
            laid, starts, which = _laid(trial, plan.steps)
            first = np.concatenate([np.arange(len(w)) < len(_starts(len(w))) for w in trial])
            sides = [(laid, starts[first], which[first]), _laid(texts, plan.steps)]
            found = np.zeros((plan.most, TRIALS), bool)
            for k, keys in enumerate(zip(*(walks.keys(laid, starts) for laid, starts, _ in sides), strict=True)):
                own_key, text_key = (key ^ mix(which.astype(np.uint64) + np.uint64(1)) for key, (_, _, which) in zip(keys, sides, strict=True))
                found[k, sides[1][2][np.isin(text_key, own_key)]] = True
            out[least] = np.logical_or.accumulate(found).mean(axis=1)
        return out

    def _repeats(self, plan: Plan) -> tuple[int, set[int]]:
        """Walks until the recall reaches the target in every length class that ``most`` walks serve, and these classes."""
        self.recall = self.recalls(plan)
        reached = {least: int(np.argmax(r >= plan.recall)) + 1 for least, r in self.recall.items() if r[-1] >= plan.recall}
        return max(2, *reached.values()) if reached else 0, set(reached)

    def _keys(self, words: np.ndarray, starts: np.ndarray):
        """From each start, the key of each walk and piece length, and the items' table for it."""
        yield from zip(self.walks.keys(words, starts), self.tables, strict=True)
        for n, key in _piece_keys(words, starts, max(self.pieces, default=0)):
            if n in self.pieces:
                yield key, self.pieces[n]

    def candidates(self, words: np.ndarray, doc: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Texts, items, and the place in the text where the item would start; each once for eight places."""
        gap = self.plan.steps
        padded = np.zeros(len(words) + gap * (docs + 1), np.uint64)
        starts = np.arange(len(words)) + gap * doc
        padded[starts] = words
        first = np.searchsorted(doc, np.arange(docs))
        out = []
        for key, (sorted_keys, which, place, some) in self._keys(padded, starts):
            at = np.flatnonzero(some[key >> np.uint64(44)])
            low, high = np.searchsorted(sorted_keys, key[at], "left"), np.searchsorted(sorted_keys, key[at], "right")
            n = high - low
            entry = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
            at = np.repeat(at, n)
            out.append(np.stack([doc[at], which[entry], at - first[doc[at]] - place[entry]], axis=1) // np.array([1, 1, 8]))
        if not out:
            return (np.empty(0, int),) * 3
        d, i, p = np.unique(np.concatenate(out), axis=0).T
        return d, i, p * 8

    def verified(self, words: np.ndarray, doc: np.ndarray, docs: int, at_once: int = 2_000_000) -> list[tuple[int, int, int, int]]:
        """(text, item, distance, end) of the best place of each item found in each text."""
        d, i, p = self.candidates(words, doc, docs)
        first = np.searchsorted(doc, np.arange(docs + 1))
        best: dict[tuple[int, int], tuple[int, int]] = {}
        for item in np.unique(i):
            w, allowed = self.words[item], self.allowed[item]
            wide = len(w) + 2 * (allowed + 8) + 8
            mine = np.flatnonzero(i == item)
            for part in np.array_split(mine, len(mine) * wide // at_once + 1):
                start = np.maximum(p[part] - allowed - 8, 0)
                at = first[d[part]][:, None] + start[:, None] + np.arange(wide)
                inside = at < first[d[part] + 1][:, None]
                region = np.where(inside, words[np.minimum(at, len(words) - 1)], np.uint64(0))
                distance, end = nearest(w, region, allowed)
                end = np.minimum(end + start, (first[d[part] + 1] - first[d[part]]))
                for k in np.flatnonzero(distance <= allowed):
                    pair, now = (int(d[part[k]]), int(item)), (int(distance[k]), int(end[k]))
                    best[pair] = min(best.get(pair, now), now)
        return [(*pair, *now) for pair, now in sorted(best.items())]


def nearest(item: np.ndarray, regions: np.ndarray, allowed: int) -> tuple[np.ndarray, np.ndarray]:
    """Least edit distance of item to any stretch of each region, and where the first such stretch ends.

    A row's least value never falls from one word to the next, so regions beyond allowed are given up (allowed + 1).
    """
    n, wide = regions.shape
    place = np.arange(wide + 1, dtype=np.int16)
    live, row = np.arange(n), np.zeros((n, wide + 1), np.int16)
    distance, end = np.full(n, allowed + 1), np.zeros(n, int)
    for k, word in enumerate(item, 1):
        step = np.empty_like(row)
        step[:, 0] = k
        step[:, 1:] = np.minimum(row[:, :-1] + (regions != word), row[:, 1:] + 1)
        row = np.minimum.accumulate(step - place, axis=1) + place
        if k > allowed and k % 4 == 0:
            near = row.min(axis=1) <= allowed
            live, row, regions = live[near], row[near], regions[near]
            if not len(live):
                return distance, end
    end[live] = row.argmin(axis=1)
    distance[live] = row[np.arange(len(live)), end[live]]
    return distance, end


def item_blocks(items: DataFrame, item_col: str, text_col: str, plan: Plan) -> list[Items]:
    """The items in blocks of about block_bytes of text."""
    rows = items.select(items[item_col].cast("long").alias("item_id"), items[text_col].cast("string").alias("text")).where(F.col("text").isNotNull())
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = size // plan.block_bytes + 1
    blocks = []
    for k in range(n):
        block = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).toArrow().sort_by([("item_id", "ascending"), ("text", "ascending")])
        blocks.append(Items(block.column("item_id").to_pylist(), block.column("text").combine_chunks(), plan))
    return blocks


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", plan: Plan = Plan()) -> DataFrame:
    """One row of SCHEMA for each item found in each row of docs."""
    rows = ids_and_text(docs, id_col, text_col)

    def make(block: Items):
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            words, doc = normal_words(batch.column("text"))
            found = block.verified(words, doc, batch.num_rows) if block.words and len(words) else []
            ids = batch.column("doc_id")
            return pa.RecordBatch.from_pydict({"doc_id": ids.take(pa.array([f[0] for f in found], pa.int64())), "item_id": pa.array([block.ids[f[1]] for f in found], pa.int64()), "item_words": pa.array([len(block.words[f[1]]) for f in found], pa.int32()), "distance": pa.array([f[2] for f in found], pa.int32()), "end_word": pa.array([f[3] for f in found], pa.int32())})

        return work

    passes = [mapped(rows, lambda block=block: make(block), SCHEMA, most=1 << 20) for block in item_blocks(items, item_col, item_text_col, plan)]
    return reduce(DataFrame.unionAll, passes)


def without_items(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", plan: Plan = Plan()) -> DataFrame:
    """The rows of docs in which no item is found, with their own columns."""

    def make(block: Items):
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            words, doc = normal_words(batch.column(text_col))
            clean = np.ones(batch.num_rows, bool)
            if block.words and len(words):
                clean[[f[0] for f in block.verified(words, doc, batch.num_rows)]] = False
            return batch.filter(pa.array(clean))

        return work

    for block in item_blocks(items, item_col, item_text_col, plan):
        docs = mapped(docs, lambda block=block: make(block), docs.schema, text_col, most=1 << 20)
    return docs
