"""Quality rules with suffix-array repetition.

Per text, a suffix array over its words is built by prefix doubling that starts at three words, for all texts
of a batch at once (numpy). The arrays of ranks give the common prefix of neighbours by descent over the levels.
A stack over these prefixes gives the intervals: runs of suffixes that share a number of words that no longer run shares.
An interval's words cannot be prolonged to the right without losing an occurrence; where the words before its occurrences
differ, nor to the left, and the interval is one maximal repeat. The union of the spans of maximal repeats of
``min_repeat`` words or more and the longest of them are limited. An interval that can be prolonged to the left lies
inside the spans of the longer one, so the union is that of each suffix's deepest interval, found without listing
the occurrences of every interval (these can be quadratic in number).

Nothing is shuffled: a text is judged alone, in the task that reads it.

Defined results: a null text has no words and fails (fewer than 50 words), as do empty texts; repeated rows each
get their row; an empty table gives an empty result; null ids are carried along; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import Words, ids_and_text, mapped

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, n_maximal_repeats long, covered_words long, longest_repeat long"
)


@dataclass(frozen=True)
class Limits:
    """min_words, repeat_percent: the base rule. min_repeat: words of a repeat that counts.
    covered_percent: most of the words that maximal repeats may cover. longest: words of the longest repeat allowed.
    """

    min_words: int = 50
    repeat_percent: int = 50
    min_repeat: int = 8
    covered_percent: int = 40
    longest: int = 400


def grouped(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order, start of each element's group in that order, and whether the group has company; in sorted order."""
    order = np.argsort(key, kind="stable") if len(key) < 2 else np.argsort(key)
    new = np.ones(len(key), bool)
    ordered = key[order]
    new[1:] = ordered[1:] != ordered[:-1]
    starts = np.flatnonzero(new)
    which = np.cumsum(new) - 1
    sizes = np.diff(np.append(starts, len(key)))
    return order, starts[which], sizes[which] > 1


def rank_levels(code: np.ndarray, doc: np.ndarray, end: np.ndarray) -> tuple[list[tuple[int, np.ndarray]], np.ndarray]:
    """Ranks by the first 3, 6, 12, ... words until all differ, and the positions whose first three words recur, in suffix order.

    end: for each position the end of its text. All ranks follow the order of suffixes.
    """
    n = len(code)
    place, wide = np.arange(n), int(code.max()) + 2
    word = lambda k: np.where(place + k < end, code[np.minimum(place + k, n - 1)] + 1, 0)  # noqa: E731  0 stands after the text's end
    order, start, many = grouped((doc * wide + word(0)) * wide + word(1))
    pair = np.empty(n, np.int64)
    pair[order] = start
    order, start, many = grouped(pair * wide + word(2))
    rank = np.empty(n, np.int64)
    rank[order] = start
    active, k = order[many], 3
    recurring = active
    levels = [(3, rank)]
    while len(active):
        follow = np.where(active + k < end[active], rank[np.minimum(active + k, n - 1)], -1) + 1
        order, start, many = grouped(rank[active] * (n + 1) + follow)
        # A group's new ranks start at its old rank: active positions of one group stand together, so count from there.
        moved = active[order]
        old = rank[moved]
        first = np.ones(len(moved), bool)
        first[1:] = old[1:] != old[:-1]
        base = np.maximum.accumulate(np.where(first, np.arange(len(moved)), 0))
        rank = rank.copy()
        rank[moved] = old + start - base
        k *= 2
        levels.append((k, rank))
        active = moved[many]
    if len(recurring):
        recurring = recurring[np.argsort(rank[recurring])]
    return levels, recurring


def common_prefix(a: np.ndarray, b: np.ndarray, levels: list[tuple[int, np.ndarray]], code: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Words that the suffixes at a and b of one text share."""
    n, length = len(code), np.zeros(len(a), np.int64)
    for k, rank in reversed(levels):
        x, y = np.minimum(a + length, n - 1), np.minimum(b + length, n - 1)
        same = (a + length < n) & (b + length < n) & (rank[x] == rank[y]) & (doc[x] == doc[a]) & (doc[y] == doc[a])
        length += np.where(same, k, 0)
    for _ in range(2):
        x, y = np.minimum(a + length, n - 1), np.minimum(b + length, n - 1)
        same = (a + length < n) & (b + length < n) & (code[x] == code[y]) & (doc[x] == doc[a]) & (doc[y] == doc[a])
        open_ = same if _ == 0 else open_ & same
        length += open_
    return length


def intervals(shared: np.ndarray) -> np.ndarray:
    """(first suffix, last suffix, words) of each interval, shared being the words that suffixes i and i + 1 have in common."""
    out, stack, before = [], [], -2
    places = np.flatnonzero(shared)
    for i, words in zip(places.tolist(), shared[places].tolist(), strict=True):
        if i != before + 1:
            out += [(left, before + 1, k) for k, left in stack]
            stack.clear()
        left = i
        while stack and stack[-1][0] > words:
            k, left = stack.pop()
            out.append((left, i, k))
        if not stack or stack[-1][0] < words:
            stack.append((words, left))
        before = i
    out += [(left, before + 1, k) for k, left in stack]
    return np.array(out, np.int64).reshape(-1, 3)


def maximal(suffixes: np.ndarray, shared: np.ndarray, code: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The intervals with different words (or a text's start) before their occurrences."""
    found = intervals(shared)
    if not len(found):
        return found
    before = np.where(suffixes > 0, code[suffixes - 1], -1)
    before[np.isin(suffixes, first)] = -1
    changes = np.concatenate([[0], np.cumsum(before[1:] != before[:-1])])
    return found[changes[found[:, 1]] > changes[found[:, 0]]]


def repeats(code: np.ndarray, doc: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each position: words of the longest prefix that recurs in its text (0 if under three), and whether its first three words recur.

    Also the recurring suffixes in order, and the words that each shares with the next (0 if under three).
    """
    n = len(code)
    longest, recurs = np.zeros(n, np.int64), np.zeros(n, bool)
    levels, suffixes = rank_levels(code, doc, first[1:][doc]) if n else ([], np.empty(0, np.int64))
    recurs[suffixes] = True
    neighbours = np.zeros(max(0, len(suffixes) - 1), np.int64)
    if len(suffixes) > 1:
        a, b = suffixes[:-1], suffixes[1:]
        near = levels[0][1][a] == levels[0][1][b]
        a, b = a[near], b[near]
        shared = common_prefix(a, b, levels, code, doc)
        neighbours[near] = shared
        np.maximum.at(longest, a, shared)
        np.maximum.at(longest, b, shared)
    return longest, recurs, suffixes, neighbours


def covered(start: np.ndarray, length: np.ndarray, n: int) -> np.ndarray:
    """Which of n positions the spans cover."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + length, -1)
    return np.cumsum(edge[:-1]) > 0


SYMBOLS = np.zeros(256, np.int64)
SYMBOLS[list(b"#*$%&|<>")] = 1


def byte_counts(texts: pa.Array, wanted: np.ndarray) -> np.ndarray:
    """Per text, the number of bytes that the table marks."""
    joined = pc.fill_null(texts, "").cast(pa.large_binary())
    offsets = np.frombuffer(joined.buffers()[1], np.int64)[joined.offset : joined.offset + len(joined) + 1]
    data = joined.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(data) else np.empty(0, np.uint8)
    total = np.concatenate([[0], np.cumsum(wanted.astype(np.uint8)[data], dtype=np.int64)])
    return total[offsets[1:] - offsets[0]] - total[offsets[:-1] - offsets[0]]


def dup_lines(texts: pa.Array) -> np.ndarray:
    """Per text, the lines with a word that equal an earlier line."""
    lists = pc.split_pattern(pc.fill_null(texts, ""), "\n")
    flat = lists.flatten()
    doc = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    full = pc.greater(pc.binary_length(pc.ascii_trim(flat, " \t\n\x0b\x0c\r")), 0).to_numpy(zero_copy_only=False)
    code = flat.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)[full]
    doc = doc[full]
    distinct = np.unique(doc * (len(flat) + 1) + code) // (len(flat) + 1)
    return np.bincount(doc, minlength=len(lists)) - np.bincount(distinct, minlength=len(lists))


def measure(texts: pa.Array, limits: Limits) -> dict[str, np.ndarray]:
    words = Words(texts)
    code, _ = words.coded()
    n, doc, docs = words.lengths(), words.doc, words.n
    per = lambda x: np.bincount(doc, weights=x, minlength=docs).astype(np.int64)
    longest, recurs, suffixes, shared = repeats(code, doc, words.first)
    at = np.flatnonzero(recurs)
    in_window = covered(at, np.full(len(at), 3), len(code))
    found = maximal(suffixes, np.where(shared >= limits.min_repeat, shared, 0), code, words.first)
    repeated = doc[suffixes[found[:, 0]]]
    at = np.flatnonzero(longest >= limits.min_repeat)
    union = covered(at, longest[at], len(code))
    top = np.zeros(docs, np.int64)
    np.maximum.at(top, repeated, found[:, 2])
    out = {"n_words": n, "word_chars": per(pc.utf8_length(words.values).to_numpy(zero_copy_only=False)), "n_symbols": byte_counts(texts, SYMBOLS), "n_dup_lines": dup_lines(texts), "n_repeat_words": per(in_window)}
    failed = (n < limits.min_words) | (100 * out["n_repeat_words"] > limits.repeat_percent * n)
    n_covered = per(union)
    kept = ~failed & (100 * n_covered <= limits.covered_percent * n) & (top <= limits.longest)
    return out | {"base_failed": failed, "kept": kept, "n_maximal_repeats": np.bincount(repeated, minlength=docs), "covered_words": n_covered, "longest_repeat": top}


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limits: Limits = Limits()) -> DataFrame:
    """One row of SCHEMA per row of docs."""

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id")} | {k: pa.array(v) for k, v in measure(batch.column("text"), limits).items()})

        return work

    return mapped(ids_and_text(docs, id_col, text_col), make, SCHEMA)


def keep_good(docs: DataFrame, text_col: str = "text", limits: Limits = Limits()) -> DataFrame:
    """The rows of docs that pass, with their own columns."""

    def make():
        return lambda batch: batch.filter(pa.array(measure(batch.column(text_col), limits)["kept"]))

    return mapped(docs, make, docs.schema, text_col)
