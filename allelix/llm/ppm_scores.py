"""Prediction by partial matching: the code length of every text under a byte-context trie learnt from a corpus.

A text is read as its words in lower case, one space between two, then an end sign; it is spelt symbol by symbol (bytes, and
the end). A trie of contexts of up to ``order`` bytes has for each context the symbols that followed it in the training texts,
with counts. A symbol is looked for in its longest context that was ever seen. With total T and q different symbols there, it
has the probability (c - 1/2) / T; if it is not there, the escape (q / 2) / T is paid and the next shorter context is asked, with
the symbols of the longer one taken out of T and q (symbol exclusion). Below the empty context all remaining symbols are
equally likely. The trie is pretrained: scoring a text does not change it.

How it runs:
1. One pass over the training texts counts words and windows (a context of ``order`` bytes and its symbol) in the tasks, and
   one aggregate adds these counts up. All training texts count; a task holds at most KEPT of its counts between two flushes.
2. The trie is a table for each depth: a row is a node with T, q, its symbols, and the mass that its symbols have in the node
   above it in the suffix order, which is what exclusion takes out there. Each depth is an aggregate of the one below.
3. One pass over all texts scores what frequent words and windows say: the ``held_words`` and ``held_windows`` most frequent
   ones (a fixed number, so at most 12 MB and 6 MB) go to all tasks. Each text keeps the others as lists of (key, times).
4. The distinct windows of these lists walk down the trie by joins, one depth at a time; words join their counts; both come
   back to their texts by a join. A frequent key is never in a join, whatever its share of the rows.
What is held in step 3 changes no result (tested). Words are known by 128 bits: 64 name them, and if the other 64 show that a
name stands for two words, all is counted again with another seed.

Defined results: null and empty texts are an end sign only; null ids are neither learnt from nor held out; if there is nothing
to learn from, the base is as its formula says and all symbols are equally likely; a very long text is read in parts with
the same result; repeated rows count as often as they occur and each get a row; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Folders, Words, let_go, mapped, slices, small_batches, string_hashes

#: Bytes that no UTF-8 text has: before a text, and the end sign. Symbols are 0 to END.
PAD, END = 0xFF, 0xFE
SYMBOLS = END + 1
#: Positions of text worked on at once, and counts that a task holds between two flushes.
PART, KEPT = 1 << 19, 1 << 20
#: Kinds of counts: of texts, words, windows.
TEXTS, WORDS, WINDOWS = 0, 1, 2

SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, n_symbols long, base_score double, score double, words array<struct<word: long, check: long, n: long>>, windows array<struct<window: long, n: long>>"


@dataclass(frozen=True)
class Trie:
    """order: bytes of the longest context (6 at most). held_windows, held_words: the most that all tasks hold."""

    order: int = 5
    held_windows: int = 1 << 19
    held_words: int = 1 << 18


def spelt(words: Words, order: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For parts of the batch: the window of each symbol (context, then symbol, a byte each) and its text."""
    lists = pa.ListArray.from_arrays(pa.array(words.first, pa.int32()), pc.ascii_lower(words.values))
    joined = pc.binary_join(lists, " ").cast(pa.large_binary())
    bounds = np.frombuffer(joined.buffers()[1], np.int64)[: len(joined) + 1]
    data = np.frombuffer(joined.buffers()[2], np.uint8) if bounds[-1] else np.empty(0, np.uint8)
    size = np.diff(bounds)
    start = bounds[:-1] + (order + 1) * np.arange(words.n)  # of each text's pads
    laid = np.full(int(bounds[-1]) + (order + 1) * words.n, PAD, np.uint8)
    body = np.repeat(start + order - bounds[:-1], size)
    laid[np.arange(bounds[-1]) + body] = data[: bounds[-1]]
    laid[start + order - 1] = 0x20  # a text begins as a word does
    laid[start + order + size] = END
    for a in range(0, len(laid) - order, PART):
        b = min(a + PART, len(laid) - order)
        window = laid[a:b].astype(np.uint64)
        for k in range(1, order + 1):
            window <<= np.uint64(8)
            window |= laid[a + k : b + k]
        # Windows that end on a pad, or on the space before the text, are no symbols.
        at = np.arange(a, b) + order
        doc = np.searchsorted(start, at, "right") - 1
        real = at - start[doc] >= order
        yield window[real], doc[real]


class Counts:
    """Sums of counts by key and check, of bounded size."""

    def __init__(self, kind: int):
        self.kind, self.parts, self.held = kind, [], 0

    def add(self, keys: np.ndarray, n: np.ndarray, checks: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.parts.append((keys, n, checks))
        self.held += len(keys)
        if self.held > KEPT:
            self._merge()
            if self.held > KEPT // 2:
                yield from self.rest()

    def _merge(self) -> None:
        keys, n, checks = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.lexsort((checks, keys)) if self.kind == WORDS else np.argsort(keys, kind="stable")
        keys, n, checks = keys[order], n[order], checks[order]
        first = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]) | (checks[1:] != checks[:-1]))) if len(keys) else np.empty(0, int)
        self.parts = [(keys[first], np.add.reduceat(n, first) if len(first) else n[:0], checks[first])]
        self.held = len(first)

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.parts:
            self._merge()
            keys, n, checks = self.parts[0]
            for a in range(0, len(keys), 1 << 16):
                part = slice(a, a + (1 << 16))
                columns = [np.full(len(keys[part]), self.kind, np.int32), keys[part].view(np.int64), checks[part].view(np.int64), n[part].astype(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["kind", "key", "check", "n"])
        self.parts, self.held = [], 0


def word_hashes(words: Words, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each word's place among the batch's distinct words in lower case, and these words' hashes and checks."""
    coded = pc.ascii_lower(words.values).dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), string_hashes(coded.dictionary, 2 * seed), string_hashes(coded.dictionary, 2 * seed + 1)


def counted(texts: DataFrame, trie: Trie, seed: int) -> DataFrame:
    """kind, key, check, n, clash: what the training texts (column text) have of words and windows."""
    small_batches(texts.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, windows, n_texts = Counts(WORDS), Counts(WINDOWS), 0
        for batch in batches:
            for part in slices(batch, "text"):
                words = Words(part.column("text"))
                n_texts += words.n
                if len(words.values):
                    code, name, check = word_hashes(words, seed)
                    yield from own.add(name, np.bincount(code, minlength=len(name)), check)
                for window, _ in spelt(words, trie.order):
                    keys, n = np.unique(window, return_counts=True)
                    yield from windows.add(keys, n, np.zeros(len(keys), np.uint64))
        yield from own.rest()
        yield from windows.rest()
        del own, windows
        yield pa.RecordBatch.from_arrays([pa.array([TEXTS], pa.int32()), pa.array([0]), pa.array([0]), pa.array([n_texts])], ["kind", "key", "check", "n"])
        let_go()

    each = texts.mapInArrow(work, "kind int, key long, check long, n long")
    return each.groupBy("kind", "key").agg(F.sum("n").alias("n"), F.min("check").alias("check"), (F.min("check") != F.max("check")).alias("clash"))


def learnt(texts: DataFrame, trie: Trie, own: Folders) -> tuple[DataFrame, int]:
    """counted() without clashes, and its seed."""
    for seed in itertools.count():
        found = own.stored(counted(texts, trie, seed), "counts")
        if not found.where((F.col("kind") == WORDS) & F.col("clash")).limit(1).count():
            return found, seed
        own.forget(keep=0)
    raise AssertionError


def nodes(windows: DataFrame, trie: Trie, own: Folders) -> list[DataFrame]:
    """For each depth its nodes: context, total, symbols (their number), children (symbol -> count), above (see the module)."""
    depth: list[DataFrame] = []
    edges = windows.select("window", "n")
    for o in range(trie.order, -1, -1):
        if o < trie.order:
            edges = edges.groupBy((F.col("window").bitwiseAND((1 << 8 * (o + 1)) - 1)).alias("window")).agg(F.sum("n").alias("n"))
        pairs = F.collect_list(F.struct(F.col("window").bitwiseAND(255).cast("int"), "n"))
        own_nodes = edges.groupBy(F.shiftright("window", 8).alias("context")).agg(F.sum("n").alias("total"), F.count("*").alias("symbols"), F.map_from_entries(pairs).alias("children"))
        depth.append(own.stored(own_nodes, f"nodes-{o}"))
        edges = depth[-1].select("context", F.explode("children").alias("symbol", "n")).select((F.shiftleft("context", 8).bitwiseOR(F.col("symbol").cast("long"))).alias("window"), "n")
    depth.reverse()
    return depth


def with_above(depth: list[DataFrame]) -> list[DataFrame]:
    """The nodes of each depth with ``above``: the count that their symbols have in the context that is a byte shorter."""
    out = [depth[0].withColumn("above", F.lit(0).cast("long"))]
    for o in range(1, len(depth)):
        shorter = depth[o - 1].select(F.col("context").alias("suffix"), F.col("children").alias("all"))
        met = depth[o].join(_bounded(shorter, o - 1), F.col("context").bitwiseAND((1 << 8 * (o - 1)) - 1) == F.col("suffix"))
        above = F.aggregate(F.map_keys("children"), F.lit(0).cast("long"), lambda a, s: a + F.element_at("all", s))
        out.append(met.select("context", "total", "symbols", "children", above.alias("above")))
    return out


def _bounded(rows: DataFrame, o: int) -> DataFrame:
    """Nodes of contexts of one byte or none are broadcast: they are 256 at most, of 255 symbols at most."""
    return F.broadcast(rows) if o < 2 else rows


def code_lengths(windows: DataFrame, depth: list[DataFrame]) -> DataFrame:
    """window, length: log10 of the probability of the symbol in its context, for distinct windows."""
    zero = F.lit(0).cast("long")
    rows = windows.select("window", F.lit(0.0).alias("length"), F.lit(False).alias("done"), zero.alias("gone"), zero.alias("gone_symbols"))
    for o in range(len(depth) - 1, -1, -1):
        context = F.shiftright("window", 8).bitwiseAND((1 << 8 * o) - 1)
        met = rows.withColumn("at", context).join(_bounded(depth[o], o), F.col("at") == F.col("context"), "left")
        n = F.try_element_at("children", F.col("window").bitwiseAND(255).cast("int"))
        seen, left = F.col("context").isNotNull(), F.col("symbols") - F.col("gone_symbols")
        share = F.coalesce(n - 0.5, left / 2) / (F.col("total") - F.col("gone"))
        paid = F.when(F.col("done") | ~seen | (left == 0), 0.0).otherwise(F.log10(share))
        rows = met.select("window", (F.col("length") + paid).alias("length"), (F.col("done") | n.isNotNull()).alias("done"), F.when(seen, F.col("above")).otherwise(0).alias("gone"), F.when(seen, F.col("symbols")).otherwise(0).alias("gone_symbols"))
    rest = F.when(F.col("done"), 0.0).otherwise(-F.log10(F.lit(SYMBOLS) - F.col("gone_symbols")))
    return rows.select("window", (F.col("length") + rest).alias("length"))


def frequent(rows: DataFrame, most: int) -> Column:
    """Which rows have a count n so high that there are at most ``most`` of them, by classes of an eighth of a factor of two."""
    kind = F.floor(F.log2("n") * 8)
    left, least = most, None
    for r in sorted(rows.groupBy(kind.alias("class")).agg(F.count("*").alias("rows")).collect(), key=lambda r: -r["class"]):
        if r["rows"] > left:
            break
        left, least = left - r["rows"], r["class"]
    return kind >= least if least is not None else F.lit(False)


def _held(found: pa.Table, key: str, *values: str) -> tuple[np.ndarray, ...]:
    order = np.argsort(found[key].to_numpy(), kind="stable")
    return tuple(found[c].to_numpy()[order] for c in (key, *values))


def _lists(doc: np.ndarray, rows: int, columns: dict[str, np.ndarray]) -> pa.ListArray:
    """For each text the distinct tuples of its columns with how often they stand there."""
    order = np.lexsort((*reversed(columns.values()), doc))
    doc, values = doc[order], [c[order] for c in columns.values()]
    new = np.append(True, np.any([c[1:] != c[:-1] for c in (doc, *values)], axis=0))[: len(doc)]
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(doc)))
    flat = pa.StructArray.from_arrays([pa.array(c[first].astype(np.int64)) for c in values] + [pa.array(n)], [*columns, "n"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(doc[first], np.arange(rows + 1)), pa.int32()), flat)


def _found(held: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where keys stand in the sorted array, and which do."""
    if not len(held):
        return np.zeros(len(keys), int), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(held, keys), len(held) - 1)
    return at, held[at] == keys


def scores(docs: DataFrame, learn: Column, held_out: Column, id_col: str = "doc_id", text_col: str = "text", trie: Trie = Trie()) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_symbols, bits_per_symbol per row of docs.

    learn: which rows are learnt from; held_out: the column of that name.
    """
    own = Folders(docs.sparkSession)
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"), learn.alias("learn"), held_out.alias("held_out"))
    counts, seed = learnt(rows.where("learn").select("text"), trie, own)
    words, windows = counts.where(F.col("kind") == WORDS).select(F.col("key").alias("word"), "check", "n"), counts.where(F.col("kind") == WINDOWS).select(F.col("key").alias("window"), "n")
    n_texts = counts.where(F.col("kind") == TEXTS).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    facts = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("distinct")).first()
    total, distinct = facts["n"] + n_texts, facts["distinct"] + bool(n_texts)
    depth = with_above(nodes(windows, trie, own))

    log_p = lambda n: np.log10((n + 0.5) / (total + 0.5 * (distinct + 1)))
    own_words = _held(words.where(frequent(words, trie.held_words)).toArrow(), "word", "check", "n")
    often = windows.where(frequent(windows, trie.held_windows)).withColumn("context", F.shiftright("window", 8))
    lengths = often.join(depth[-1].select("context", "total"), "context").select("window", F.log10((F.col("n") - 0.5) / F.col("total")).alias("length"))
    own_windows = _held(lengths.toArrow(), "window", "length")

    def make():
        names, checks, times = own_words
        known, length = own_windows

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = Words(batch.column("text"))
            r, doc = found.n, found.doc
            code, name, check = word_hashes(found, seed) if len(found.values) else (np.empty(0, int), *(np.empty(0, np.uint64),) * 2)
            at, there = _found(names, name.view(np.int64))
            there = there & (checks[at] == check.view(np.int64)) if len(names) else there
            value = np.where(there, log_p(times[at]) if len(names) else 0.0, 0.0)
            base = np.bincount(doc, value[code], r) + log_p(n_texts)
            n_known = np.bincount(doc, there[code], r).astype(np.int64) + bool(n_texts)
            rare = ~there[code]
            rare_words = _lists(doc[rare], r, {"word": name[code[rare]].view(np.int64), "check": check[code[rare]].view(np.int64)})
            score, n_symbols, left = np.zeros(r), np.zeros(r, np.int64), [(np.empty(0, int), np.empty(0, np.int64))]
            for window, text in spelt(found, trie.order):
                distinct_windows, which = np.unique(window.view(np.int64), return_inverse=True)
                at, there = _found(known, distinct_windows)
                value = np.where(there, length[at] if len(known) else 0.0, 0.0)
                score += np.bincount(text, value[which], r)
                n_symbols += np.bincount(text, minlength=r)
                rare = np.flatnonzero(~there[which])
                left.append((text[rare], distinct_windows[which[rare]]))
            text, window = (np.concatenate(x) for x in zip(*left, strict=True))
            columns = [batch.column("doc_id"), batch.column("held_out"), pa.array(found.lengths() + 1), pa.array(n_known), pa.array(n_symbols), pa.array(base), pa.array(score), rare_words, _lists(text, r, {"window": window})]
            return pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "n_tokens", "n_known", "n_symbols", "base_score", "score", "words", "windows"])

        return work

    # Numbered before it is written: the numbers stay as they are read again.
    scored = own.stored(mapped(rows.select("doc_id", "text", "held_out"), make, SCORES).withColumn("row", F.monotonically_increasing_id()), "scored")
    more_windows = scored.select("row", F.inline("windows"))
    lengths = code_lengths(more_windows.select("window").distinct(), depth)
    by_window = more_windows.join(lengths, "window").groupBy("row").agg(F.sum(F.col("n") * F.col("length")).alias("more_score"))
    more_words = scored.select("row", F.inline("words"))
    seen = words.select("word", "check", F.col("n").alias("times"))
    each = more_words.join(seen, ["word", "check"], "left")
    log_c = F.log10((F.coalesce("times", F.lit(0)) + 0.5) / (total + 0.5 * (distinct + 1)))
    by_word = each.groupBy("row").agg(F.sum(F.col("n") * log_c).alias("more_base"), F.sum(F.when(F.col("times") > 0, F.col("n")).otherwise(0)).alias("more_known"))
    done = scored.drop("words", "windows").join(by_window, "row", "left").join(by_word, "row", "left")
    plus = lambda a, b: F.col(a) + F.coalesce(F.col(b), F.lit(0))
    score = plus("score", "more_score")
    return done.select(
        "doc_id", "held_out", "n_tokens", plus("n_known", "more_known").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), plus("base_score", "more_base").alias("base_score"),
        score.alias("score"), "n_symbols", (-score / F.log10(F.lit(2.0)) / F.col("n_symbols")).alias("bits_per_symbol"),
    )
