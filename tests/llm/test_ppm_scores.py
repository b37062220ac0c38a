"""Code lengths and base scores against a plain walk down a trie of dicts."""

import math
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from allelix.llm import ppm_scores
from allelix.llm.ppm_scores import END, PAD, Trie
from allelix.llm.queries import op11_ppm_scores
from tests.llm.conftest import SF


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def symbols(text, order):
    """Contexts and symbols of a text."""
    row = [PAD] * (order - 1) + [32] + list(" ".join(words_of(text)).encode()) + [END]
    return [(tuple(row[i - order : i]), row[i]) for i in range(order, len(row))]


def plain(train, texts, order):
    """(n_tokens, n_known, train_tokens, base_score, score) of each text."""
    tokens = Counter(w for t in train for w in [*words_of(t), None])
    total, distinct = sum(tokens.values()), len(tokens)
    trie = defaultdict(Counter)
    for t in train:
        for context, s in symbols(t, order):
            for o in range(order + 1):
                trie[context[order - o :]][s] += 1
    out = []
    for t in texts:
        own = [*words_of(t), None]
        base = sum(math.log10((tokens[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in own)
        score = 0.0
        for context, s in symbols(t, order):
            gone = set()
            for o in range(order, -1, -1):
                node = {k: n for k, n in trie.get(context[order - o :], {}).items() if k not in gone}
                if not node:
                    continue
                if s in node:
                    score += math.log10((node[s] - 0.5) / sum(node.values()))
                    break
                score += math.log10(len(node) / 2 / sum(node.values()))
                gone |= set(node)
            else:
                score -= math.log10(END + 1 - len(gone))
        out.append((len(own), sum(tokens[w] > 0 for w in own), total, base, score))
    return out


TEXTS = ["the cat sat on the mat", "The CAT sat", "", None, "a dog and a cat\n\tsat  there", "zzz qqq \U0001f600 é", "abracadabra " * 30, "the the the", "É É x y", " \n "]


def scored(df, **options):
    part = F.col("doc_id") % 5
    return ppm_scores.scores(df, part != 1, F.coalesce(part == 1, F.lit(False)), **options)


@pytest.mark.parametrize("trie", [Trie(), Trie(order=2, held_windows=8, held_words=4), Trie(order=1, held_windows=0, held_words=0), Trie(order=6)])
def test_plain(spark, trie, monkeypatch):
    monkeypatch.setattr(ppm_scores, "PART", 50)
    df = spark.createDataFrame([(i, t, "x", 1.0) for i, t in enumerate(TEXTS)], "doc_id long, text string, word string, score double").repartition(3)
    got = {r["doc_id"]: r for r in scored(df, trie=trie).collect()}
    want = plain([t for i, t in enumerate(TEXTS) if i % 5 != 1], TEXTS, trie.order)
    assert len(got) == len(TEXTS)
    for i, (n, known, total, base, score) in enumerate(want):
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (n, known, total, i % 5 == 1)
        assert r["base_score"] == pytest.approx(base, rel=1e-9) and r["score"] == pytest.approx(score, rel=1e-9)


def test_whole_table(spark, texts, docs):
    held = {r["doc_id"] for r in docs.where("crc32(cast(cast(doc_id AS string) AS binary)) % 5 = 1").collect()}
    got = {r["doc_id"]: r for r in op11_ppm_scores(spark, SF).collect()}
    assert {i for i, r in got.items() if r["held_out"]} == held
    few = sorted(texts, key=lambda i: len(texts[i]))[::20]
    for i, (n, known, total, base, score) in zip(few, plain([t for i, t in texts.items() if i not in held], [texts[i] for i in few], 5), strict=True):
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (n, known, total)
        assert r["base_score"] == pytest.approx(base, rel=1e-9) and r["score"] == pytest.approx(score, rel=1e-9)


def test_probabilities_sum_to_one(spark):
    """Over all symbols after any context, seen or not."""
    order = 2
    train = ["abab abba", "ba ba", "c"]
    df = spark.createDataFrame([(0, t) for t in train], "doc_id long, text string")
    contexts = [b"ab", b"b ", b"zz", b"zb", bytes([PAD, 32])]
    windows = [(int.from_bytes(c, "big") << 8 | s,) for c in contexts for s in range(END + 1)]
    own = ppm_scores.Folders(spark)
    trie = Trie(order=order)
    counts, _ = ppm_scores.learnt(df.select("text"), trie, own)
    depth = ppm_scores.with_above(ppm_scores.nodes(counts.where("kind = 2").select(F.col("key").alias("window"), "n"), trie, own))
    found = ppm_scores.code_lengths(spark.createDataFrame(windows, "window long"), depth)
    sums = found.groupBy(F.shiftright("window", 8).alias("c")).agg(F.sum(F.pow(F.lit(10.0), "length")).alias("p")).collect()
    assert len(sums) == 5 and all(r["p"] == pytest.approx(1) for r in sums)


def test_odd(spark, odd, none):
    got = ppm_scores.scores(odd, F.col("doc_id").isNotNull(), F.lit(False)).collect()
    assert len(got) == odd.count() and all(r["score"] < 0 for r in got)
    assert ppm_scores.scores(none, F.lit(True), F.lit(False)).count() == 0
    r = ppm_scores.scores(odd.where("doc_id = 1").limit(1), F.lit(False), F.lit(True)).first()
    assert (r["train_tokens"], r["base_score"], r["n_known"]) == (0, 0.0, 0) and r["score"] == pytest.approx(-6 * math.log10(255))
