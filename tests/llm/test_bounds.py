"""Time, memory and other bounds: long texts, many languages, short items, and calls beside each other."""

import threading
import time

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from allelix.llm import decontaminate, language_id, line_chunks, segment_samples
from allelix.llm.queries import op7_jaccard_tiles, tokenizer_path
from allelix.llm.sql import OP7
from tests.llm.conftest import SF


def test_line_chunks_of_long_texts_are_linear(spark):
    """Two near-equal texts of four times the lines take less than six times as long."""
    seconds = []
    for n in (2_000, 40_000, 160_000):
        lines = [f"line {k} of the text" for k in range(n)]
        df = spark.createDataFrame([(1, "\n".join(lines)), (2, "\n".join(["x", *lines[1:]]))], "doc_id long, text string")
        began = time.perf_counter()
        got = {r["doc_id"]: r["_kept"] for r in line_chunks.dedup_lines(df).collect()}
        seconds.append(time.perf_counter() - began)
        assert got[1]["n_removed_lines"] == 0 and got[2]["n_removed_lines"] > n * 0.6
    assert seconds[2] < 6 * seconds[1]


def test_many_languages_and_repeated_ids(spark):
    rows = spark.range(40_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text of "), "id").alias("text"), F.concat(F.lit("l"), F.col("id") % 2000).alias("lang"))
    chosen = language_id.rows_by_language(rows, F.lit(True), 1500)
    assert chosen.count() < 3_500 and chosen.select("lang").distinct().count() <= language_id.MOST_LEAST_ROWS
    again = spark.range(100_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("a b c").alias("text"), F.lit("en").alias("lang"))
    assert language_id.rows_by_language(again.unionByName(rows.limit(50)), F.lit(True), 10**9).where("doc_id = 7 AND lang = 'en'").count() == 1


def test_decode_is_the_plain_loop():
    draw = np.random.default_rng(1)
    code = language_id.codewords(4)
    model = {"names": list("abcd"), "code": code, "weights": draw.standard_normal((language_id.BUCKETS, code.shape[1])).astype(np.float32), "offset": draw.standard_normal(code.shape[1]), "bit_weight": draw.random(code.shape[1]) + 0.1}
    texts = pa.array(["one two", "", None, "ÄÖ ß 12", "x" * 500])
    best, score, close = language_id.decode(model, texts, 0.05)
    for i, t in enumerate(texts.to_pylist()):
        data = [x + 32 if 65 <= x <= 90 else x for x in f" {t or str()}  ".encode()]
        framed = [*data, 32, 32]
        codes, starts = language_id.grams(pa.array([t], pa.string()))
        assert len(codes[0]) == len(data) and starts.tolist() == [0]
        side = [float(b) for b in model["offset"]]
        for k in range(len(data)):
            for order in (1, 2, 3):
                key = sum(framed[k + j] << 8 * j for j in range(order)) + (order << 28)
                bucket = (key * 2654435761 % 2**32) >> 18
                for b in range(len(side)):
                    side[b] += float(model["weights"][bucket, b]) / (3 * len(data))
        share = model["bit_weight"] / model["bit_weight"].sum()
        losses = [sum(s * np.logaddexp(0, -x * c) for s, x, c in zip(share, side, row, strict=True)) for row in code]
        order = np.argsort(losses)
        assert best[i] == order[0] and bool(close[i]) == bool(losses[order[1]] - losses[order[0]] < 0.05)
        likely = np.exp(-len(side) * (np.array(losses) - min(losses)))
        assert score[i] == pytest.approx((likely / likely.sum())[order[0]], rel=1e-4)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 7])
def test_short_items(spark, n):
    words = [f"Word{k}" for k in range(n)]
    items = spark.createDataFrame([(1, " ".join(words)), (2, ""), (3, "...")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "before " + " ".join(words).lower() + ", after"), (2, "before " + " ".join(words[:-1]) + " after"), (3, " ".join(words))], "doc_id long, text string")
    found = sorted((r["doc_id"], r["item_id"], r["distance"]) for r in decontaminate.contamination(docs, items).collect())
    assert found == [(1, 1, 0), *([(2, 1, 1)] if n >= 5 else []), (3, 1, 0)]


def edits(item, words):
    """Least edit distance of item to any stretch of words."""
    row = [0] * (len(words) + 1)
    for k, w in enumerate(item, 1):
        new = [k]
        for j, x in enumerate(words, 1):
            new.append(min(row[j - 1] + (w != x), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def test_items_against_all_windows(spark):
    """Every text and item of the smallest tables, by edit distance over all windows: nearly all are found, and none wrongly."""
    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    found = {(r["doc_id"], r["item_id"]): r["distance"] for r in decontaminate.contamination(docs, items).collect()}
    plain = lambda t: [w for w in ("".join(c for c in x.lower() if c.isalnum()) for x in t.split()) if w]
    own = {r["item_id"]: plain(r["text"]) for r in items.collect()}
    texts = {r["doc_id"]: plain(r["text"]) for r in docs.collect() if len(r["text"]) < 2500}
    want = {}
    for i, words in texts.items():
        bag = set(words)
        for k, item in own.items():
            # An item within a fifth of edits shares at least as many of its words.
            if sum(w in bag for w in item) >= len(item) - int(0.2 * len(item)) and (d := edits(item, words)) <= int(0.2 * len(item)):
                want[i, k] = d
    got = {k: d for k, d in found.items() if k[0] in texts}
    assert want and got.items() <= want.items() and len(got) >= 0.97 * len(want)


def test_calls_beside_each_other(spark):
    """Three joins in threads of one session each give DuckDB's result."""
    got = {}
    threads = [threading.Thread(target=lambda k=k: got.update({k: sorted(tuple(r) for r in op7_jaccard_tiles(spark, SF).collect())})) for k in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = sorted(duck.execute(OP7).fetchall())
    assert got == dict.fromkeys(range(3), want)


def test_one_very_long_word_is_segmented_in_blocks():
    """A word of 100,000 characters: distinct samples that spell it, in the time of a few microseconds a character."""
    draw = np.random.default_rng(2)
    text = "".join(map(chr, draw.choice([*range(97, 123), 0x4E00, 0x1F600], 100_000)))
    words = segment_samples.Vocabulary.at(tokenizer_path("piece_bpe_32k.model"), 1.0)
    segment_samples.samples(pa.array(["a word"]), np.array([1], np.uint64), words, 3)
    began = time.perf_counter()
    paths, threshold, lattice = segment_samples.samples(pa.array([text]), np.array([1], np.uint64), words, 3)[0]
    assert time.perf_counter() - began < 5
    for p in paths:
        ids = words.expand(lattice.piece[p.edges]).tolist()
        assert words.decode(ids).decode() == text
    assert len({p.edges.tobytes() for p in paths}) == 3 and paths[0].value >= paths[1].value >= paths[2].value >= threshold
