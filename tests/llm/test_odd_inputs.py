"""Batches of few words, clashing names, and the pipeline's stages on odd rows and empty tables."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from allelix.llm import jaccard_tiles, line_chunks, segment_samples
from allelix.llm.common import mix
from allelix.llm.queries import tokenizer_path
from tests.llm.conftest import SF
from tests.llm.test_operators import shingle_set


@pytest.mark.parametrize("k", range(1, 8))
def test_few_words(k):
    for n in range(k + 1):
        for texts in ([" ".join("abcdefgh"[:n])], list("abcdefgh"[:n]), ["", " ".join("abcdefgh"[:n]), "a"]):
            hashes, bounds = jaccard_tiles.shingles(pa.array(texts, pa.string()), k)
            assert np.diff(bounds).tolist() == [len(shingle_set(t, k)) for t in texts] and len(hashes) == bounds[-1]


def test_small_partitions(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(["a b c d e f", "a b c d e f", "x\ny\nz"])], "doc_id long, text string").repartition(3)
    assert sorted(r["doc_id"] for r in jaccard_tiles.one_of_each(rows).collect()) == [0, 2]


def test_one_id_with_two_texts(spark):
    rows = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f"), (2, "quite another text of some words"), (3, "")], "doc_id long, text string")
    kept = {(r["doc_id"], r["text"]) for r in jaccard_tiles.one_of_each(rows).collect()}
    assert kept == {(1, "a b c d e f"), (2, "quite another text of some words"), (3, "")}


def test_kept_column_of_the_input(odd):
    mine = odd.withColumn("_kept", F.lit("mine"))
    assert line_chunks.dedup_lines(mine).columns == line_chunks.dedup_passages(mine).columns == [*odd.columns, "_kept"]
    kept = line_chunks.without_repeats(mine)
    assert kept.columns == mine.columns and {r["_kept"] for r in kept.select("_kept").collect()} == {"mine"}
    assert jaccard_tiles.one_of_each(mine).columns == mine.columns


def test_stages_on_odd_rows(spark, odd, none, tmp_path):
    for name, docs in (("odd", odd), ("none", none)):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}{k}")
            got = spark.read.parquet(f"{tmp_path}/{name}{k}")
            if k < 4:
                assert got.columns == docs.columns
            assert name == "odd" or not got.count()


def test_long_words_are_one_cell():
    words = segment_samples.Vocabulary.at(tokenizer_path("piece_bpe_32k.model"), 1.0)
    for n in (1990, 1999, 2000, 2001, 5000):
        text = ("abcdefghij" * 500)[:n]
        _, cells, first = segment_samples.cut(pa.array([text, f"x {text}\ny"]))
        assert cells[0] == segment_samples.MARK + text and np.diff(first).tolist() == [1, 4]
        own = segment_samples.samples(pa.array([text]), mix(np.arange(1).astype(np.uint64)), words, 1)[0]
        lattice, behind = own[2], np.zeros(n + 2)
        pieces = {b.decode().replace(" ", segment_samples.MARK): words.weight[i] for i, b in enumerate(words.bytes) if i > 258}
        cell = cells[0]
        for i in range(n, -1, -1):  # the whole word's mass, one node at a time
            ways = [pieces[cell[i:j]] + behind[j] for j in range(i + 1, min(n + 1, i + 16) + 1) if cell[i:j] in pieces]
            behind[i] = np.logaddexp.reduce(ways)
        path = own[0][0]
        spelt = sum(words.weight[lattice.piece[e]] for e in path.edges)
        assert path.log_prob == pytest.approx(spelt - behind[0])
