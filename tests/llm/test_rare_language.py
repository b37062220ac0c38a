"""A language of few rows, or of long texts only, keeps its codeword."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from allelix.llm import language_id


def test_rare_languages(spark):
    r = random.Random(3)
    letters = {"a1": "abcdef", "b2": "ghijkl", "rare": "mnopqr", "long": "stuvwx"}
    text = lambda k, n: " ".join("".join(r.choices(letters[k], k=5)) for _ in range(n))
    langs = ["a1"] * 4000 + ["b2"] * 4000 + ["rare"] * 3 + ["long"] * 3
    rows = [(i, text(k, 600 if k == "long" else 8), k) for i, k in enumerate(langs)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = language_id.languages(docs, F.lit(True), F.lit(False), sample_rows=400).collect()
    got = {x["doc_id"]: x["lang_pred"] for x in found}
    assert {k for i, k in enumerate(langs) if got[i] != k} == set()


def test_long_texts_are_learnt_whole(spark):
    """What tells these languages apart stands beyond the first 30,000 bytes of every text."""
    r = random.Random(5)
    same = "the same words in both of them " * 1000
    tail = {"a1": "abcdef", "b2": "ghijkl"}
    text = lambda k: same + " ".join("".join(r.choices(tail[k], k=5)) for _ in range(5000))
    langs = ["a1", "b2"] * 30
    docs = spark.createDataFrame([(i, text(k), k) for i, k in enumerate(langs)], "doc_id long, text string, lang string")
    found = language_id.languages(docs, F.lit(True), F.lit(False)).collect()
    assert [x["lang_pred"] for x in sorted(found, key=lambda x: x["doc_id"])] == langs


def test_shares_of_whole_texts():
    texts = pa.array(["Ab ab", None, "x" * 70_000])
    got = language_id.shares(texts).to_pylist()
    assert [round(sum(g["share"] for g in row), 4) for row in got] == [1, 1, 1]
    assert language_id.shares(pa.array(["aB AB"])).to_pylist()[0] == got[0] and len(got[2]) < 12
