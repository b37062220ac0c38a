import pytest

pytest.importorskip("allelix.llm")

SF = "/root/testdata/sf0.001"
#: Names that the operators use themselves, as columns of the input.
CLASHING = ("sig", "keys", "key", "h", "chunk", "first", "doc", "gone", "label", "score", "sample", "ids", "root", "n_words", "held_out", "learn", "_gone", "row", "kept", "own", "tie", "other", "all", "left", "hash")


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows, ids that repeat, and columns whose names clash."""
    line = "the cat sat on the mat and the dog sat on the log while it rained all day long\n"
    rows = [(1, "a b c"), (2, None), (3, ""), (None, "a b c"), (None, None), (4, "x" * 300_000), (5, "word " * 60_000), (6, line * 40), (6, line * 40), (7, " \n\t \n"), (8, line + "one\ntwo\nthree\nfour"), (8, "é日本   \x1c 12.5 me@x.org"), (9, "7" * 50_000)]
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for c in CLASHING:
        df = df.selectExpr("*", f"'x' AS {c}")
    return df.repartition(3)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
