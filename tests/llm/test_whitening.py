"""Whitening against numpy's eigenvectors of the whole covariance."""

import numpy as np
import pytest

from allelix.llm import whitening
from allelix.llm.queries import op12_whitening
from allelix.llm.whitening import Finder
from tests.llm.conftest import SF


def held_to_numpy(found, rows, k=16, offset=1_000_000):
    """Every row's result against a full decomposition of the distinct vectors."""
    x = {i: np.floor(64 * np.asarray(v, float)).astype(np.int64) + offset for i, v in rows}
    fit = np.unique(np.stack(list(x.values())), axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    a = (n * fit - sums) / n
    values, vectors = np.linalg.eigh(a.T @ a / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(k, int((values > 1e-12 * values[0]).sum()))
    got = {}
    for r in found:
        assert r["n"] == n and r["deviation"] == int(((n * x[r["vec_id"]] - sums) ** 2).sum()) and r["identity_error"] < 1e-9
        assert r["explained"] == pytest.approx(values[r["component"] - 1] / values.sum(), rel=1e-9)
        got.setdefault(r["vec_id"], {})[r["component"]] = r["whitened"]
    ids = sorted(x)
    w = np.array([[got[i][c + 1] for c in range(k)] for i in ids])
    assert all(len(got[i]) == k for i in ids)
    want = np.stack([(n * x[i] - sums) / n for i in ids]) @ vectors[:, :k] / np.sqrt(values[:k])
    sign = np.sign((w * want).sum(axis=0))
    assert np.abs(w - want * sign).max() < 1e-7


def test_whole_table(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    held_to_numpy(op12_whitening(spark, SF).collect(), rows)


@pytest.mark.parametrize("fall,full", [(0.25, False), (0.97, True)])
def test_range_finder(spark, fall, full):
    """A spectrum with a fall is found in the small basis, a flat one needs the full dimension."""
    draw = np.random.default_rng(4)
    turn = np.linalg.qr(draw.standard_normal((40, 40)))[0]
    v = (draw.standard_normal((500, 40)) * (5000 * fall ** np.arange(40) + 0.5)) @ turn
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    finder = Finder(components=4, over=8, passes=6)
    held_to_numpy(whitening.whitened(df, finder=finder).collect(), rows, 4)
    x = np.floor(64 * v)
    a = x - x.mean(axis=0)
    used = whitening.eigenpairs(lambda q: a.T @ (a @ q) / len(a), 40, finder)[2]
    assert used == (40 if full else 12)


def test_odd_rows(spark):
    draw = np.random.default_rng(2)
    some = [(i, draw.standard_normal(3).tolist()) for i in range(20)]
    short = [(100 + i, draw.standard_normal(2).tolist()) for i in range(9)]
    odd = [(50, None), (51, [None, 1.0, 2.0]), (52, [float("nan"), 1.0, 2.0]), (53, [float("inf"), 1.0, 2.0]), (54, [])]
    df = spark.createDataFrame([(i, v, "x") for i, v in [*some, *some[:5], *short, *odd]], "vec_id long, embedding array<double>, component string").repartition(3)
    got = whitening.whitened(df).collect()
    assert len(got) == 25 * 3 + 9 * 2
    held_to_numpy([r for r in got if r["vec_id"] < 50], some)
    held_to_numpy([r for r in got if r["vec_id"] >= 100], short)
    assert whitening.whitened(df.limit(0)).count() == 0
    assert whitening.whitened(df.where("vec_id = 3")).count() == 0  # one distinct vector has no variance
    flat = spark.createDataFrame([(i, [float(i), 7.0, float(-i)]) for i in range(9)], "vec_id long, embedding array<float>")
    assert {r["component"] for r in whitening.whitened(flat).collect()} == {1}
    far = spark.createDataFrame([(i, [i * 1e37, 1.0 + i * i]) for i in range(-3, 4)], "vec_id long, embedding array<float>")
    assert {r["vec_id"] for r in whitening.whitened(far).where("deviation IS NULL").collect()} == {-3, -2, -1, 1, 2, 3}
