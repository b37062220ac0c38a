"""Ball k-means against plain loops over all centroids."""

import hashlib
import math
import random

import pytest

from allelix.llm import ball_clusters
from allelix.llm.ball_clusters import Balls
from allelix.llm.queries import op13_ball_clusters
from tests.llm.conftest import SF


def plain(rows, k=16, rounds=3, components=64, scale=64):
    """rows of (id, vector) -> sorted result rows, by comparing every vector with every centroid."""
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == components and all(x is not None and math.isfinite(x) for x in v)]
    name = lambda i: (i is None, hashlib.sha256(f"1:{i}".encode()).hexdigest() if i is not None else "")
    centroids = [q for _, q in sorted(kept, key=lambda r: (name(r[0]), r[1]))[:k]]
    d = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for turn in range(rounds + 1):
        found = [min((d(q, c), j) for j, c in enumerate(centroids)) for _, q in kept]
        if turn < rounds:
            for j in range(len(centroids)):
                own = [q for (_, q), (_, c) in zip(kept, found, strict=True) if c == j]
                if own:
                    centroids[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    inertia = [sum(x for x, c in found if c == j) for j in range(len(centroids))]
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, c, x, inertia[c], sum(inertia), sha[c]) for (i, _), (x, c) in zip(kept, found, strict=True)), key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()), key=str)


def test_whole_table(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert rows_of(op13_ball_clusters(spark, SF)) == plain(rows)


@pytest.mark.parametrize("seed", range(3))
def test_ties_copies_and_far_balls(spark, seed):
    """Balls far from each other (most rows are core), on a coarse grid (many ties), with copies and negative sums."""
    r = random.Random(seed)
    centres = [[r.choice((-40.0, 0.0, 35.0)) for _ in range(3)] for _ in range(5)]
    rows = [(i, [c + r.choice((-0.5, 0, 0.5)) for c in r.choice(centres)]) for i in range(150)]
    rows += rows[:40] + [(7, [0.0, 0.0, 0.0])] * 50
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    balls = Balls(k=6, rounds=3, components=3, scale=2)
    assert rows_of(ball_clusters.clusters(df, balls=balls)) == plain(rows, 6, 3, 3, 2)


def test_core_rows_are_not_compared():
    import numpy as np

    centroids = np.array([[0, 0], [100, 0], [0, 1000]], np.int64)
    near = ball_clusters.neighbours(centroids, np.array([60.0, 20.0, 10.0]))
    assert [n[0].tolist() for n in near] == [[1], [], []]
    x = np.array([[49, 0], [50, 0], [51, 0], [80, 1]], np.int64)
    best, least = ball_clusters.ball_nearest(x, np.array([0, 0, 0, 1], np.int32), centroids, near)
    assert best.tolist() == [0, 0, 1, 1] and least.tolist() == [2401, 2500, 2401, 401]


def test_odd_rows(spark):
    v = [0.5] * 64
    rows = [(1, v), (1, v), (None, [0.25] * 64), (2, None), (3, [float("nan")] + v[1:]), (4, [None] + v[1:]), (5, v[1:]), (6, []), (8, [float("inf")] + v[1:]), (9, [-1e30] + v[1:])]
    df = spark.createDataFrame([(i, x, "c", 0) for i, x in rows], "vec_id long, embedding array<float>, cluster string, q int")
    got = rows_of(ball_clusters.clusters(df))
    assert [g[0] for g in got] == [1, 1, 9, None]
    assert [g for g in got if g[0] != 9] == [(i, c, d, ci, got[0][4], s) for i, c, d, ci, _, s in got if i != 9]
    assert ball_clusters.clusters(df.limit(0)).count() == 0
    assert ball_clusters.clusters(df.where("vec_id = 1")).count() == 2
