"""Ball k-means on whole-number vectors: exact clusters, with most comparisons saved by balls.

A cluster is a ball: its centroid and a radius that no member lies beyond. After the centroids have moved, a ball's radius
is at most the old one and the way its centroid went. Only centroids within twice that radius are its neighbours: for a
member x of ball i, d(x, j) >= d(i, j) - d(x, i), so centroid j can be as near as i only if d(i, j) <= 2 d(x, i). The
members nearer to i than half the way to its closest neighbour are the stable core and stay without a comparison; the
others lie in annuli, cut at half the ways to the first, second, ... neighbour, and a member of the s-th annulus is held
exactly against the first s neighbours only. All these tests are made in whole numbers (4 d(x, i)^2 < d(i, j)^2), so they
decide as a comparison with every centroid does, ties included.

Each round is one pass over the vectors, in the tasks that read them: it assigns, writes the assigned vectors, and a
partial aggregate by cluster (count, sums, radius) gives the driver k rows, whatever the number of vectors or the share
of one of them. The first pass has no balls yet and compares with all centroids. Nothing else is shuffled or broadcast
but the k centroids.

Defined results: vectors of another number of components, and with null or non-finite entries, are left out; so are null
vectors. Components beyond 2^27 after scaling count as that. With fewer vectors than k each is a centroid. Null ids have
the last hashes; rows that repeat an id are told apart by their vectors; repeated rows each count and get a row. An empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Folders, mapped

ASSIGNED = "vec_id long, q array<int>, cluster int, distance long"
MOST = 1 << 27


@dataclass(frozen=True)
class Balls:
    """k centroids, rounds, the components that a vector must have, and the scale before rounding down."""

    k: int = 16
    rounds: int = 3
    components: int = 64
    scale: int = 64


def whole_vectors(vectors: DataFrame, id_col: str, vector_col: str, balls: Balls) -> DataFrame:
    """vec_id, q: the vectors that take part, in whole numbers."""
    v = vectors[vector_col]
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform(v, lambda x: F.floor(F.greatest(F.least(x.cast("double") * balls.scale, F.lit(float(MOST))), F.lit(float(-MOST)))).cast("int"))
    return vectors.where((F.size(v) == balls.components) & finite).select(vectors[id_col].cast("long").alias("vec_id"), whole.alias("q"))


def order_of(vec_id: Column) -> Column:
    return F.sha2(F.concat(F.lit("1:"), vec_id.cast("string")).cast("binary"), 256)


def first_centroids(rows: DataFrame, balls: Balls) -> np.ndarray:
    """The k vectors of the smallest hashes, in their order."""
    found = rows.orderBy(order_of(F.col("vec_id")).asc_nulls_last(), "q").limit(balls.k).select("q").collect()
    return np.array([r["q"] for r in found], np.int64).reshape(-1, balls.components)


def squares(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Squared distances of rows to one vector, exact."""
    apart = x - centre
    return (apart * apart).sum(axis=1)


def all_nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's nearest centroid (the smallest number of equal ones) and its squared distance."""
    best, least = np.zeros(len(x), np.int32), squares(x, centroids[0])
    for j in range(1, len(centroids)):
        d = squares(x, centroids[j])
        near = d < least
        best[near], least[near] = j, d[near]
    return best, least


def neighbours(centroids: np.ndarray, radius: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each ball its neighbours, nearest first, and their squared distances."""
    out = []
    for i, centre in enumerate(centroids):
        d = squares(centroids, centre)
        # The radius is a float: a little more of it never loses a neighbour.
        js = np.flatnonzero(d <= 4 * radius[i] ** 2 * (1 + 1e-9) + 1)
        js = js[js != i]
        js = js[np.lexsort((js, d[js]))]
        out.append((js.astype(np.int32), d[js]))
    return out


def ball_nearest(x: np.ndarray, own: np.ndarray, centroids: np.ndarray, near: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """As all_nearest, from each row's last ball: core rows stay, rows of the s-th annulus meet the first s neighbours."""
    best, least = own.copy(), np.empty(len(x), np.int64)
    for i in np.unique(own):
        rows = np.flatnonzero(own == i)
        d = squares(x[rows], centroids[i])
        js, ways = near[i]
        annulus = np.searchsorted(ways, 4 * d, "right")
        now, at = np.full(len(rows), i, np.int32), d.copy()
        for s, j in enumerate(js):
            open_ = np.flatnonzero(annulus > s)
            if not len(open_):
                break
            other = squares(x[rows[open_]], centroids[j])
            better = (other < at[open_]) | ((other == at[open_]) & (j < now[open_]))
            now[open_[better]], at[open_[better]] = j, other[better]
        best[rows], least[rows] = now, at
    return best, least


def matrix(lists: pa.Array, columns: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, columns)


def assigned(rows: DataFrame, centroids: np.ndarray, near: list | None, balls: Balls) -> DataFrame:
    """ASSIGNED: rows with their nearest centroid; near: the balls' neighbours, where rows have a cluster already."""

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            x = matrix(batch.column("q"), balls.components)
            if near is None:
                cluster, distance = all_nearest(x, centroids)
            else:
                cluster, distance = ball_nearest(x, batch.column("cluster").to_numpy(), centroids, near)
            return pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("q"), pa.array(cluster), pa.array(distance)], ["vec_id", "q", "cluster", "distance"])

        return work

    return mapped(rows, make, ASSIGNED, None)


def by_cluster(rows: DataFrame, balls: Balls) -> dict[int, dict]:
    """Of each cluster the number of vectors, their summed components, the summed and the greatest squared distance."""
    sums = [F.sum(F.col("q")[k].cast("long")).alias(f"s{k}") for k in range(balls.components)]
    found = rows.groupBy("cluster").agg(F.count("*").alias("n"), F.sum("distance").alias("inertia"), F.max("distance").alias("most"), *sums).collect()
    return {r["cluster"]: {"n": r["n"], "inertia": r["inertia"], "most": r["most"], "sums": [r[f"s{k}"] for k in range(balls.components)]} for r in found}


def moved(centroids: np.ndarray, found: dict[int, dict]) -> tuple[np.ndarray, np.ndarray]:
    """The centroids of the members, rounded down, empty ones as they were; and radii that hold all members."""
    new, radius = centroids.copy(), np.zeros(len(centroids))
    for i, c in found.items():
        new[i] = [s // c["n"] for s in c["sums"]]
        radius[i] = np.sqrt(float(c["most"])) + np.sqrt(float(squares(new[i : i + 1], centroids[i])[0]))
    return new, radius


def fitted(rows: DataFrame, balls: Balls, own: Folders) -> tuple[DataFrame, np.ndarray, dict[int, dict]]:
    """The rows assigned to the last centroids, these, and by_cluster of them."""
    centroids, near = first_centroids(rows, balls), None
    if not len(centroids):
        return own.stored(assigned(rows, centroids, None, balls), "clusters"), centroids, {}
    for turn in range(balls.rounds + 1):
        rows = own.stored(assigned(rows, centroids, near, balls), "clusters")
        own.forget(keep=1)
        found = by_cluster(rows, balls)
        if turn < balls.rounds:
            centroids, radius = moved(centroids, found)
            near = neighbours(centroids, radius)
    return rows, centroids, found


def clusters(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", balls: Balls = Balls()) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 for each vector that takes part."""
    own = Folders(vectors.sparkSession)
    rows, centroids, found = fitted(whole_vectors(vectors, id_col, vector_col, balls), balls, own)
    total = sum(c["inertia"] for c in found.values())
    facts = [(i, c["inertia"], total, hashlib.sha256(",".join(map(str, centroids[i])).encode()).hexdigest()) for i, c in sorted(found.items())]
    of = vectors.sparkSession.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.select("vec_id", "cluster", "distance").join(F.broadcast(of), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
