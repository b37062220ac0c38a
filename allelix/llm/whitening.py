"""Whitening of embeddings by a randomised range finder and Rayleigh-Ritz.

Vectors become whole numbers x; the fit list holds each distinct x once. With n and the exact sums S of it, every row is
centred in whole numbers first, (n x - S) / n, so nothing is lost to the offset. A random basis of ``components`` +
``over`` vectors is multiplied by the covariance V in passes over all centred rows (a task adds up A'(A Q) of its own
rows; these are summed by entry), and orthonormalised between passes. Rayleigh-Ritz in the basis gives values and
components, and V Q gives their residuals. Components are taken once residual over gap is below ``tolerance``. If ``passes``
do not bring that, as with spectra without a drop behind the wanted components, the basis is completed to the full
dimension, in which one more pass makes Rayleigh-Ritz exact to double precision.

A pass sends one row for each entry of a dimension x basis matrix from each task to an aggregate; the driver holds one
such matrix, whose size has nothing to do with the number of vectors. Whitened vectors are checked in a last pass: their
covariance over the fit list must be the identity.

Defined results: null vectors and those with null or non-finite entries are left out; entries beyond 2^44 in size count as
that; vectors of different lengths are whitened apart, each length in its own space, and those of no entries have no rows;
directions without variance (at most 1e-12 of the greatest) are not components, so a table of one distinct vector gives no
rows; ``deviation`` is null where it exceeds a long; repeated rows each get their rows; null ids are carried along; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Folders, let_go, mapped, small_batches

SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
MOST = float(1 << 50)


@dataclass(frozen=True)
class Finder:
    """components wanted, further basis vectors, passes before the full dimension, and residual over gap allowed."""

    components: int = 16
    over: int = 8
    passes: int = 3
    tolerance: float = 1e-10
    seed: int = 11
    scale: int = 64
    offset: int = 1_000_000


def whole_vectors(vectors: DataFrame, id_col: str, vector_col: str, finder: Finder) -> DataFrame:
    """vec_id, x of the rows that take part."""
    v = vectors[vector_col]
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    x = F.transform(v, lambda c: F.floor(F.greatest(F.least(c.cast("double") * finder.scale, F.lit(MOST)), F.lit(-MOST))).cast("long") + finder.offset)
    return vectors.where(v.isNotNull() & finite).select(vectors[id_col].cast("long").alias("vec_id"), x.alias("x"))


def matrix(lists: pa.Array, d: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def summed(fit: DataFrame, f: Callable[[np.ndarray], np.ndarray], d: int, kind: str) -> np.ndarray:
    """The sum over all rows of f, which maps a matrix of rows to an array; kind: its Spark type, long or double."""
    small_batches(fit.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = f(matrix(batch.column("x"), d))
                total = part if total is None else total + part
        if total is not None:
            for a in range(0, total.size, 1 << 16):
                value = total.reshape(-1)[a : a + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(a, a + len(value))), pa.array(value)], ["at", "v"])
        let_go()

    found = fit.mapInArrow(work, f"at long, v {kind}").groupBy("at").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros(found.num_rows, np.int64 if kind == "long" else np.float64)
    out[found["at"].to_numpy()] = found["v"].to_numpy()
    return out


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    return (n * x - sums).astype(np.float64) / n


def ritz(basis: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values in falling order, vectors, and residual norms, of the matrix V in a basis, from times = V basis."""
    small = basis.T @ times
    values, turn = np.linalg.eigh((small + small.T) / 2)
    values, turn = values[::-1], turn[:, ::-1]
    vectors = basis @ turn
    return values, vectors, np.linalg.norm(times @ turn - vectors * values, axis=0)


def converged(values: np.ndarray, residuals: np.ndarray, k: int, tolerance: float) -> bool:
    """Whether each of the first k vectors is within tolerance: its residual over its distance to the other values."""
    apart = -np.diff(values)
    gap = np.minimum(np.append(np.inf, apart), np.append(apart, np.inf))[:k]
    return bool((residuals[:k] <= tolerance * gap).all())


def eigenpairs(times: Callable[[np.ndarray], np.ndarray], d: int, finder: Finder) -> tuple[np.ndarray, np.ndarray, int]:
    """Values, vectors (columns) and the basis vectors used. times: a matrix Q -> V Q, one pass over the rows."""
    k, wide = min(finder.components, d), min(d, finder.components + finder.over)
    basis = np.linalg.qr(np.random.default_rng(finder.seed).standard_normal((d, wide)))[0]
    for _ in range(finder.passes if wide < d else 0):
        product = times(basis)
        values, vectors, residuals = ritz(basis, product)
        if converged(values, residuals, k, finder.tolerance):
            return values[:k], vectors[:, :k], wide
        basis = np.linalg.qr(product)[0]
    full = np.linalg.qr(np.concatenate([basis, np.eye(d)], axis=1))[0]
    values, vectors, _ = ritz(full, times(full))
    return values[:k], vectors[:, :k], d


@dataclass(frozen=True)
class Fit:
    """n and sums of the fit list; components as columns, their values, the trace, the identity error and the basis used."""

    n: int
    sums: np.ndarray
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float
    basis: int


def fit_list(fit: DataFrame, d: int, finder: Finder) -> Fit:
    """The components of distinct vectors x of d entries."""
    first = summed(fit, lambda x: np.append(x.sum(axis=0), len(x)), d, "long")
    n, sums = int(first[-1]), first[:-1]
    trace = float(summed(fit, lambda x: np.array([(centred(x, n, sums) ** 2).sum()]), d, "double")[0]) / n

    def times(basis: np.ndarray) -> np.ndarray:
        def part(x: np.ndarray) -> np.ndarray:
            a = centred(x, n, sums)
            return a.T @ (a @ basis)

        return summed(fit, part, d, "double").reshape(basis.shape) / n

    values, vectors, used = eigenpairs(times, d, finder)
    some = (values > 1e-12 * values[0]) & (values > 0)
    values, vectors = values[some], np.ascontiguousarray(vectors[:, some])
    error = 0.0
    if len(values):
        turn = vectors / np.sqrt(values)

        def second(x: np.ndarray) -> np.ndarray:
            w = centred(x, n, sums) @ turn
            return w.T @ w

        covariance = summed(fit, second, d, "double").reshape(len(values), -1) / n
        error = float(np.abs(covariance - np.eye(len(values))).max())
    return Fit(n, sums, vectors, values, trace, error, used)


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> pa.Array:
    """The exact sum of (n x - S)^2 of each row, null beyond a long."""
    apart = n * x - sums
    most = int(np.abs(apart).max(initial=0))
    if most * most * x.shape[1] < 1 << 63:
        return pa.array((apart * apart).sum(axis=1))
    exact = [sum(v * v for v in row) for row in apart.tolist()]
    return pa.array([v if v < 1 << 63 else None for v in exact], pa.int64())


def projected(rows: DataFrame, d: int, fit: Fit) -> DataFrame:
    """SCHEMA: a row for each row and component."""
    m = len(fit.values)

    def make():
        turn, explained = fit.vectors / np.sqrt(fit.values), fit.values / fit.trace

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            x, r = matrix(batch.column("x"), d), batch.num_rows
            each = pa.array(np.repeat(np.arange(r), m))
            columns = [
                batch.column("vec_id").take(each), pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), r)), pa.array(np.full(r * m, fit.n)), deviations(x, fit.n, fit.sums).take(each),
                pa.array((centred(x, fit.n, fit.sums) @ turn).reshape(-1)), pa.array(np.tile(explained, r)), pa.array(np.full(r * m, fit.identity_error)),
            ]
            return pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

        return work

    return mapped(rows, make, SCHEMA, None)


def whitened(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", finder: Finder = Finder()) -> DataFrame:
    """SCHEMA for each row that takes part and each of its components."""
    spark, own = vectors.sparkSession, Folders(vectors.sparkSession)
    rows = whole_vectors(vectors, id_col, vector_col, finder)
    fit = own.stored(rows.select("x").distinct(), "distinct-vectors")
    out = []
    for d in sorted(r["d"] for r in fit.groupBy(F.size("x").alias("d")).agg(F.count("*")).collect()):
        if d:
            found = fit_list(fit.where(F.size("x") == d), d, finder)
            if len(found.values):
                out.append(projected(rows.where(F.size("x") == d), d, found))
    own.forget(keep=0)
    return reduce(DataFrame.unionAll, out) if out else spark.createDataFrame([], SCHEMA)
