"""Whitening of vectors by the leading components of their covariance.

Sums and centred products of all distinct vectors are added up on the executors; only the
covariance, dimension x dimension, reaches the driver.  Its leading components come from
contour integration: a quadrature of complex shifted solves projects a subspace onto the
eigenvalues inside an interval, Rayleigh-Ritz extracts them, and inertia counts at the
interval's ends prove that none is missing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tesserae.llm.frames import cut

COMPONENTS, SCALE, SEED = 4, 256, 13
#: Nodes of the quadrature on the upper half of the contour, and refinements at most.
NODES, REFINEMENTS = 12, 60
#: Eigenvalues below this share of the largest count as zero; no component belongs to them.
ZERO = 1e-13
OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def above(matrix: np.ndarray, shift: float) -> int:
    """How many eigenvalues of a symmetric matrix exceed ``shift``: positive pivots of a symmetric factorization.

    Pivots are the largest diagonal entry, or the two rows of the largest entry beside it
    (one eigenvalue of each sign) where that is much larger.
    """
    a = matrix - shift * np.eye(len(matrix))
    alpha, count = (1 + math.sqrt(17)) / 8, 0
    while len(a):
        size = np.abs(a)
        one = int(size.diagonal().argmax())
        beside = size - np.diag(size.diagonal())
        i, j = np.unravel_index(int(beside.argmax()), a.shape)
        if size[one, one] >= alpha * beside[i, j]:
            pivot = [one]
            count += bool(a[one, one] > 0)
            if a[one, one] == 0:   # the rest is zero
                return count
        else:
            pivot, count = [i, j], count + 1
        rest = np.setdiff1d(np.arange(len(a)), pivot)
        side = a[np.ix_(rest, pivot)]
        a = a[np.ix_(rest, rest)] - side @ np.linalg.solve(a[np.ix_(pivot, pivot)], side.T)
        a = (a + a.T) / 2
    return count


def bracket(matrix: np.ndarray, number: int, low: float, high: float) -> tuple[float, float]:
    """A narrow interval that holds the eigenvalue of that number, counted from the largest."""
    while high - low > 1e-6 * max(abs(high), abs(low)):
        middle = (low + high) / 2
        if middle in (low, high):
            break
        low, high = (middle, high) if above(matrix, middle) >= number else (low, middle)
    return low, high


def contour(matrix: np.ndarray, low: float, high: float, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` eigenvalues in (low, high), largest first, with unit eigenvectors as columns."""
    d = len(matrix)
    size = min(d, 2 * count + 6)
    basis = np.random.default_rng(SEED).normal(size=(d, size))
    at, weight = np.polynomial.legendre.leggauss(NODES)
    angle = math.pi / 2 * (1 - at)
    centre, radius = (low + high) / 2, (high - low) / 2
    turns = radius * np.exp(1j * angle)
    best = (math.inf, np.zeros(0), np.zeros((d, 0)))
    for _ in range(REFINEMENTS):
        projected = np.zeros((d, size))
        for turn, w in zip(turns, weight):
            projected += w / 2 * (turn * np.linalg.solve((centre + turn) * np.eye(d) - matrix, basis.astype(complex))).real
        q, _ = np.linalg.qr(projected)
        values, inner = np.linalg.eigh(q.T @ matrix @ q)
        basis = q @ inner
        inside = np.flatnonzero((values > low) & (values < high))[::-1]
        found, vectors = values[inside], basis[:, inside]
        if len(found) == count:
            error = float(np.linalg.norm(matrix @ vectors - vectors * found, axis=0).max()) if count else 0.0
            if error >= best[0] / 2:   # as good as double precision allows
                break
            best = (error, found, vectors)
    if len(best[1]) != count:
        raise ArithmeticError(f"{len(best[1])} of {count} eigenvalues in ({low}, {high}) found")
    return best[1], best[2]


def components(covariance: np.ndarray, count: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` largest eigenvalues and their unit eigenvectors (columns); fewer where the rest is zero.

    The interval ends in a gap of the spectrum, so that equal eigenvalues stay together.
    """
    d, trace = len(covariance), float(np.trace(covariance))
    if not d or not trace > 0:
        return np.zeros(0), np.zeros((d, 0))
    scale = 2.0 ** -math.frexp(trace)[1]   # exact; keeps extreme covariances in range
    matrix = covariance * scale
    high = float(np.abs(matrix).sum(1).max()) * (1 + 1e-6)
    wanted = min(count, d)
    while True:
        upper = bracket(matrix, wanted, -ZERO, high)
        lower = bracket(matrix, wanted + 1, -ZERO, upper[1]) if wanted < d else (-high, -high / 2)
        low = (upper[0] + lower[1]) / 2
        if upper[0] - lower[1] > 1e-5 * high or wanted == d:
            break
        wanted += 1   # no gap here: take the next one too
    wanted = above(matrix, low)
    values, vectors = contour(matrix, low, high, wanted)
    if above(matrix, high) or len(values) != wanted:
        raise ArithmeticError("an eigenvalue is missing")
    keep = np.flatnonzero(values > ZERO * values[:1])[:count]
    return values[keep] / scale, vectors[:, keep]


@dataclass
class Model:
    n: int                 # distinct vectors
    sums: list[int]        # of each dimension
    reach: int             # largest absolute entry
    values: np.ndarray     # eigenvalues
    vectors: np.ndarray    # (dimension, component)
    trace: float
    identity_error: float = 0.0


def whole_vectors(vector: Column) -> Column:
    """floor(SCALE * c) of every entry; null unless all are finite numbers."""
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    vector = vector.cast("array<double>")
    return F.when(F.forall(vector, number), F.transform(vector, lambda c: F.floor(c * SCALE)))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), d)


def _totals(fit: DataFrame, d: int) -> tuple[list[int], int]:
    """Sums of each dimension and the largest absolute entry, in whole numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, reach = [0] * d, 0
        for batch in batches:
            x = _matrix(batch.column(0), d)
            reach = max(reach, -int(x.min()), int(x.max()))
            x = x if reach < 1 << 40 else x.astype(object)
            total = [a + int(b) for a, b in zip(total, x.sum(axis=0))]
        yield pa.record_batch([
            pa.array(range(d + 1), pa.int32()), pa.array([Decimal(v) for v in [*total, 0]], pa.decimal128(38, 0)), pa.array([0] * d + [reach], pa.int64()),
        ], names=["at", "total", "reach"]) if reach or any(total) else pa.record_batch([pa.array([], t) for t in (pa.int32(), pa.decimal128(38, 0), pa.int64())], names=["at", "total", "reach"])

    sums, reach = [0] * d, 0
    for r in fit.mapInArrow(run, "at int, total decimal(38,0), reach long").groupBy("at").agg(F.sum("total").alias("total"), F.max("reach").alias("reach")).collect():
        if r.at < d:
            sums[r.at] = int(r.total)
        reach = max(reach, r.reach)
    return sums, reach


def _products(fit: DataFrame, column: str, d: int, prepare) -> np.ndarray:
    """Sum over all rows of y y', where y = prepare(matrix of rows); one row for each two dimensions from every task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            y = prepare(batch.column(0))
            total = y.T @ y if total is None else total + y.T @ y
        if total is not None:
            at = np.triu_indices(len(total))
            yield pa.record_batch([pa.array(at[0].astype(np.int32)), pa.array(at[1].astype(np.int32)), pa.array(total[at])], names=["i", "j", "v"])

    out = np.zeros((d, d))
    for r in fit.select(column).mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        out[r.i, r.j] = out[r.j, r.i] = r.v
    return out


def fit(rows: DataFrame, d: int, count: int = COMPONENTS) -> Model:
    """Components of the covariance of the distinct vectors among ``rows(x)``.

    Entries are centred on whole numbers next to their means before they are multiplied,
    so products are exact while squared spread times rows stays below 2^53; the remainder
    of each mean, at most one half, is taken off the sums.
    """
    distinct = cut(rows.select("x").distinct())
    n = distinct.count()
    sums, reach = _totals(distinct, d)
    if not n:
        return Model(0, sums, reach, np.zeros(0), np.zeros((d, 0)), 0.0)
    middle = np.array([(2 * s + n) // (2 * n) for s in sums], dtype=np.int64)
    rest = np.array([(s - n * int(m)) / n for s, m in zip(sums, middle)])
    products = _products(distinct, "x", d, lambda column: (_matrix(column, d) - middle).astype(np.float64))
    covariance = products / n - np.outer(rest, rest)
    values, vectors = components(covariance, count)
    model = Model(n, sums, reach, values, vectors, float(np.trace(covariance)))
    if len(values):
        project = projection(model)
        around = _products(distinct, "x", len(values), lambda column: project(_matrix(column, d)))
        model.identity_error = float(np.abs(around / n - np.eye(len(values))).max())
    return model


def projection(model: Model):
    """Function from whole vectors to their whitened components."""
    middle = [s // model.n for s in model.sums]   # whole parts of the means, taken off exactly
    rest = np.array([(s - m * model.n) / model.n for s, m in zip(model.sums, middle)])
    base, turn = np.array(middle, dtype=np.int64), model.vectors / np.sqrt(model.values)

    def project(x: np.ndarray) -> np.ndarray:
        return ((x - base).astype(np.float64) - rest) @ turn

    return project


def deviations(x: np.ndarray, model: Model) -> list[int | None]:
    """Sum of (n x - S)^2 of each vector, exact; null where it exceeds 63 bits."""
    bound = model.n * model.reach + max(map(abs, model.sums))
    if x.shape[1] * bound * bound < 1 << 63:
        return ((model.n * x - np.array(model.sums, dtype=np.int64)) ** 2).sum(axis=1).tolist()
    whole = ((model.n * x.astype(object) - np.array(model.sums, dtype=object)) ** 2).sum(axis=1)
    return [int(v) if v < 1 << 63 else None for v in whole]


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", count: int = COMPONENTS) -> DataFrame:
    """OUT columns: for every row and component, the vector's whitened coordinate.

    Rows whose vector is null or holds null or non-finite entries are dropped, as are
    vectors of another dimension than most (of equally many, the larger).  Entries c become
    whole numbers floor(256 c), saturating at 64 bits.  Mean and covariance are those of the
    distinct vectors.  Components of no variance do not exist: one vector, equal vectors and
    an empty table give no rows.  Null identifiers and repeated rows stay, other columns are
    ignored.  The covariance is one matrix on the driver, so its dimension must be moderate;
    the number of rows is not bounded.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), whole_vectors(F.col(vector_col)).alias("x")).filter("x IS NOT NULL")
    sizes = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if sizes is None or not sizes.d:
        return spark.createDataFrame([], OUT)
    d = sizes.d
    rows = rows.filter(F.size("x") == d)
    model = fit(rows, d, count)
    k = len(model.values)
    if not k:
        return spark.createDataFrame([], OUT)
    explained = (model.values / model.trace).tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        project = projection(model)
        for batch in batches:
            x = _matrix(batch.column(1), d)
            every = pa.array(np.repeat(np.arange(len(x)), k))
            yield pa.record_batch([
                batch.column(0).take(every), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(k * len(x), model.n)),
                pa.array(deviations(x, model), pa.int64()).take(every), pa.array(project(x).ravel()), pa.array(np.tile(explained, len(x))),
                pa.array(np.full(k * len(x), model.identity_error)),
            ], names=[c.split()[0] for c in OUT.split(", ")])

    return rows.mapInArrow(run, OUT)
