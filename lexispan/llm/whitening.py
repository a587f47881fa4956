"""Whitening of embeddings by a pivoted Cholesky factor and one-sided Jacobi rotations.

Entries become whole numbers x = floor(scale * entry), and the fit list holds every distinct vector once. Spark counts and
sums the list, then adds up the centred scatter: each partition multiplies its vectors less the mean in blocks and
gives one row for each row of the matrix, so what is shuffled and collected grows with the square of the
dimension and not with the table (at most `MOST_DIMENSIONS`; beyond it an error). On the driver the scatter, divided by n, is
factored by Cholesky with complete pivoting, V = L L' with L lower trapezoidal in the order of pivots, which ends at the
rank. Jacobi rotations make the columns of L orthogonal in place; their squared norms are the eigenvalues of V,
and the columns over their norms its eigenvectors, without V being formed again. Every row is then projected in one pass.

Defined results: rows whose vector is null, empty or holds null or non-finite entries are left out; of vectors of several lengths
those of the most frequent length stay (ties: the longest); repeated rows are transformed each and fitted once. Components
beyond the rank aren't returned, so a fit list of one vector, or an empty table, gives no rows. Sums that don't fit 64 bits are an error.
Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, written

#: The scatter of this many dimensions takes 128 MB on the driver.
MOST_DIMENSIONS = 4096
#: Vectors that a task holds as a matrix at once.
BLOCK_ROWS = 4096
_LIMIT = 2**63 - 1


@dataclass
class Fit:
    """What a transform needs: the fit list's size, sums by dimension, total variance, eigenvalues (falling) and components as rows."""

    n: int
    sums: list[int]
    trace: float
    values: np.ndarray
    components: np.ndarray

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])  # quotients of integers, rounded once


def whole_vectors(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding", scale: int = 256) -> DataFrame:
    """vec_id and x (array<long>) of the rows that take part."""
    v = F.col(column).cast("array<double>")
    usable = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    rows = vectors.filter(F.coalesce(usable, F.lit(False))).select(F.col(id_column).cast("long").alias("vec_id"), F.transform(v, lambda c: F.floor(scale * c)).alias("x"))
    sizes = rows.groupBy(F.size("x").alias("size")).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), F.desc("size")).first()
    if sizes is not None and sizes["size"] > MOST_DIMENSIONS:
        raise ValueError(f"vectors of {sizes['size']} dimensions; the scatter of at most {MOST_DIMENSIONS} fits the driver")
    return rows.filter(F.size("x") == (sizes["size"] if sizes is not None else 0))


def _matrices(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Each batch, in blocks, with its vectors as the rows of a matrix of longs."""
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK_ROWS):
            block = batch.slice(at, BLOCK_ROWS)
            yield block, block.column(column).flatten().to_numpy(zero_copy_only=False).reshape(block.num_rows, -1)


def _added(rows: DataFrame, run, *key: str) -> DataFrame:
    """Sums of doubles that partitions give by key."""
    return mapped(rows, run, ", ".join(f"{k} int" for k in key) + ", v double").groupBy(*key).agg(F.sum("v").alias("v"))


def sums_of(fit_list: DataFrame) -> tuple[int, list[int]]:
    """The number of vectors and the exact sum of every dimension."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, most = 0, None, 0
        for _, x in _matrices(batches, 0):
            n += len(x)
            most = max(most, *(abs(int(e)) for e in (x.max(), x.min())))
            if n * most > _LIMIT:
                raise OverflowError("sums of a partition don't fit 64 bits")
            total = x.sum(axis=0) if total is None else total + x.sum(axis=0)
        if n:
            yield pa.RecordBatch.from_pydict({"i": pa.array([-1, *range(len(total))], pa.int32()), "s": pa.array([n, *total.tolist()], pa.int64())})

    rows = dict(mapped(fit_list, add, "i int, s long").groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect())  # a row for each dimension
    n = int(rows.pop(-1, 0))
    return n, [int(rows[i]) for i in sorted(rows)]


def scatter_of(fit_list: DataFrame, mean: np.ndarray) -> np.ndarray:
    """The sum of the outer products of centred vectors."""
    d = len(mean)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, any_row = np.zeros((d, d)), False
        for _, x in _matrices(batches, 0):
            y = x - mean
            total += y.T @ y
            any_row = True
        if any_row:
            for at in range(0, d, 256):
                part = total[at : at + 256]
                yield pa.RecordBatch.from_pydict({"i": pa.array(np.repeat(np.arange(at, at + len(part)), d), pa.int32()), "j": pa.array(np.tile(np.arange(d), len(part)), pa.int32()), "v": pa.array(part.ravel())})

    out = np.zeros((d, d))
    for i, j, v in _added(fit_list, add, "i", "j").toLocalIterator():
        out[i, j] = v
    return (out + out.T) / 2


def pivoted_cholesky(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(L, order) with a[order][:, order] = L L', L lower trapezoidal with as many columns as the rank: the largest remaining diagonal entry is the next pivot."""
    a = a.copy()
    d = len(a)
    order = np.arange(d)
    low = np.zeros((d, d))
    tolerance = d * np.finfo(float).eps * max(float(a.diagonal().max(initial=0.0)), 0.0)
    for k in range(d):
        p = k + int(np.argmax(a.diagonal()[k:]))
        if a[p, p] <= tolerance:
            return low[:, :k], order
        swap = [p, k]
        a[[k, p]] = a[swap]
        a[:, [k, p]] = a[:, swap]
        low[[k, p]] = low[swap]
        order[[k, p]] = order[swap]
        low[k, k] = np.sqrt(a[k, k])
        low[k + 1 :, k] = a[k + 1 :, k] / low[k, k]
        a[k + 1 :, k + 1 :] -= np.outer(low[k + 1 :, k], low[k + 1 :, k])
    return low, order


def jacobi_columns(low: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """low with orthogonal columns: rotations of pairs of columns from the right until all are orthogonal to working precision.

    The pairs of a round have no column in common (a round robin), so a round is one step on whole matrices."""
    u = low.copy()
    r = u.shape[1]
    players = list(range(r + r % 2))
    for _ in range(sweeps):
        off = 0.0
        for _ in range(max(len(players) - 1, 0)):
            half = len(players) // 2
            pairs = [(i, j) for i, j in zip(players[:half], players[half:][::-1], strict=True) if i < r and j < r]
            players = [players[0], players[-1], *players[1:-1]]
            if not pairs:
                continue
            i, j = np.array(pairs).T
            x, y = u[:, i], u[:, j]
            a, b, c = (x * x).sum(axis=0), (y * y).sum(axis=0), (x * y).sum(axis=0)
            size = np.sqrt(a * b)
            off = max(off, float(np.max(np.abs(c) / np.where(size > 0, size, 1.0))))
            turn = np.abs(c) > np.finfo(float).tiny
            zeta = (b - a) / np.where(turn, 2 * c, 1.0)
            t = np.where(turn, np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta)), 0.0)
            cos = 1 / np.hypot(1.0, t)
            u[:, i], u[:, j] = cos * x - cos * t * y, cos * t * x + cos * y
        if off <= 4 * np.finfo(float).eps:
            break
    return u


def components_of(covariance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, components as rows) of a covariance, by falling eigenvalue; the entry of a component that is largest in size is positive."""
    low, order = pivoted_cholesky(covariance)
    u = jacobi_columns(low)
    values = (u * u).sum(axis=0)
    by_size = np.argsort(-values, kind="stable")
    rows = np.zeros((len(by_size), len(order)))
    rows[:, order] = (u / np.sqrt(np.where(values > 0, values, 1.0))).T[by_size]
    signs = np.sign(np.take_along_axis(rows, np.abs(rows).argmax(axis=1, keepdims=True), axis=1)) if len(rows) else np.ones((0, 1))
    return values[by_size], rows * signs


def fit_whitening(fit_list: DataFrame) -> Fit | None:
    """The fit of a list (x) of distinct whole vectors; None where it is empty."""
    n, sums = sums_of(fit_list)
    if not n:
        return None
    fit = Fit(n, sums, 0.0, np.zeros(0), np.zeros((0, len(sums))))
    covariance = scatter_of(fit_list, fit.mean) / n
    fit.values, fit.components = components_of(covariance)
    fit.trace = float(covariance.trace())
    return fit


def whitened(x: np.ndarray, fit: Fit, components: int) -> np.ndarray:
    return (x - fit.mean) @ fit.components[:components].T / np.sqrt(fit.values[:components])


def identity_error(fit_list: DataFrame, fit: Fit, components: int) -> float:
    """The largest absolute entry of the covariance of the whitened fit list minus the identity."""
    k = min(components, len(fit.values))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # products about the partition's own mean, which are put together with the means afterwards
        n, mean, m2 = 0, np.zeros(k), np.zeros((k, k))
        for _, x in _matrices(batches, 0):
            w = whitened(x, fit, k)
            own, size = w.mean(axis=0), len(w)
            m2 += (w - own).T @ (w - own) + np.outer(own - mean, own - mean) * (n * size / (n + size))
            mean += (own - mean) * size / (n + size)
            n += size
        if n:
            parts = {(-1, j): n * mean[j] for j in range(k)} | {(i, j): m2[i, j] + n * mean[i] * mean[j] for i in range(k) for j in range(k)}
            yield pa.RecordBatch.from_pydict({"i": pa.array([p[0] for p in parts], pa.int32()), "j": pa.array([p[1] for p in parts], pa.int32()), "v": pa.array([float(v) for v in parts.values()])})

    rows = {(r["i"], r["j"]): r["v"] / fit.n for r in _added(fit_list, add, "i", "j").collect()}  # components squared
    return max((abs(rows[i, j] - rows[-1, i] * rows[-1, j] - (i == j)) for i in range(k) for j in range(k)), default=0.0)


def _deviations(x: np.ndarray, fit: Fit) -> list[int]:
    """The exact sum over dimensions of (n x - S)^2 for every row."""
    most = fit.n * max(abs(int(x.max())), abs(int(x.min()))) + max(abs(s) for s in fit.sums)
    if most * most * x.shape[1] <= _LIMIT:
        y = fit.n * x - np.array(fit.sums, np.int64)
        return (y * y).sum(axis=1).tolist()
    out = [sum((fit.n * e - s) ** 2 for e, s in zip(row, fit.sums, strict=True)) for row in x.tolist()]
    if max(out) > _LIMIT:
        raise OverflowError("a squared deviation doesn't fit 64 bits")
    return out


OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, components: int = 4, id_column: str = "vec_id", column: str = "embedding", scale: int = 256) -> DataFrame:
    """A row for every usable vector and component (at most `components`, fewer where the rank is less)."""
    rows = whole_vectors(vectors, id_column, column, scale)
    fit_list = written(rows.select("x").distinct(), "vectors")
    fit = fit_whitening(fit_list)
    if fit is None or not len(fit.values):
        return vectors.sparkSession.createDataFrame([], OUT)
    k = min(components, len(fit.values))
    error = identity_error(fit_list, fit, k)
    schema = pa.schema([("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()), ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64())])

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, x in _matrices(batches, 1):
            m = len(x)
            each = np.repeat(np.arange(m), k)
            deviation = np.array(_deviations(x, fit), np.int64)
            columns = [
                block.column(0).take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()), pa.array(np.full(m * k, fit.n)), pa.array(deviation[each]),
                pa.array(whitened(x, fit, k).ravel()), pa.array(np.tile(fit.values[:k] / fit.trace, m)), pa.array(np.full(m * k, error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return mapped(rows, project, OUT)
