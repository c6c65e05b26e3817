"""Whitening of vectors: principal components of their covariance, scaled to unit variance.

Two passes over the vectors give the sums and then the covariance, centred before multiplying: each task adds the products of its
own rows, and the tasks' matrices are added row by row. What reaches the driver is one matrix of the vectors' width,
whatever the number of vectors. There Householder reflections make it tridiagonal, counts of sign changes (Sturm) halve an interval
around each leading eigenvalue down to the last digit, and inverse iteration gives its vector; vectors of eigenvalues that lie
close together are made orthogonal to each other in every round. Mean and components go to the tasks as a broadcast of that same size.

Entries are counted on a grid: an entry c becomes floor(64 c) + 1,000,000, a whole number, so sums and squared distances are exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tollgate.llm.vectors import matrix
from tollgate.sources.artifacts import materialize

GRID, OFFSET = 64, 1_000_000
#: Components that are returned at most.
COMPONENTS = 32
#: The tasks' matrices are added in so many groups for each of their rows, and these once more.
_GROUPS = 64
_EPS = float(np.finfo(float).eps)


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, second diagonal and the orthogonal ``q`` with ``a = q t q'``, by Householder reflections."""
    a, n = a.copy(), len(a)
    q = np.eye(n)
    for k in range(n - 2):
        x = a[k + 1:, k]
        size = np.linalg.norm(x)
        if size == 0 or not x[1:].any():
            continue
        v = x / size
        v[0] += np.copysign(1.0, v[0])
        v /= np.linalg.norm(v)
        low = a[k + 1:, k + 1:]
        p = low @ v
        w = p - (v @ p) * v
        low -= 2 * (np.outer(v, w) + np.outer(w, v))
        a[k + 1:, k] -= 2 * v * (v @ x)
        a[k, k + 1:] = a[k + 1:, k]
        q[:, k + 1:] -= 2 * np.outer(q[:, k + 1:] @ v, v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), q


def counts_below(d: np.ndarray, e: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """How many eigenvalues of the tridiagonal matrix lie below each shift: the negative pivots of ``t - shift``."""
    tiny = _EPS * _EPS * max(float(np.abs(e).max(initial=0)), float(np.abs(d).max(initial=0)), np.finfo(float).tiny / _EPS ** 2)
    found = np.zeros(len(shifts), np.int64)
    pivot = np.ones(len(shifts))
    for i in range(len(d)):
        pivot = d[i] - shifts - (e[i - 1] ** 2 / pivot if i else 0.0)
        pivot = np.where(np.abs(pivot) < tiny, -tiny, pivot)
        found += pivot < 0
    return found


def leading_values(d: np.ndarray, e: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` largest eigenvalues, falling: all intervals are halved at once until no number lies between their ends."""
    n = len(d)
    reach = np.append(np.abs(e), 0) + np.append(0, np.abs(e))
    wide = 2 * _EPS * float(np.abs(d).max() + reach.max()) + np.finfo(float).tiny
    low, high = np.full(k, (d - reach).min() - wide), np.full(k, (d + reach).max() + wide)
    wanted = n - np.arange(k)  # an eigenvalue's number from below
    for _ in range(2000):
        middle = (low + high) / 2
        if ((middle <= low) | (middle >= high)).all():
            break
        above = counts_below(d, e, middle) >= wanted
        high, low = np.where(above, middle, high), np.where(above, low, middle)
    return (low + high) / 2


def _solve(d: np.ndarray, e: np.ndarray, values: np.ndarray, right: np.ndarray) -> np.ndarray:
    """``(t - value) x = right`` for all values at once: elimination with exchange of neighbouring rows."""
    n, k = right.shape
    tiny = _EPS * max(float(np.abs(d).max() + 2 * np.abs(e).max(initial=0)), np.finfo(float).tiny / _EPS)
    x = right.copy()
    u0, u1, u2 = np.empty((n, k)), np.zeros((n, k)), np.zeros((n, k))
    diagonal, beside = d[0] - values, np.full(k, e[0] if n > 1 else 0.0)
    for i in range(n - 1):
        below, next_diagonal, next_beside = e[i], d[i + 1] - values, e[i + 1] if i + 2 < n else 0.0
        swap = abs(below) > np.abs(diagonal)
        pivot = np.where(swap, below, diagonal)
        pivot = np.where(np.abs(pivot) < tiny, tiny, pivot)
        factor = np.where(swap, diagonal, below) / pivot
        u0[i], u1[i], u2[i] = pivot, np.where(swap, next_diagonal, beside), np.where(swap, next_beside, 0.0)
        top = np.where(swap, x[i + 1], x[i])
        x[i + 1] = np.where(swap, x[i], x[i + 1]) - factor * top
        x[i] = top
        diagonal = np.where(swap, beside, next_diagonal) - factor * u1[i]
        beside = np.where(swap, 0.0, next_beside) - factor * u2[i]
    u0[n - 1] = np.where(np.abs(diagonal) < tiny, tiny, diagonal)
    for i in range(n - 1, -1, -1):
        if i + 1 < n:
            x[i] -= u1[i] * x[i + 1]
        if i + 2 < n:
            x[i] -= u2[i] * x[i + 2]
        x[i] /= u0[i]
    return x


def leading_vectors(d: np.ndarray, e: np.ndarray, values: np.ndarray, rounds: int = 4) -> np.ndarray:
    """Unit eigenvectors as columns, by inverse iteration; those of a cluster are made orthogonal in each round."""
    n, k = len(d), len(values)
    scale = float(np.abs(d).max() + 2 * np.abs(e).max(initial=0)) or 1.0
    # A cluster is a chain of neighbours closer than a thousandth of the matrix. Its values are set apart by a few last digits.
    cluster = np.cumsum(np.append(0, (values[:-1] - values[1:]) > 1e-3 * scale)) if k else np.zeros(0, int)
    shifts = values.copy()
    for i in range(1, k):
        shifts[i] = min(shifts[i], shifts[i - 1] - 4 * _EPS * scale) if cluster[i] == cluster[i - 1] else shifts[i]
    x = np.random.default_rng(1).standard_normal((n, k))
    x /= np.linalg.norm(x, axis=0)
    for _ in range(rounds):
        x = _solve(d, e, shifts, x)
        x /= np.abs(x).max(axis=0)
        x /= np.linalg.norm(x, axis=0)
        for i in range(k):
            first = int(np.searchsorted(cluster, cluster[i]))
            for _ in range(2 if i > first else 0):
                x[:, i] -= x[:, first:i] @ (x[:, first:i].T @ x[:, i])
                x[:, i] /= np.linalg.norm(x[:, i])
    return x


def leading_pairs(a: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues of a symmetric matrix, falling, and their unit vectors as rows (largest entry positive)."""
    n = len(a)
    k = min(k, n)
    scale = float(np.abs(a).max(initial=0))
    if not k or scale == 0:
        return np.zeros(k), np.eye(n)[:k]
    d, e, q = tridiagonal(a / scale)
    values = leading_values(d, e, k)
    rows = (q @ leading_vectors(d, e, values)).T
    rows /= np.linalg.norm(rows, axis=1)[:, None]
    rows *= np.sign(rows[np.arange(k), np.abs(rows).argmax(axis=1)])[:, None]
    return values * scale, rows


@dataclass(frozen=True)
class Whitening:
    """What a row needs: the number of vectors, their sums, and the components with their eigenvalues."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    components: np.ndarray  # one per row
    trace: float

    @property
    def mean(self) -> np.ndarray:
        """The mean, from the exact sums."""
        return np.array([s / self.n for s in self.sums])

    def centred(self, x: np.ndarray) -> np.ndarray:
        # The whole part of the mean is taken off exactly; what remains is below 1.
        whole = np.array([s // self.n for s in self.sums], np.int64)
        rest = np.array([(s % self.n) / self.n for s in self.sums])
        return (x - whole).astype(float) - rest

    def project(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.components.T / np.sqrt(self.values)

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """The exact sum of squares of ``n x - sums``; null if it does not fit 64 bits."""
        whole = np.array([s // self.n for s in self.sums], np.int64)
        reach = int(np.abs(x - whole).max(initial=0)) + 1
        if (reach * self.n) ** 2 * max(1, x.shape[1]) < 2 ** 63:
            away = (x - whole) * self.n - np.array([s % self.n for s in self.sums], np.int64)
            return (away * away).sum(axis=1).tolist()
        exact = [sum((self.n * int(v) - s) ** 2 for v, s in zip(row, self.sums, strict=True)) for row in x.tolist()]
        return [v if v < 2 ** 63 else None for v in exact]


def on_grid(vector: Column) -> Column:
    """Whole numbers for the entries; null if the vector is null or one of its entries is null or not finite."""
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return F.when(~bad, F.transform(vector, lambda c: F.floor(c * GRID).cast("long") + OFFSET))


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number and exact sums of this task's rows, in two halves of 32 bits so that none runs over."""
    n, high, low = 0, None, None
    for batch in batches:
        x = matrix(batch.column(0))
        if len(x):
            parts = (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)
            n, high, low = n + len(x), parts[0] if high is None else high + parts[0], parts[1] if low is None else low + parts[1]
    if n:
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(high)), pa.int32()), pa.array([n] * len(high), pa.int64()),
                                          pa.array(high), pa.array(low)], names=["dim", "n", "high", "low"])


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of a partition's arrays by ``row``, one array held for each row."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for row, values in zip(batch.column(0).to_pylist(), matrix(batch.column(1)), strict=True):
            total[row] = total[row] + values if row in total else values
    if total:
        width = len(next(iter(total.values())))
        flat = pa.array(np.concatenate(list(total.values())))
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.ListArray.from_arrays(
            pa.array(np.arange(len(total) + 1) * width, pa.int32()), flat)], names=["row", "values"])


def _covariance(x: DataFrame, width: int, n: int, prepare) -> np.ndarray:
    """The covariance, divisor ``n``, of ``prepare`` (rows to centred doubles) over all rows of ``x``."""
    from pyspark import TaskContext

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            rows = prepare(matrix(batch.column(0)))
            total += rows.T @ rows
        if total.any():
            lists = pa.ListArray.from_arrays(pa.array(np.arange(width + 1) * width, pa.int32()), pa.array(total.ravel()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(width), pa.int32()), lists, pa.array([TaskContext.get().partitionId() % _GROUPS] * width, pa.int32())],
                names=["row", "values", "group"])

    parts = x.mapInArrow(products, "row int, values array<double>, group int")
    some = parts.repartition("row", "group").select("row", "values").mapInArrow(_add, "row int, values array<double>")
    rows = some.repartition("row").mapInArrow(_add, "row int, values array<double>").collect()  # width numbers in width rows
    total = np.zeros((width, width))
    for r in rows:
        total[r["row"]] = r["values"]
    return (total + total.T) / 2 / n


def fit(x: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Learn from a column ``x`` of whole-number vectors of one width. None if there is no vector.

    Components whose variance is nothing but rounding (a constant entry, fewer vectors than entries) are left out: no scale
    makes their variance one.
    """
    sums = x.mapInArrow(_sums, "dim int, n long, high long, low long").groupBy("dim").agg(
        F.sum("n").alias("n"), F.sum(F.col("high").cast("decimal(38,0)")).alias("high"), F.sum(F.col("low").cast("decimal(38,0)")).alias("low"))
    rows = sorted(sums.collect(), key=lambda r: r["dim"])  # one row for each entry of a vector
    if not rows:
        return None
    n, totals = rows[0]["n"], tuple((int(r["high"]) << 32) + int(r["low"]) for r in rows)
    start = Whitening(n, totals, np.zeros(0), np.zeros((0, len(totals))), 0.0)
    covariance = _covariance(x, len(totals), n, start.centred)
    values, vectors = leading_pairs(covariance, components)
    real = values > len(totals) * 4 * _EPS * max(float(values.max(initial=0)), 0.0)
    return Whitening(n, totals, values[real], vectors[real], float(np.trace(covariance)))


def identity_error(x: DataFrame, model: Whitening) -> float:
    """The largest entry, by size, of the whitened vectors' covariance minus the identity, measured on all of them."""
    width = len(model.values)
    if not width:
        return 0.0

    def means(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(width), pa.int32()), pa.array(model.project(matrix(batch.column(0))).sum(axis=0))],
                                                 names=["dim", "total"])

    totals = x.mapInArrow(means, "dim int, total double").groupBy("dim").agg(F.sum("total").alias("total")).collect()
    mean = np.zeros(width)
    for r in totals:
        mean[r["dim"]] = r["total"] / model.n
    away = _covariance(x, width, model.n, lambda rows: model.project(rows) - mean) - np.eye(width)
    return float(np.abs(away).max())


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """``id, component, n, deviation, whitened, explained, identity_error``: one row per vector and component.

    Vectors that are null or hold null or non-finite entries are left out; zero vectors are not. Vectors of different widths have
    nothing in common: each width is a table of its own, with its own ``n``, fitted one width after the other. An empty table or
    vectors without spread or entries give no rows. Repeated rows and ids each count and come back, ids may be null. Equal
    eigenvalues share a space, of which any orthogonal basis is returned. ``deviation`` is null beyond 64 bits. Other
    columns are not looked at.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), on_grid(F.col(vector_col).cast("array<double>")).alias("x"))
    rows = materialize(rows.where(F.col("x").isNotNull() & (F.size("x") > 0)), "grid")
    out = []
    for width in sorted(r[0] for r in rows.select(F.size("x")).distinct().collect()):
        mine = rows.where(F.size("x") == width)
        model = fit(mine.select("x"), components)
        if model is not None and len(model.values):
            out.append(_project(mine, model, identity_error(mine.select("x"), model)))
    return reduce(DataFrame.unionByName, out) if out else spark.createDataFrame([], SCHEMA)


SCHEMA = "id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def _project(rows: DataFrame, model: Whitening, error: float) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(model)  # two vectors and some components, whatever the data
    step = max(1, (1 << 20) // max(len(model.values), len(model.sums)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        k = len(known.values)
        explained = known.values / known.trace
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, min(step, batch.num_rows - at))
                x, m = matrix(part.column(1)), part.num_rows
                of = pa.array(np.repeat(np.arange(m), k))
                yield pa.RecordBatch.from_arrays([
                    part.column(0).take(of), pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()), pa.array(np.full(m * k, known.n)),
                    pa.array(known.deviation(x), pa.int64()).take(of), pa.array(known.project(x).ravel()),
                    pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error))],
                    names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.select("id", "x").mapInArrow(run, SCHEMA)
