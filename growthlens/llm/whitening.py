"""Whitening of embeddings: distributed centred covariance, leading eigenvectors, projection with broadcast components.

Vectors become whole numbers, floor(scale * x). The model is fitted on each distinct one of them once: count and sums
are exact, the covariance sums centred products per partition. What reaches the driver is one d x d matrix, whatever the
number of rows. There it is brought to tridiagonal form by Householder reflections; bisection on Sturm counts finds the
leading eigenvalues, inverse iteration their vectors, which are kept orthogonal within clusters of near-equal values.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from growthlens.llm.shared import kept

_LONG = np.iinfo(np.int64)
#: Widths of the stored whole numbers; the first that holds all components of a vector is taken.
_WIDTHS = (np.int16, np.int32, np.int64)
#: Components whose share of the trace is below this are rounding, not directions.
_NOTHING = 1e-13


def whole(column: pa.Array, scale: int) -> list[bytes | None]:
    """floor(scale * x) + 0 of every component, packed; None for a vector that is null, empty or holds a null or
    non-finite component. The first byte is the width in bytes; what no long holds becomes the largest or smallest."""
    lengths = np.diff(column.offsets.to_numpy()).astype(np.int64)
    inner = column.flatten()
    values = inner.cast(pa.float64()).to_numpy(zero_copy_only=False)
    sizes = np.where(column.is_valid().to_numpy(zero_copy_only=False), lengths, 0)
    edge = np.cumsum(sizes) - sizes
    with np.errstate(over="ignore", invalid="ignore"):
        scaled = np.floor(values * scale)
    big = np.abs(scaled) >= 2.0**63
    x = np.where(big | ~np.isfinite(values), 0, scaled).astype(np.int64)
    x[big & (scaled > 0)], x[big & (scaled < 0)] = _LONG.max, _LONG.min
    out: list[bytes | None] = []
    bad = np.append(0, np.cumsum(~np.isfinite(values)))  # nulls arrive as NaN
    for a, n in zip(edge.tolist(), sizes.tolist()):
        if not n or bad[a + n] > bad[a]:
            out.append(None)
            continue
        own = x[a : a + n]
        least, most = own.min(), own.max()
        fits = next(w for w in _WIDTHS if np.iinfo(w).min <= least and most <= np.iinfo(w).max)
        out.append(bytes([np.dtype(fits).itemsize]) + own.astype(fits).tobytes())
    return out


def unpacked(column: pa.Array, dimensions: int) -> np.ndarray:
    """Rows of whole numbers."""
    out = np.empty((len(column), dimensions), np.int64)
    for i, blob in enumerate(column.to_pylist()):
        out[i] = np.frombuffer(blob, f"<i{blob[0]}", offset=1)
    return out


# Eigenvectors of a symmetric matrix


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, off-diagonal and orthogonal q with q.T @ a @ q tridiagonal, by Householder reflections."""
    a, n = a.copy(), len(a)
    q = np.eye(n)
    for k in range(n - 2):
        x = a[k + 1 :, k].copy()
        size = np.linalg.norm(x)
        if size == 0 or np.abs(x[1:]).max() <= 1e-300:
            continue
        x[0] += size if x[0] >= 0 else -size
        x /= np.linalg.norm(x)
        a[k + 1 :] -= 2 * np.outer(x, x @ a[k + 1 :])
        a[:, k + 1 :] -= 2 * np.outer(a[:, k + 1 :] @ x, x)
        q[:, k + 1 :] -= 2 * np.outer(q[:, k + 1 :] @ x, x)
    return np.diag(a).copy(), np.diag(a, -1).copy(), q


def below(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sturm counts: how many eigenvalues lie below each value, from the signs of the pivots."""
    least = max(np.abs(diagonal).max(), np.abs(off).max(initial=0), 1e-300) * 1e-18
    count = np.zeros(len(values), int)
    pivot = np.ones(len(values))
    for i, d in enumerate(diagonal):
        pivot = d - values - (off[i - 1] ** 2 / pivot if i else 0)
        pivot = np.where(np.abs(pivot) < least, -least, pivot)
        count += pivot < 0
    return count


def leading(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The k largest eigenvalues, falling: every one is bisected between bounds on all of them, to the last bit."""
    reach = np.append(np.abs(off), 0) + np.append(0, np.abs(off))
    low, high = np.full(k, (diagonal - reach).min()), np.full(k, (diagonal + reach).max())
    want = len(diagonal) - 1 - np.arange(k)  # so many eigenvalues are smaller
    for _ in range(120):
        mid = (low + high) / 2
        under = below(diagonal, off, mid) <= want
        low, high = np.where(under, mid, low), np.where(under, high, mid)
    return (low + high) / 2


def _solve(diagonal: np.ndarray, off: np.ndarray, shift: float, b: np.ndarray) -> np.ndarray:
    """(t - shift) x = b for a tridiagonal t, by elimination with row exchanges."""
    n = len(diagonal)
    least = max(np.abs(diagonal).max(), np.abs(off).max(initial=0), 1e-300) * 1e-16
    main, upper, second = diagonal - shift, np.append(off, 0.0), np.zeros(n)
    main, lower, x = main.copy(), off.copy(), b.copy()
    for i in range(n - 1):
        if abs(lower[i]) > abs(main[i]):
            main[i], lower[i] = lower[i], main[i]
            upper[i], main[i + 1] = main[i + 1], upper[i]
            if i + 2 < n:
                second[i], upper[i + 1] = upper[i + 1], 0.0
            x[i], x[i + 1] = x[i + 1], x[i]
        if abs(main[i]) < least:
            main[i] = least
        factor = lower[i] / main[i]
        main[i + 1] -= factor * upper[i]
        upper[i + 1] -= factor * second[i]
        x[i + 1] -= factor * x[i]
    if abs(main[-1]) < least:
        main[-1] = least
    for i in range(n - 1, -1, -1):
        rest = (upper[i] * x[i + 1] if i + 1 < n else 0) + (second[i] * x[i + 2] if i + 2 < n else 0)
        x[i] = (x[i] - rest) / main[i]
    return x


def vectors_of(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors, one column each, by inverse iteration; each is made orthogonal to those of its cluster."""
    scale = max(np.abs(diagonal).max(), np.abs(off).max(initial=0), 1e-300)
    rng = np.random.default_rng(11)
    out = np.zeros((len(diagonal), len(values)))
    first = 0
    for k, value in enumerate(values):
        if k and values[k - 1] - value > 1e-3 * scale:
            first = k  # a new cluster
        shift = value - (k - first) * 2e-16 * scale  # equal values would give equal vectors
        x = rng.standard_normal(len(diagonal))
        for _ in range(6):
            for _ in range(2):
                x -= out[:, first:k] @ (out[:, first:k].T @ x)
            x /= np.linalg.norm(x)
            x = _solve(diagonal, off, shift, x)
            x /= np.abs(x).max()
        for _ in range(2):
            x -= out[:, :k] @ (out[:, :k].T @ x)
            x /= np.linalg.norm(x)
        out[:, k] = x
    return out


def eigen(a: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues of a symmetric matrix, falling, and their unit vectors as columns."""
    k = min(k, len(a))
    size = np.abs(a).max(initial=0)
    if not size:
        return np.zeros(k), np.eye(len(a))[:, :k]
    diagonal, off, q = tridiagonal(a / size)
    values = leading(diagonal, off, k)
    return values * size, q @ vectors_of(diagonal, off, values)


# The distributed part


@dataclass
class Model:
    """n distinct vectors with exact sums; eigenvalues, unit components as columns, share of the trace of each."""

    dimensions: int
    n: int
    sums: list[int]
    values: np.ndarray
    components: np.ndarray
    explained: np.ndarray
    identity_error: float

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ self.components / np.sqrt(self.values)

    def deviation(self, x: np.ndarray) -> np.ndarray:
        """Sum over dimensions of (n * x - sum)^2, exact; what no long holds becomes the largest long."""
        most = int(np.abs(x.astype(np.float64)).max(initial=0)) * self.n + max((abs(s) for s in self.sums), default=0)
        if most * most * max(self.dimensions, 1) < 2**62:
            return ((x * self.n - np.array(self.sums, np.int64)) ** 2).sum(axis=1)
        exact = ((x.astype(object) * self.n - np.array(self.sums, object)) ** 2).sum(axis=1)
        return np.array([min(v, _LONG.max) for v in exact], np.int64)


def _packed(rows: DataFrame, vector: str, scale: int) -> DataFrame:
    """id and the packed whole numbers of the vector, null where it takes no part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(whole(batch.column("vector"), scale), pa.binary())], ["id", "x"])

    x = F.col(vector).cast("array<double>")
    # one bad component makes the vector null before its length matters
    return rows.select("id", x.alias("vector")).mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, x binary")


def _summed(fit: DataFrame, dimensions: int, cells: int, add) -> np.ndarray:
    """Sums over all rows of add(x) -> array of `cells` numbers, one array per partition, merged cell by cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cells)
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                total += add(unpacked(batch.column("x").slice(i, 4096), dimensions))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(cells, dtype=np.int32)), pa.array(total)], ["cell", "total"])

    out = np.zeros(cells)
    for cell, total in fit.select("x").mapInArrow(run, "cell int, total double").groupBy("cell").agg(F.sum("total")).collect():
        out[cell] = total
    return out


def _count_and_sums(fit: DataFrame, dimensions: int) -> tuple[int, list[int]]:
    """Number of rows and the exact sum of every dimension, added up as decimals of 38 digits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, [0] * dimensions
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                x = unpacked(batch.column("x").slice(i, 4096), dimensions)
                n += len(x)
                small = np.abs(x.astype(np.float64)).max(initial=0) < 2.0**50
                sums = [a + int(b) for a, b in zip(sums, x.sum(axis=0) if small else x.astype(object).sum(axis=0))]
        yield pa.RecordBatch.from_arrays([pa.array([*range(dimensions), -1], pa.int32()), pa.array([str(s) for s in [*sums, n]])], ["cell", "total"])

    found = fit.select("x").mapInArrow(run, "cell int, total string").groupBy("cell").agg(F.sum(F.col("total").cast("decimal(38,0)")))
    of = {cell: int(total) for cell, total in found.collect()}
    return of.get(-1, 0), [of.get(i, 0) for i in range(dimensions)]


def fit(packed: DataFrame, components: int) -> Model | None:
    """The model of the distinct packed vectors (column x), None if there are none.

    Vectors must agree in length: the most frequent length counts, the longer one of two.
    """
    stored = kept(packed.where("x is not null").select("x").distinct())
    size = ((F.length("x") - 1) / F.ascii(F.col("x").cast("string"))).cast("int")
    sized = stored.withColumn("dimensions", size)
    most = sized.groupBy("dimensions").count().orderBy(F.desc("count"), F.desc("dimensions")).first()
    if most is None:
        return None
    d = most["dimensions"]
    rows = sized.where(F.col("dimensions") == d).select("x")
    n, sums = _count_and_sums(rows, d)
    mean = np.array([s / n for s in sums])

    def products(x: np.ndarray) -> np.ndarray:
        centred = x - mean
        return (centred.T @ centred).ravel()

    covariance = _summed(rows, d, d * d, products).reshape(d, d) / n
    values, vectors = eigen((covariance + covariance.T) / 2, components)
    trace = float(np.trace(covariance))
    real = values > _NOTHING * trace if trace > 0 else np.zeros(len(values), bool)
    values, vectors = values[real], vectors[:, real]
    model = Model(d, n, sums, values, vectors, values / trace if trace > 0 else values, 0.0)
    k = len(values)
    if k:
        # the mean of the whitened vectors is zero but for rounding; it is taken off all the same
        moments = _summed(rows, d, k + k * k, lambda x: np.concatenate([(w := model.whitened(x)).sum(axis=0), (w.T @ w).ravel()])) / n
        spread = moments[k:].reshape(k, k) - np.outer(moments[:k], moments[:k])
        model.identity_error = float(np.abs(spread - np.eye(k)).max())
    return model


def whitened(
    vectors: DataFrame, *, id_column: str = "vec_id", vector: str = "embedding", scale: int = 256, components: int = 4
) -> DataFrame:
    """One row per vector and component: id_column, component int (from 1), n long, deviation long, whitened double,
    explained double, identity_error double.

    Vectors that are null, empty, or hold a null or non-finite component have no rows, nor have vectors of another
    length than the most frequent one. Repeated rows and null ids are kept. There are fewer components than asked for if
    the fitted vectors span fewer directions, none if they are all equal. Whole numbers beyond a long are cut to it, as
    is a deviation; other columns are not read.
    """
    rows = vectors.select(F.col(id_column).alias("id"), F.col(vector).alias("vector"))
    packed = _packed(rows, "vector", scale)
    model = fit(packed, components)
    id_type = rows.schema["id"].dataType.simpleString()
    schema = f"id {id_type}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None or not len(model.values):
        return vectors.sparkSession.createDataFrame([], schema).withColumnRenamed("id", id_column)
    shared = vectors.sparkSession.sparkContext.broadcast(model)  # d * k numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        k = len(model.values)
        for whole_batch in batches:
            for i in range(0, whole_batch.num_rows, 4096):
                batch = whole_batch.slice(i, 4096)
                x = unpacked(batch.column("x"), model.dimensions)
                n = len(x)
                each = np.repeat(np.arange(n), k)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").take(pa.array(each)),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n)),
                        pa.array(np.full(n * k, model.n)),
                        pa.array(model.deviation(x)[each]),
                        pa.array(model.whitened(x).ravel()),
                        pa.array(np.tile(model.explained, n)),
                        pa.array(np.full(n * k, model.identity_error)),
                    ],
                    ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    same = (F.length("x") - 1) == F.ascii(F.col("x").cast("string")) * model.dimensions
    return packed.where(same).mapInArrow(run, schema).withColumnRenamed("id", id_column)
