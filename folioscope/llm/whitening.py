"""Whitening of embeddings by their leading principal components.

1. Vectors become whole numbers, and the distinct ones are the fit list. Sums of each
   dimension are exact.
2. Tasks add up centred products of the fit list, one matrix for each task; matrices are
   added row by row, each row of all matrices by one stream of a second shuffle.
3. The driver holds the covariance alone (dimensions squared, whatever the rows): it is
   brought to tridiagonal form by Householder reflections, leading eigenvalues are found
   by bisection with Sturm counts, and their vectors by inverse iteration, in which those
   of close eigenvalues are kept orthogonal.
4. Components are sent to all tasks, which project every row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import store

#: Vectors are floor(SCALE * entry).
SCALE = 256
#: An eigenvalue below this share of the trace counts as zero; a gap between eigenvalues below CLUSTER of the largest makes them close.
FLAT, CLUSTER = 1e-13, 1e-3
#: Most dimensions whose covariance the driver takes: 8 bytes for each pair, 128 MB.
MOST_DIMENSIONS = 4096


# -- eigenvectors of one symmetric matrix ----------------------------------------------


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal and off-diagonal of Q'AQ, and the unit vectors of the reflections whose product is Q.

    Each reflection sends a column's entries below the off-diagonal to zero, and the rest of
    the matrix is updated by a product of rank two.
    """
    a = np.array(matrix, np.float64)
    n = len(a)
    mirrors = []
    for k in range(n - 2):
        x = a[k + 1 :, k]
        size = np.sqrt((x * x).sum())
        v = x.copy()
        v[0] += size if x[0] >= 0 else -size
        length = np.sqrt((v * v).sum())
        if length == 0 or not np.any(x[1:]):
            mirrors.append(np.zeros(n - k - 1))
            continue
        v /= length
        rest = a[k + 1 :, k + 1 :]
        p = rest @ v
        w = 2 * (p - (v @ p) * v)
        rest -= np.outer(v, w) + np.outer(w, v)
        a[k + 1 :, k] -= 2 * v * (v @ x)
        a[k, k + 1 :] = a[k + 1 :, k]
        mirrors.append(v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), mirrors


def reflected(vectors: np.ndarray, mirrors: list[np.ndarray]) -> np.ndarray:
    """Q times the columns of vectors."""
    out = vectors.copy()
    for k in range(len(mirrors) - 1, -1, -1):
        v = mirrors[k]
        out[k + 1 :] -= 2 * np.outer(v, v @ out[k + 1 :])
    return out


def count_below(diagonal: np.ndarray, off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many eigenvalues lie below each value: negative pivots of T - x, Sturm's count."""
    least = np.finfo(float).tiny / np.finfo(float).eps
    pivot = diagonal[0] - at
    count = (pivot < 0).astype(int)
    for d, e in zip(diagonal[1:], off, strict=True):
        pivot = np.where(np.abs(pivot) < least, -least, pivot)
        pivot = d - at - e * e / pivot
        count += pivot < 0
    return count


def leading_eigenvalues(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The k largest eigenvalues, falling, by bisection down to neighbouring doubles."""
    n = len(diagonal)
    reach = np.abs(np.concatenate([[0], off])) + np.abs(np.concatenate([off, [0]]))
    low, high = np.full(k, (diagonal - reach).min()), np.full(k, (diagonal + reach).max())
    span = max(np.abs(low).max(), np.abs(high).max(), np.finfo(float).tiny)
    low, high = low - 1e-12 * span, high + 1e-12 * span
    rank = n - 1 - np.arange(k)  # the j-th largest has so many below it
    for _ in range(1100):
        middle = low + (high - low) / 2
        if not ((middle > low) & (middle < high) & (high - low > 1e-16 * span)).any():
            break
        below = count_below(diagonal, off, middle) > rank
        high, low = np.where(below, middle, high), np.where(below, low, middle)
    return low + (high - low) / 2


def solve_shifted(diagonal: np.ndarray, off: np.ndarray, shift: float, right: np.ndarray) -> np.ndarray:
    """(T - shift) x = right by elimination with row exchanges; a zero pivot becomes a very small one."""
    n, scale = len(diagonal), max(np.abs(diagonal).max(), np.abs(off).max(initial=0), 1e-300)
    tiny = np.finfo(float).eps * scale
    d, x = diagonal - shift, right.copy()
    up, up2, low = np.append(off, 0.0), np.zeros(n), off.copy()
    for i in range(n - 1):
        if abs(low[i]) > abs(d[i]):  # the next row has the larger entry
            d[i], low_i = low[i], d[i]
            up[i], d[i + 1] = d[i + 1], up[i]
            if i + 2 < n:
                up2[i], up[i + 1] = up[i + 1], 0.0
            x[i], x[i + 1] = x[i + 1], x[i]
        else:
            low_i = low[i]
        if d[i] == 0:
            d[i] = tiny
        f = low_i / d[i]
        d[i + 1] -= f * up[i]
        if i + 2 < n:
            up[i + 1] -= f * up2[i]
        x[i + 1] -= f * x[i]
    if abs(d[-1]) < tiny:
        d[-1] = tiny
    for i in range(n - 1, -1, -1):
        x[i] = (x[i] - (up[i] * x[i + 1] if i + 1 < n else 0) - (up2[i] * x[i + 2] if i + 2 < n else 0)) / d[i]
        if abs(x[i]) > 1e150:
            x[i:] /= 1e150
            x[:i] /= 1e150
    return x


def leading_components(matrix: np.ndarray, k: int, seed: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues, falling, and their unit eigenvectors as rows; the entry of most size in each is positive."""
    n = len(matrix)
    k = min(k, n)
    scale = np.abs(matrix).max(initial=0)
    if not scale:
        return np.zeros(k), np.eye(n)[:k]
    diagonal, off, mirrors = tridiagonal(matrix / scale)
    values = leading_eigenvalues(diagonal, off, k)
    rng = np.random.default_rng(seed)
    vectors = np.zeros((n, k))
    size, first, shift = max(np.abs(values[0]), 1e-300), 0, None
    for j in range(k):
        if j and values[j - 1] - values[j] > CLUSTER * size:
            first = j
        # equal eigenvalues are moved apart by some roundings, so that their solutions differ
        shift = values[j] if j == first else min(values[j], shift - 4 * np.finfo(float).eps * size)
        x = rng.standard_normal(n)
        for _ in range(6):
            x = solve_shifted(diagonal, off, shift, x / np.abs(x).max())
            x /= np.abs(x).max()
            for _ in range(2):
                x -= vectors[:, first:j] @ (vectors[:, first:j].T @ x)
            x /= np.sqrt(x @ x)
        vectors[:, j] = x
    rows = reflected(vectors, mirrors).T
    rows /= np.sqrt((rows * rows).sum(1))[:, None]
    rows *= np.sign(rows[np.arange(k), np.abs(rows).argmax(1)])[:, None]
    # Rayleigh's quotient is nearer than the bisection's end where reflections rounded
    values = np.einsum("ij,jk,ik->i", rows, matrix / scale, rows) * scale
    return values, rows


# -- the fit list, in tasks --------------------------------------------------------------


def _rows(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    return batch.column("x").flatten().to_numpy().reshape(-1, dim)


def _sums(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[pa.RecordBatch]:
    """Rows and sums of each dimension of a task, as decimal strings, so that no sum overflows."""
    count, total = 0, np.zeros(dim, object)
    for batch in batches:
        x = _rows(batch, dim)
        count += len(x)
        half = (x >> 32).sum(0).astype(object), (x & 0xFFFFFFFF).sum(0).astype(object)
        total = total + half[0] * (1 << 32) + half[1]
    if count:
        yield pa.RecordBatch.from_arrays([pa.array([count] * dim), pa.array(range(dim), pa.int32()), pa.array([str(s) for s in total])], names=["n", "dimension", "total"])


def _products(batches: Iterator[pa.RecordBatch], dim: int, project) -> Iterator[pa.RecordBatch]:
    """Sums of products of centred (and projected) rows of a task, a row for each row of the matrix."""
    total = None
    for batch in batches:
        y = project.value(_rows(batch, dim))
        total = y.T @ y + (0 if total is None else total)
    yield from _matrix_rows(total)


def _matrix_rows(total: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    if total is not None:
        at = pa.array(np.arange(len(total) + 1, dtype=np.int32) * total.shape[1])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.ListArray.from_arrays(at, pa.array(total.ravel()))], names=["row", "entries"])


def _add_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of lists of one row; a task holds at most the rows of one matrix."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        lists = batch.column("entries")
        at, values = lists.offsets.to_numpy(), lists.values.to_numpy()
        for row, s, e in zip(batch.column("row").to_pylist(), at[:-1], at[1:], strict=True):
            sums[row] = values[s:e] + sums.get(row, 0)
    for row, entries in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([row], pa.int32()), pa.array([entries])], names=["row", "entries"])


def _covariance(fit_list: DataFrame, dim: int, width: int, n: int, project) -> np.ndarray:
    sent = fit_list.sparkSession.sparkContext.broadcast(project)
    parts = fit_list.mapInArrow(lambda it: _products(it, dim, sent), "row int, entries array<double>")
    added = parts.repartition("row").mapInArrow(_add_rows, "row int, entries array<double>")
    out = np.zeros((width, width))
    for r in added.collect():  # width rows of width numbers, whatever the input
        out[r["row"]] = r["entries"]
    return out / n


@dataclass
class Centre:
    """Whole vectors less their mean, which is total / n: quotients are taken apart, so that large sums keep their digits."""

    n: int
    total: list[int]
    weights: np.ndarray | None = None

    def __post_init__(self):
        self.whole = np.array([s // self.n for s in self.total], np.int64)
        self.part = np.array([(s % self.n) / self.n for s in self.total])

    def __call__(self, x: np.ndarray) -> np.ndarray:
        y = (x - self.whole) - self.part
        return y if self.weights is None else y @ self.weights


@dataclass
class Whitening:
    """What a fit gives: n and sums of the fit list, eigenvalues, components as rows, their share of the trace, and the greatest error of identity."""

    dim: int
    n: int
    total: list[int]
    values: np.ndarray
    components: np.ndarray
    explained: np.ndarray
    identity_error: float


def whole_vectors(rows: DataFrame) -> DataFrame:
    """vec_id and x, the whole numbers floor(256 * entry), of rows whose vector is neither null nor empty and has finite entries alone."""
    sound = F.coalesce((F.size("embedding") > 0) & F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False))
    return rows.where(sound).select("vec_id", F.transform("embedding", lambda c: F.floor(c.cast("double") * SCALE).cast("long")).alias("x"))


def fit(vectors: DataFrame, components: int = 4) -> Whitening | None:
    """Components of the distinct vectors of ``whole_vectors`` rows of one length; None if there are none.

    Where lengths differ the commonest counts (of equally common ones the greater), and
    vectors of other lengths are not fitted. An eigenvalue that is zero (below 1e-13 of the
    trace) can't be divided by: its ``explained`` is 0 and it is left out of ``identity_error``.
    """
    lengths = vectors.groupBy(F.size("x").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    if lengths is None:
        return None
    dim = lengths["dim"]
    if dim > MOST_DIMENSIONS:
        raise ValueError(f"vectors of {dim} entries: the covariance of at most {MOST_DIMENSIONS} fits the driver")
    fit_list = store(vectors.where(F.size("x") == dim).select("x").distinct(), "fit-list")
    parts = fit_list.mapInArrow(lambda it: _sums(it, dim), "n long, dimension int, total string")
    sums = parts.groupBy("dimension").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).orderBy("dimension").collect()
    n, total = sums[0]["n"], [int(r["total"]) for r in sums]
    covariance = _covariance(fit_list, dim, dim, n, Centre(n, total))
    values, rows = leading_components((covariance + covariance.T) / 2, components)
    trace = float(np.trace(covariance))
    steep = values > FLAT * trace
    scales = np.where(steep, 1 / np.sqrt(np.where(steep, values, 1)), 0)
    error = 0.0
    if steep.any():
        whitened = _covariance(fit_list, dim, len(values), n, Centre(n, total, (rows * scales[:, None]).T))
        error = float(np.abs(whitened - np.eye(len(values)))[np.ix_(steep, steep)].max())
    return Whitening(dim, n, total, values, rows, np.where(steep, values / trace if trace else 0, 0.0), error)


def _project(batches: Iterator[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:
    m: Whitening = sent.value
    steep = m.explained > 0
    centre = Centre(m.n, m.total, (m.components / np.sqrt(np.where(steep, m.values, 1))[:, None]).T)
    total, k = np.array(m.total, object), len(m.values)
    narrow = max((abs(t) for t in m.total), default=0) < 1 << 62
    for batch in batches:
        if not batch.num_rows:
            continue
        x = _rows(batch, m.dim)
        z = centre(x)
        z[:, ~steep] = np.nan
        far = float(np.abs(x.astype(float) * m.n - total.astype(float)).max())
        if narrow and float(np.abs(x).max()) * m.n < 1 << 62 and far * far * m.dim < 1 << 62:
            y = x * m.n - total.astype(np.int64)
            deviation = (y * y).sum(1).astype(object)
        else:
            y = x.astype(object) * m.n - total
            deviation = (y * y).sum(1)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("vec_id").take(pa.array(np.repeat(np.arange(len(x)), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                pa.array(np.repeat([str(d) for d in deviation], k)), pa.array(z.ravel(), pa.float64(), from_pandas=True), pa.array(np.tile(m.explained, len(x)), pa.float64()),
            ],
            names=["vec_id", "component", "deviation", "whitened", "explained"],
        )


def whiten(rows: DataFrame, components: int = 4) -> DataFrame:
    """vec_id, component (from 1), n, deviation decimal(38,0), whitened, explained and identity_error: a row for each vector and component.

    Vectors that are null, empty or hold a null or an entry that is not finite are left out,
    as are those of another length than the commonest. Rows without a vec_id take part and
    keep their null; repeated rows come back as often as they are there, but the fit knows
    each distinct vector once. There are at most as many components as dimensions. Where an
    eigenvalue is zero (one distinct vector, or vectors on a line), ``whitened`` is null and
    ``explained`` 0. Entries of 2^55 and more end at the greatest whole number. ``deviation``
    beyond 38 digits is null. Other columns are ignored; no vectors give an empty table.
    """
    spark, kind = rows.sparkSession, dict(rows.dtypes)["vec_id"]
    vectors = whole_vectors(rows)
    model = fit(vectors, components)
    out = f"vec_id {kind}, component int, deviation string, whitened double, explained double"
    if model is None:
        shaped = spark.createDataFrame([], out)
        n, error = 0, 0.0
    else:
        sent = spark.sparkContext.broadcast(model)
        shaped = vectors.where(F.size("x") == model.dim).mapInArrow(lambda it: _project(it, sent), out)
        n, error = model.n, model.identity_error
    return shaped.select(
        "vec_id", "component", F.lit(n).cast("long").alias("n"), F.col("deviation").try_cast("decimal(38,0)").alias("deviation"),
        "whitened", "explained", F.lit(error).alias("identity_error"),
    )
