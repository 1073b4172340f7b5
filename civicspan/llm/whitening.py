"""Whitening of embeddings by their principal components.

Entries become integers on a grid of ``1 / scale``. The model is fitted on each distinct integer vector once, so that
copies don't weigh more. Tasks add up the scatter of centred vectors, and only its entries, as many as the dimension
squared, reach the driver. There a Cholesky factorisation with diagonal pivoting turns the scatter into a triangular
factor, one-sided Jacobi rotations make the factor's columns orthogonal, and then their squared norms are the eigenvalues
and the normalised columns the components. No product of the factor with itself is formed, so that small eigenvalues
keep their digits.

Defined cases: rows whose vector is null, empty or has null, infinite or NaN entries are left out, and so are those of another
length than most have (of equally frequent lengths, the longer counts); rows with a null id or with equal ids all get results;
directions without variance are no components, so equal vectors give no rows; an empty table gives an empty result;
a deviation too large for a long is null; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civicspan.llm.common import small_batches, written

SCALE = 256
#: Sweeps over all pairs of columns; the angles shrink quadratically, so that about ten are used.
MOST_SWEEPS = 60
EPSILON = float(np.finfo(np.float64).eps)


@dataclass(frozen=True)
class Whitening:
    """``n`` distinct vectors with ``sums`` of each dimension; ``components`` are rows of unit length by falling
    ``eigenvalues`` of the covariance, and ``identity_error`` is the largest entry of the whitened vectors' covariance less the
    identity."""

    n: int
    sums: np.ndarray
    eigenvalues: np.ndarray
    components: np.ndarray
    trace: float
    identity_error: float = 0.0

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Squared distance of each integer vector from the mean, times ``n`` squared."""
        apart = self.n * x.astype(np.float64) - self.sums
        rough = (apart * apart).sum(axis=1)
        whole = self.n * x - self.sums
        exact = (whole * whole).sum(axis=1)
        return [int(e) if r < 9.2e18 else None for e, r in zip(exact, rough, strict=True)]

    def whitened(self, x: np.ndarray) -> np.ndarray:
        centred = x - self.sums / self.n
        return centred @ self.components.T / np.sqrt(self.eigenvalues)


def is_whole(vector: Column) -> Column:
    """Whether a vector has entries, and all are finite."""
    entry_is_finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, entry_is_finite), F.lit(False))


def usual_length(vectors: DataFrame, column: str) -> int | None:
    """The length that most whole vectors have, of equally frequent ones the longest."""
    lengths = vectors.where(is_whole(F.col(column))).groupBy(F.size(column).alias("length")).agg(F.count("*").alias("rows"))
    return lengths.agg(F.max_by("length", F.struct("rows", "length"))).first()[0]


def on_grid(vectors: DataFrame, key: str, column: str, length: int, scale: int, *also: str) -> DataFrame:
    """``key, x`` of the whole vectors of this length, and the columns ``also``; ``x`` has longs."""
    whole = vectors.where(is_whole(F.col(column)) & (F.size(column) == length))
    x = F.transform(column, lambda c: F.floor(c.cast("double") * scale))
    return whole.select(F.col(key).alias("key"), x.alias("x"), *also)


def matrix(column: pa.ListArray, kind: type) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), -1)


def _sums(vectors: DataFrame, kind: str) -> tuple[int, np.ndarray]:
    """The number of vectors in ``x``, and the sum of each dimension; ``kind`` is the type of the entries."""
    of = np.int64 if kind == "long" else np.float64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(0, of)
        for batch in small_batches(batches):
            if batch.num_rows:
                n, total = n + batch.num_rows, (total if n else 0) + matrix(batch.column("x"), of).sum(axis=0)
        columns = [pa.array(range(len(total)), pa.int32()), pa.array([n] * len(total), pa.int64()), pa.array(total)]
        yield pa.RecordBatch.from_arrays(columns, names=["i", "n", "total"])

    rows = vectors.select("x").mapInArrow(run, f"i int, n long, total {kind}").groupBy("i").agg(F.sum("n"), F.sum("total"))
    rows = sorted(rows.collect())
    return (rows[0][1], np.array([r[2] for r in rows], of)) if rows else (0, np.zeros(0, of))


def _scatter(vectors: DataFrame, centre: np.ndarray) -> np.ndarray:
    """The sum of all products of two entries of ``x``, less the centre before they are multiplied."""
    d = len(centre)
    row, column = np.tril_indices(d)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))
        for batch in small_batches(batches):
            if batch.num_rows:
                centred = matrix(batch.column("x"), np.float64) - centre
                total += centred.T @ centred
        yield pa.RecordBatch.from_pydict({"i": row.astype("i4"), "j": column.astype("i4"), "total": total[row, column]})

    rows = vectors.select("x").mapInArrow(run, "i int, j int, total double").groupBy("i", "j").agg(F.sum("total")).collect()
    made = np.zeros((d, d))
    for i, j, total in rows:
        made[i, j] = made[j, i] = total
    return made


def pivoted_cholesky(scatter: np.ndarray) -> np.ndarray:
    """``factor`` with ``factor @ factor.T == scatter``: triangular but for the order of its rows, and with as many
    columns as the scatter has rank. The next column always takes the dimension with most variance left."""
    d = len(scatter)
    rest, left = scatter.diagonal().copy(), np.ones(d, bool)
    limit = d * EPSILON * max(rest.max(initial=0.0), 0.0)
    factor = np.zeros((d, d))
    for k in range(d):
        pivot = int(np.argmax(np.where(left, rest, -np.inf)))
        if rest[pivot] <= limit:
            return factor[:, :k]
        left[pivot] = False
        root = np.sqrt(rest[pivot])
        factor[pivot, k] = root
        factor[left, k] = (scatter[left, pivot] - factor[left, :k] @ factor[pivot, :k]) / root
        rest[left] -= factor[left, k] ** 2
    return factor


def orthogonal_columns(factor: np.ndarray) -> np.ndarray:
    """The factor with its columns turned two at a time until any two are orthogonal, longest first."""
    turned = factor.T.copy()
    r, d = turned.shape
    enough = EPSILON * np.sqrt(max(d, 1))
    for _ in range(MOST_SWEEPS):
        settled = True
        for p in range(r - 1):
            for q in range(p + 1, r):
                a, b = turned[p], turned[q]
                alpha, beta, gamma = a @ a, b @ b, a @ b
                if abs(gamma) <= enough * np.sqrt(alpha * beta):
                    continue
                settled = False
                zeta = (beta - alpha) / (2 * gamma)
                t = (1 if zeta >= 0 else -1) / (abs(zeta) + np.hypot(1, zeta))
                c = 1 / np.hypot(1, t)
                turned[p], turned[q] = c * (a - t * b), c * (b + t * a)
        if settled:
            break
    return turned[np.argsort(-(turned**2).sum(axis=1), kind="stable")].T


def principal_axes(scatter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of the scatter, falling and over 0, and their unit eigenvectors as rows."""
    columns = orthogonal_columns(pivoted_cholesky(scatter))
    squares = (columns**2).sum(axis=0)
    return squares, (columns / np.sqrt(squares)).T


def fit(vectors: DataFrame, column: str = "embedding", scale: int = SCALE, most: int | None = None) -> Whitening | None:
    """The whitening by the first ``most`` components (None: all); None if no vector is whole."""
    length = usual_length(vectors, column)
    if length is None:
        return None
    distinct = written(on_grid(vectors, column, column, length, scale).select("x").distinct(), "distinct-vectors")
    n, sums = _sums(distinct, "long")
    scatter = _scatter(distinct, sums / n)
    squares, axes = principal_axes(scatter)
    model = Whitening(n, sums, squares[:most] / n, axes[:most], float(np.trace(scatter)) / n)
    return Whitening(**{**model.__dict__, "identity_error": _identity_error(distinct, model)})


def _identity_error(distinct: DataFrame, model: Whitening) -> float:
    """How far the covariance of the whitened vectors is from the identity, from one more pass over them."""
    if not len(model.components):
        return 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            made = model.whitened(matrix(batch.column("x"), np.float64)) if batch.num_rows else np.zeros((0, 0))
            yield pa.RecordBatch.from_pydict({"x": pa.array(list(made), pa.list_(pa.float64()))})

    whitened = distinct.mapInArrow(run, "x array<double>")
    n, sums = _sums(whitened, "double")
    covariance = _scatter(whitened, sums / n) / n
    return float(np.abs(covariance - np.eye(len(sums))).max())


def whiten(vectors: DataFrame, model: Whitening | None, key: str = "vec_id", column: str = "embedding", scale: int = SCALE) -> DataFrame:
    """``key, deviation, whitened`` of every whole vector; ``whitened`` has an entry for each component of the model."""
    kind = vectors.schema[key].dataType.simpleString()
    schema = f"key {kind}, deviation long, whitened array<double>"
    if model is None:
        return vectors.sparkSession.createDataFrame([], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            if batch.num_rows:
                x = matrix(batch.column("x"), np.int64)
                made = [
                    batch.column("key"),
                    pa.array(model.deviations(x), pa.int64()),
                    pa.array(list(model.whitened(x)), pa.list_(pa.float64())),
                ]
                yield pa.RecordBatch.from_arrays(made, names=["key", "deviation", "whitened"])

    return on_grid(vectors, key, column, len(model.sums), scale).mapInArrow(run, schema)
