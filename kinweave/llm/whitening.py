"""Whitening of embeddings: principal components of unit variance.

Vectors become whole numbers first, so that sums, and with them the mean, are exact. A second
pass adds up outer products of centred vectors, a matrix product for each batch; both passes
are merged by ``treeAggregate``, so the driver gets a few matrices of the vectors' length. It
finds the eigenvectors of their covariance, which are broadcast to project all vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from kinweave.workspace import Workspace

# How entries become whole numbers.
SCALE, SHIFT = 1024, 100_000
#: Entries of a block that are held as doubles at a time.
BLOCK = 1 << 20
#: Bytes of a matrix of the vectors' length that tasks send; longer vectors are refused.
MOST_MATRIX = 256 << 20
#: An eigenvalue below this share of the largest is rounding.
ROUNDING = 1e-12


def units(entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries as whole numbers, and which of them are no finite number that a long holds."""
    with np.errstate(all="ignore"):
        scaled = np.floor(entries.astype(np.float64) * SCALE)
        bad = ~(np.abs(scaled) < 2.0**62)
    return np.where(bad, 0, scaled).astype(np.int64) + SHIFT, bad


def _blocks(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows, x) for the whole vectors of a batch: by length, in blocks of bounded size."""
    vectors = batch.column(column)
    if not len(vectors):
        return
    entries = vectors.flatten()
    lengths = np.nan_to_num(vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)).astype(np.int64)
    starts = np.concatenate(([0], np.cumsum(lengths)))[:-1]
    known = entries.is_valid().to_numpy(zero_copy_only=False)
    x, bad = units(entries.fill_null(0).to_numpy(zero_copy_only=False))
    bad |= ~known
    faults = np.concatenate(([0], np.cumsum(bad)))
    whole = vectors.is_valid().to_numpy(zero_copy_only=False) & (lengths > 0) & (faults[starts + lengths] == faults[starts])
    for d in np.unique(lengths[whole]):
        rows = np.flatnonzero(whole & (lengths == d))
        for at in range(0, len(rows), max(1, BLOCK // int(d))):
            part = rows[at : at + max(1, BLOCK // int(d))]
            yield int(d), part, x[starts[part][:, None] + np.arange(d)]


def _exact_sum(x: np.ndarray) -> list[int]:
    """Column sums without overflow."""
    if float(np.abs(x).max()) * len(x) < 2.0**62:
        return x.sum(0).tolist()
    return x.astype(object).sum(0).tolist()


def _sums(column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, tuple[int, list[int]]] = {}
        for batch in batches:
            for d, rows, x in _blocks(batch, column):
                n, total = found.get(d, (0, [0] * d))
                found[d] = n + len(rows), [a + b for a, b in zip(total, _exact_sum(x))]
        for d, (n, total) in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([d]), pa.array([n]), pa.array([[str(t) for t in total]])], ["d", "n", "sums"])

    return run


def _products(column: str, d: int, mean: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))
        for batch in batches:
            for length, _, x in _blocks(batch, column):
                if length == d:
                    centred = x - mean
                    total += centred.T @ centred
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["m"])

    return run


def _merged(rows: DataFrame, d: int) -> np.ndarray:
    """The sum of the matrices ``m`` of all rows, merged as a tree."""
    add = lambda total, row: total + np.frombuffer(row.m).reshape(d, -1)
    return rows.rdd.treeAggregate(0.0, add, lambda a, b: a + b, depth=3)


def squared_deviation(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """For each row the sum of (n * x - sums) ** 2, exact; null if no long holds it."""
    about = ((float(n) * x - np.array(sums, float)) ** 2).sum(1)
    if float(np.abs(x).max(initial=0)) * n < 2.0**61 and max(map(abs, sums)) < 2**61 and about.max(initial=0) < 2.0**62:
        return ((n * x - np.array(sums, np.int64)) ** 2).sum(1).tolist()
    exact = ((x.astype(object) * n - np.array(sums, object)) ** 2).sum(1).tolist()
    return [v if v < 2**63 else None for v in exact]


@dataclass(frozen=True)
class Whitening:
    """The fit: what a vector's entries are shifted and multiplied by."""

    n: int
    sums: list[int]  # exact
    mean: np.ndarray
    values: np.ndarray  # eigenvalues of the covariance, falling
    components: np.ndarray  # unit eigenvectors, a column each
    trace: float

    @property
    def d(self) -> int:
        return len(self.sums)

    def projection(self, most: int) -> np.ndarray:
        """Columns that whiten; nothing but nan where a component has no variance."""
        values = self.values[:most]
        flat = values <= ROUNDING * max(self.values[0], 0.0)
        with np.errstate(all="ignore"):
            return self.components[:, :most] * np.where(flat, np.nan, 1 / np.sqrt(values))


def fit(vectors: DataFrame, column: str) -> Whitening | None:
    """Mean and principal components of all whole vectors, of one length; none without vectors."""
    sums = vectors.select(column).mapInArrow(_sums(column), "d long, n long, sums array<string>")
    merge = lambda a, b: {d: _added(a.get(d), b.get(d)) for d in {*a, *b}}
    one = lambda total, row: merge(total, {row.d: (row.n, [int(s) for s in row.sums])})
    found = sums.rdd.treeAggregate({}, one, merge, depth=3)
    if not found:
        return None
    d = max(found, key=lambda k: (found[k][0], k))
    if 8 * d * d > MOST_MATRIX:
        raise ValueError(f"a matrix for vectors of {d} entries is larger than {MOST_MATRIX} bytes")
    n, total = found[d]
    mean = np.array([s // n + (s % n) / n for s in total])
    products = _merged(vectors.select(column).mapInArrow(_products(column, d, mean), "m binary"), d)
    covariance = products / n
    values, components = np.linalg.eigh((covariance + covariance.T) / 2)
    return Whitening(n, total, mean, values[::-1], components[:, ::-1], float(np.trace(covariance)))


def _added(a, b):
    if a is None or b is None:
        return a or b
    return a[0] + b[0], [x + y for x, y in zip(a[1], b[1])]


def _projecting(column: str, shared, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted: Whitening = shared.value
        matrix = fitted.projection(most)
        for batch in batches:
            for length, rows, x in _blocks(batch, column):
                if length == fitted.d:
                    white = (x - fitted.mean) @ matrix
                    flat = pa.array(white.ravel(), pa.float64(), mask=np.isnan(white.ravel()))
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * matrix.shape[1]), flat)
                    ids = batch.column("_id").take(pa.array(rows))
                    yield pa.RecordBatch.from_arrays([ids, pa.array(squared_deviation(x, fitted.n, fitted.sums), pa.int64()), lists], ["_id", "deviation", "whitened"])

    return run


def _second_moments(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((most + 1, most))  # the last row is their sum
        for batch in batches:
            if batch.num_rows:
                white = batch.column("whitened").flatten().to_numpy(zero_copy_only=False).reshape(-1, most)
                total[:most] += white.T @ white
                total[most] += white.sum(0)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["m"])

    return run


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", most: int = 8) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error), a row for each component.

    ``vectors`` has arrays of numbers. An entry c counts as x = floor(SCALE * c) + SHIFT.
    Rows whose vector is null, empty, or holds a null, an entry that is not finite or one whose
    x no long holds, are left out; so are those of another length than most vectors have (the
    longer one in a tie). All others make the fit, repeated rows as often as they come, and
    come back, whatever their id. Covariances have the divisor n, the number of vectors.

    ``component`` counts from 1 by falling eigenvalue, up to ``most`` or the vectors' length;
    of equal eigenvalues the eigenvectors are any. ``deviation`` is the exact squared length of
    n * x - sums, null where no long holds it. ``explained`` is the eigenvalue's share of the
    trace, 0 if all vectors are equal. A component without variance has ``whitened`` null.
    ``identity_error`` is the largest difference between the covariance of ``whitened``, of
    components with variance, and the identity; 0 if there is none. Without vectors there are
    no rows.
    """
    spark = vectors.sparkSession
    id_type = vectors.schema[id_col].dataType.simpleString()
    rows = vectors.select(vectors[id_col].alias("_id"), vectors[vector_col].alias("_vector"))
    columns = f"{id_col} {id_type}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    fitted = fit(rows, "_vector")
    if fitted is None:
        return spark.createDataFrame([], columns)
    k = min(most, fitted.d)
    shared = spark.sparkContext.broadcast(fitted)
    projected = rows.mapInArrow(_projecting("_vector", shared, k), f"_id {id_type}, deviation long, whitened array<double>")
    projected = Workspace(spark, "whitening").table(projected, "projected")
    moments = _merged(projected.select("whitened").mapInArrow(_second_moments(k), "m binary"), k + 1)
    mean = moments[k] / fitted.n
    error = np.abs(moments[:k] / fitted.n - np.outer(mean, mean) - np.eye(k))
    error = float(np.nanmax(error)) if not np.isnan(error).all() else 0.0
    shares = [max(float(v), 0.0) / fitted.trace if fitted.trace > 0 else 0.0 for v in fitted.values[:k]]
    each = projected.select("_id", "deviation", F.posexplode("whitened").alias("_at", "whitened"))
    return each.select(
        F.col("_id").alias(id_col), (F.col("_at") + 1).cast("int").alias("component"), F.lit(fitted.n).cast("long").alias("n"), "deviation", "whitened",
        F.element_at(F.array(*map(F.lit, shares)), F.col("_at") + 1).alias("explained"), F.lit(error).alias("identity_error"),
    )


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
