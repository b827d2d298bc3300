"""Operator 13: embedding whitening.

Vectors become whole numbers on a grid. Each partition computes the count, the
mean and the scatter about that mean of its own rows, batch by batch; two such
states merge by Chan's formula, first within the partition and then pairwise in
treeReduce, so nothing but states of dims x dims doubles travels, and the driver
gets one. It takes eigenvectors of the covariance; a second pass over all rows
merges the covariance of the whitened vectors in the same way and measures how
far it is from the identity.

Values lie at a million and vary by tens: scatter is summed about local means,
never from raw squares, whose digits would be lost. Sums per dimension are
Python integers, so that differences from means and between means are rounded
once, and deviations are exact, whatever the number of rows.

Defined cases: a row whose vector is null, or holds a null or non-finite entry,
or one too large for a long on the grid, is dropped; so is one whose number of
entries isn't the most frequent one (of equally frequent ones the largest), and
an empty one; repeated rows count each; null ids are ids; very long vectors are
used whole; a component of no variance (under 1e-12 of the first) has whitened
values of 0 and takes no part in the identity, whose error is then that of the
others; deviations beyond a long are null; an empty table, or one without any
row left, gives an empty result; other columns, whatever their names, are not
read.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

GRID, SHIFT = 64, 1_000_000
COMPONENTS = 32
#: Eigenvalues under this share of the first are no variance.
NO_VARIANCE = 1e-12
#: Rows whose scatter is computed at once.
AT_ONCE = 4096
LARGEST = float(2**62) / GRID


def apart(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - sums, exact: longs, or Python integers where longs might not hold it."""
    if max(max(abs(int(x.min())), abs(int(x.max()))) * n, max(map(abs, sums))) < 2**62:
        return x * n - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


@dataclass
class Moments:
    """Count, mean, scatter about the mean, and the exact sums where the rows are whole numbers."""

    n: int
    mean: np.ndarray
    scatter: np.ndarray
    sums: list[int]

    @classmethod
    def of(cls, rows: np.ndarray) -> Moments:
        n, sums = len(rows), []
        if rows.dtype.kind == "i":
            fits = n * max(abs(int(rows.min())), abs(int(rows.max()))) < 2**63
            sums = rows.sum(axis=0).tolist() if fits else [sum(map(int, c)) for c in rows.T]
            mean = np.array([x / n for x in sums])
            centred = (apart(rows, n, sums) / n).astype(np.float64)
        else:
            mean = rows.mean(axis=0)
            centred = rows - mean
        return cls(n, mean, centred.T @ centred, sums)

    def merged(self, other: Moments) -> Moments:
        n, m = self.n, other.n
        step = np.array([(b * n - a * m) / (n * m) for a, b in zip(self.sums, other.sums)]) if self.sums else other.mean - self.mean
        return Moments(n + m, self.mean + step * (m / (n + m)), self.scatter + other.scatter + np.outer(step, step) * (n * m / (n + m)), [a + b for a, b in zip(self.sums, other.sums)])


def on_grid(vectors: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of usable vectors, and their whole numbers."""
    vectors = vectors.cast(pa.list_(pa.float64())) if not pa.types.is_large_list(vectors.type) else vectors
    sizes = np.asarray(vectors.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False))
    at = np.flatnonzero(sizes == dims)
    flat = vectors.take(pa.array(at)).flatten()
    values = np.asarray(flat.to_numpy(zero_copy_only=False), np.float64).reshape(len(at), dims)  # nulls become nan
    fine = np.isfinite(values).all(axis=1) & (np.abs(values) < LARGEST).all(axis=1)
    return at[fine], np.floor(GRID * values[fine]).astype(np.int64) + SHIFT


def reduced(rows: DataFrame, dims: int, transform: Callable[[np.ndarray], np.ndarray] | None = None) -> Moments | None:
    """The moments of all usable vectors, or of what transform makes of them; None if there are none."""

    def partials(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for b in batches:
            _, x = on_grid(b.column(0), dims)
            for lo in range(0, len(x), AT_ONCE):
                part = x[lo : lo + AT_ONCE]
                own = Moments.of(part if transform is None else transform(part))
                state = own if state is None else state.merged(own)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(state)], pa.binary())], names=["state"])

    def merged(a: Moments | None, b: Moments | None) -> Moments | None:
        return a.merged(b) if a and b else a or b

    states = rows.select("embedding").mapInArrow(partials, "state binary").rdd.map(lambda r: pickle.loads(r.state))  # a row for each partition
    return states.treeReduce(merged, depth=3) if states.getNumPartitions() else None


@dataclass
class Whitening:
    n: int
    sums: list[int]
    axes: np.ndarray
    values: np.ndarray
    explained: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        centred = (apart(x, self.n, self.sums) / self.n).astype(np.float64)
        return np.where(self.values > 0, (centred @ self.axes) / np.sqrt(np.where(self.values > 0, self.values, 1.0)), 0.0)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """The sum over dimensions of (n * x - S) squared; None beyond a long."""
        d = apart(x, self.n, self.sums)
        if d.dtype != object and int(np.abs(d).max()) ** 2 * x.shape[1] < 2**63:
            return (d * d).sum(axis=1).tolist()
        exact = [sum(int(v) ** 2 for v in row) for row in d]
        return [v if v < 2**63 else None for v in exact]


def dimensions(vectors: DataFrame) -> int:
    """The most frequent number of entries of non-null vectors, the largest of equals; 0 if there are none."""
    sizes = vectors.where(F.size("embedding") > 0).groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n"))
    best = sizes.agg(F.max(F.struct("n", "d"))).first()[0]
    return best.d if best else 0


def fitted(vectors: DataFrame, components: int = COMPONENTS) -> tuple[Whitening, float] | None:
    """The whitening of all usable rows of vectors (embedding), and the error of the identity; None without such rows."""
    dims = dimensions(vectors)
    moments = reduced(vectors, dims) if dims else None
    if moments is None:
        return None
    covariance = moments.scatter / moments.n
    values, axes = np.linalg.eigh((covariance + covariance.T) / 2)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    total = float(np.trace(covariance))
    values = np.where(values > NO_VARIANCE * max(float(values[0]), 0.0), values, 0.0) if total > 0 else np.zeros(len(values))
    whitening = Whitening(moments.n, moments.sums, np.ascontiguousarray(axes), values, values / total if total > 0 else np.zeros(len(values)))
    again = reduced(vectors, dims, whitening)
    own = np.flatnonzero(values > 0)
    error = np.abs((again.scatter / again.n)[np.ix_(own, own)] - np.eye(len(own))).max() if len(own) else 0.0
    return whitening, float(error)


WHITENED = "vec_id {0}, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whitened(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """A row for each usable row of vectors (vec_id, embedding) and component."""
    schema = WHITENED.format(vectors.schema["vec_id"].dataType.simpleString())
    fit = fitted(vectors, components)
    if fit is None:
        return vectors.sparkSession.createDataFrame([], schema)
    whitening, error = fit
    dims, k = len(whitening.sums), len(whitening.values)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            at, x = on_grid(b.column(1), dims)
            for lo in range(0, len(x), AT_ONCE):
                part = x[lo : lo + AT_ONCE]
                m = len(part)
                ids = b.column(0).take(pa.array(np.repeat(at[lo : lo + m], k)))
                deviation = pa.array(whitening.deviations(part), pa.int64()).take(pa.array(np.repeat(np.arange(m), k)))
                columns = [np.tile(np.arange(1, k + 1, dtype=np.int32), m), np.full(m * k, whitening.n), deviation, whitening(part).ravel(), np.tile(whitening.explained, m), np.full(m * k, error)]
                yield pa.RecordBatch.from_arrays([ids, *[c if isinstance(c, pa.Array) else pa.array(c) for c in columns]], names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return vectors.select("vec_id", "embedding").mapInArrow(batches, schema)


def op13_chan_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(table(spark, sf_dir, "embeddings"))
