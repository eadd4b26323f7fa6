"""Embedding whitening: moments by Welford's rank-one updates, merged across partitions, and a symmetric QR eigen-solve."""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmix.llm.common import stored, table
from trailmix.llm.vectors import usable

NAME = "op13_embedding_whitening"
STATE = "n long, sums array<decimal(38,0)>, mean array<double>, scatter binary"
FAN_IN = 16


class Moments:
    """Count, exact sums where entries are whole, mean and scatter about the mean (sum of outer products of deviations)."""

    def __init__(self, n: int, sums: list[int], mean: np.ndarray, scatter: np.ndarray):
        self.n, self.sums, self.mean, self.scatter = n, sums, mean, scatter

    @classmethod
    def empty(cls, width: int) -> Moments:
        return cls(0, [0] * width, np.zeros(width), np.zeros((width, width)))

    def add(self, rows: np.ndarray) -> None:
        """Welford's update, a row at a time: the deviation from the old mean times that from the new one is of rank one."""
        term = np.empty_like(self.scatter)
        for row in rows.astype(np.float64):
            self.n += 1
            delta = row - self.mean
            self.mean += delta / self.n
            # delta * (row - new mean) is delta * delta * (n - 1) / n: symmetric, whatever the rounding
            np.multiply.outer(delta, delta, out=term)
            term *= (self.n - 1) / self.n
            self.scatter += term
        if rows.dtype.kind == "i":
            self.sums = [a + sum(b) for a, b in zip(self.sums, rows.T.tolist(), strict=True)]

    def merge(self, other: Moments) -> None:
        """The parallel form: scatters add up, and so does the outer product of the means' difference, by its weight."""
        n = self.n + other.n
        if not other.n:
            return
        delta = other.mean - self.mean
        self.scatter = self.scatter + other.scatter + np.multiply.outer(delta, delta) * (self.n * other.n / n)
        self.mean = self.mean + delta * (other.n / n)
        self.sums = [a + b for a, b in zip(self.sums, other.sums, strict=True)]
        self.n = n

    def row(self) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.list_(pa.decimal128(38, 0)), pa.list_(pa.float64()), pa.binary())
        values = (self.n, [Decimal(s) for s in self.sums], self.mean.tolist(), self.scatter.astype("<f8").tobytes())
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=["n", "sums", "mean", "scatter"])

    @classmethod
    def read(cls, n: int, sums: list[Decimal], mean: list[float], scatter: bytes) -> Moments:
        width = len(mean)
        return cls(n, [int(s) for s in sums], np.array(mean), np.frombuffer(scatter, "<f8").reshape(width, width).copy())


def matrix_of(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def moments(vectors: DataFrame, width: int) -> Moments:
    """The moments of column ``x`` over all rows: one state a partition, states merged sixteen at a time until few are left for the driver."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = Moments.empty(width)
        for batch in batches:
            state.add(matrix_of(batch.column(0), width))
        yield state.row()

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = Moments.empty(width)
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                state.merge(Moments.read(*row))
        yield state.row()

    states = stored(vectors.select("x").mapInArrow(gather, STATE), "whitening-moments")
    n = states.count()
    while n > FAN_IN:
        n = -(-n // FAN_IN)
        states = stored(states.repartition(n).mapInArrow(join, STATE), "whitening-moments")
    whole = Moments.empty(width)
    for r in sorted(states.collect(), key=lambda r: (r["n"], r["mean"])):
        whole.merge(Moments.read(*r))
    return whole


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Householder reflections: diagonal, subdiagonal and the orthogonal Q with a = Q T Q'."""
    a, n = a.astype(np.float64).copy(), len(a)
    q = np.eye(n)
    for k in range(n - 2):
        x = a[k + 1 :, k].copy()
        size = np.linalg.norm(x)
        if size == 0.0:
            continue
        x[0] += math.copysign(size, x[0])
        v = x / np.linalg.norm(x)
        a[k + 1 :, k:] -= 2 * np.outer(v, v @ a[k + 1 :, k:])
        a[:, k + 1 :] -= 2 * np.outer(a[:, k + 1 :] @ v, v)
        q[:, k + 1 :] -= 2 * np.outer(q[:, k + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), q


def symmetric_qr(a: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns: implicit QR steps with Wilkinson's shift on the tridiagonal form."""
    d, e, q = tridiagonal(a)
    small = np.finfo(float).eps
    hi = len(d) - 1
    steps = 0
    while hi > 0:
        e[:hi][np.abs(e[:hi]) <= small * (np.abs(d[:hi]) + np.abs(d[1 : hi + 1]))] = 0.0
        if e[hi - 1] == 0.0:
            hi -= 1
            continue
        zero = np.flatnonzero(e[:hi] == 0.0)
        lo = int(zero[-1]) + 1 if len(zero) else 0
        steps += 1
        if steps > sweeps * len(d):
            raise ArithmeticError("the QR steps did not converge")
        half = (d[hi - 1] - d[hi]) / 2
        square = e[hi - 1] * e[hi - 1]
        x = d[lo] - (d[hi] - square / (half + math.copysign(math.hypot(half, e[hi - 1]), half)))
        z = e[lo]
        for k in range(lo, hi):
            r = math.hypot(x, z)
            c, s = (1.0, 0.0) if r == 0.0 else (x / r, z / r)
            if k > lo:
                e[k - 1] = r
            a0, b0, c0 = d[k], e[k], d[k + 1]
            d[k] = c * c * a0 + 2 * c * s * b0 + s * s * c0
            d[k + 1] = s * s * a0 - 2 * c * s * b0 + c * c * c0
            e[k] = (c * c - s * s) * b0 + c * s * (c0 - a0)
            x = e[k]
            if k < hi - 1:
                z = s * e[k + 1]
                e[k + 1] *= c
            left, right = q[:, k].copy(), q[:, k + 1].copy()
            q[:, k], q[:, k + 1] = c * left + s * right, c * right - s * left
    order = np.argsort(-d, kind="stable")
    return d[order], q[:, order] / np.linalg.norm(q[:, order], axis=0)


def whitened(rows: DataFrame, components: int = 4, scale: float = 256.0, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of each row that has a vector, for the first components.

    Entries become floor(scale * x). Mean, covariance V and its eigenvectors come from each distinct vector once: duplicates go
    in one aggregation, which Spark starts before its shuffle, tasks run Welford's updates over what is left, and
    their states are merged; sums are exact. ``identity_error`` is measured by the same updates over the whitened distinct vectors.

    Rows whose vector is null, empty, or holds null or non-finite entries (also after scaling) are dropped, and so are those of another
    width than most rows have (of equals, the widest). A component without variance has null ``whitened`` and no part in
    ``identity_error``; ``explained`` is null if nothing varies. A deviation beyond a long is null. Repeated rows and null ids are
    kept, each with its own rows; an empty table gives none. Extra columns are left out.
    """
    spark = rows.sparkSession
    whole = F.transform(F.col("v"), lambda c: F.floor(c.cast("double") * scale).cast("long"))
    usable_rows = rows.select(F.col(key).alias("vec_id"), F.col(vector).alias("v")).where(usable("v", scale) & (F.size("v") > 0))
    kept = stored(usable_rows.select("vec_id", whole.alias("x")), "whitening-rows")
    widths = kept.groupBy(F.size("x").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    out = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if widths is None:
        return spark.createDataFrame([], out)
    width = widths["width"]
    kept = kept.where(F.size("x") == width)
    fit = stored(kept.select("x").distinct(), "whitening-fit")

    found = moments(fit, width)
    values, axes = symmetric_qr(found.scatter / found.n)
    trace = float(np.trace(found.scatter)) / found.n
    count = min(components, width)
    real = values[:count] > 1e-12 * max(trace, 1e-300)
    spread = np.sqrt(np.where(real, values[:count], 1.0))
    n, sums = found.n, found.sums
    ratio = [divmod(s, n) for s in sums]  # S / n as whole part and rest, so that x - S / n keeps its digits
    floor_part, rest = np.array([float(a) for a, _ in ratio]), np.array([b / n for _, b in ratio])
    axes = axes[:, :count]

    def project(x: np.ndarray) -> np.ndarray:
        return ((x - floor_part) - rest) @ axes / spread

    def shown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(list(project(matrix_of(batch.column(0), width))[:, real]), pa.list_(pa.float64()))], names=["x"])

    error = None
    if real.any():
        again = moments(fit.mapInArrow(shown, "x array<double>"), int(real.sum()))
        error = float(np.abs(again.scatter / again.n - np.eye(int(real.sum()))).max())
    explained = [float(v) / trace if trace > 0 else None for v in values[:count]]
    most = max((abs(s) for s in sums), default=0)

    def deviations(x: np.ndarray) -> list[int | None]:
        if width * (n * int(np.abs(x.astype(object)).max(initial=0)) + most) ** 2 < 2**63:
            return (((n * x - np.array(sums, np.int64)) ** 2).sum(axis=1)).tolist()
        exact = [sum((n * a - s) ** 2 for a, s in zip(row, sums, strict=True)) for row in x.tolist()]
        return [v if v < 2**63 else None for v in exact]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix_of(batch.column(1), width)
            m = len(x)
            white = project(x)
            line = np.repeat(np.arange(m), count)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(line)),
                pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), m)),
                pa.array(np.full(m * count, n, np.int64)),
                pa.array(deviations(x), pa.int64()).take(pa.array(line)),
                pa.array(white.ravel(), mask=np.tile(~real, m)),
                pa.array(explained * m, pa.float64()),
                pa.array([error] * (m * count), pa.float64()),
            ], names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), "x").mapInArrow(run, out)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(table(spark, sf_dir, "embeddings"))


ORACLE = None
