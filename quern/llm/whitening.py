"""Embedding whitening: Welford updates in partitions, merged in parallel, then symmetric QR.

1. Every task keeps a count, a mean and the centred products of the distinct
   vectors it reads, updated by one rank-one term a vector (Welford): d = x - mean,
   mean += d / n, products += d (x - mean)^T. Exact integer sums go beside them.
2. The tasks' states are merged by the parallel update formula, ``FAN`` at a time by
   Spark tasks, until at most ``FAN`` are left for the driver: what it receives is
   bounded by the squared dimension, whatever the rows.
3. The covariance (products over n) is brought to tridiagonal form by Householder
   reflections and solved by implicit QR steps with Wilkinson's shift.
4. A second pass whitens the distinct vectors and takes their covariance the same way,
   which gives the distance to the identity; a third whitens all rows.

Distinct vectors come from a native aggregate with partial combining, so a vector
that a third of all rows have is one row a task before anything is shuffled.

Defined cases: rows whose vector is null, has null or non-finite components, or has
another dimension than most are dropped; repeated vectors count once in the fit and
are all whitened; repeated or null ids are rows like others; components number
the dimension at most; a component without variance (below the rounding of the
largest eigenvalue; all of them if there is one distinct vector) gives 0 and has no
share in the distance to the identity, which is 0 if all are such; equal eigenvalues keep
the order in which the solver found them; signs are such that the largest entry of a component is positive; a
deviation that does not fit 64 bits is null; an empty table gives an empty
result; other columns are ignored. A scaled component beyond 2^40 stops the query.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern import storage
from quern.llm import vectors

SCALE = 256
LARGEST = 1 << 40
COMPONENTS = 4
FAN = 16  # states merged in one go

STATE = "part int, n long, mean array<double>, products array<double>, sums array<long>"


class Moments:
    """Count, mean, centred products and exact sums of the vectors seen."""

    def __init__(self, d: int):
        self.n, self.mean, self.products, self.sums = 0, np.zeros(d), np.zeros((d, d)), np.zeros(d, np.int64)
        self._term = np.empty((d, d))

    def add(self, x: np.ndarray) -> None:
        """One vector: a rank-one update."""
        self.n += 1
        before = x - self.mean
        self.mean += before / self.n
        np.multiply.outer(before, x - self.mean, out=self._term)
        self.products += self._term

    def merge(self, n: int, mean: np.ndarray, products: np.ndarray, sums: np.ndarray) -> None:
        """Another state: the parallel update."""
        if not n:
            return
        both, apart = self.n + n, mean - self.mean
        self.products += products + np.multiply.outer(apart, apart) * (self.n * n / both)
        self.mean += apart * (n / both)
        self.n, self.sums = both, self.sums + sums

    def row(self, part: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([part], pa.int32()), pa.array([self.n]), *[pa.array([list(v)]) for v in (self.mean, self.products.ravel())], pa.array([self.sums.tolist()], pa.list_(pa.int64()))],
            names=["part", "n", "mean", "products", "sums"],
        )


def moments(rows: DataFrame, d: int, change=None) -> Moments:
    """Moments of the vectors ``x`` of ``rows``, or of ``change`` of a matrix of them (``d`` columns then)."""

    def one(batches):
        from pyspark import TaskContext

        state = Moments(d)
        for b in vectors.nonempty(batches):
            x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            if change is None:
                state.sums += x.astype(np.int64).sum(0)
            for v in change(x) if change else x.astype(float):
                state.add(v)
        if state.n:
            yield state.row(TaskContext.get().partitionId())

    def together(states) -> Moments:
        out = Moments(d)
        for s in sorted(states, key=lambda s: s["part"]):
            out.merge(s["n"], np.array(s["mean"]), np.array(s["products"]).reshape(d, d), np.array(s["sums"], np.int64))
        return out

    def several(batches):
        from pyspark import TaskContext

        if states := [s for b in batches for s in b.to_pylist()]:  # about FAN of them
            yield together(states).row(TaskContext.get().partitionId())

    spark = rows.sparkSession
    states = storage.stage(spark, rows.select("x").mapInArrow(one, STATE), "moments")
    while (k := states.count()) > FAN:
        dealt = states.repartitionByRange(-(-k // FAN), "part")
        states = storage.stage(spark, dealt.mapInArrow(several, STATE), "moments")
    return together([r.asDict() for r in states.collect()])


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, off-diagonal and basis of the symmetric ``a``, by Householder reflections."""
    a, d = a.copy(), len(a)
    basis = np.eye(d)
    for k in range(d - 2):
        v = a[k + 1 :, k].copy()
        length = np.sqrt(v @ v)
        if length == 0 or not v[1:].any():
            continue
        v[0] += np.copysign(length, v[0])
        v /= np.sqrt(v @ v)
        part = a[k + 1 :, k:]
        part -= 2 * np.multiply.outer(v, v @ part)
        part = a[k:, k + 1 :]
        part -= 2 * np.multiply.outer(part @ v, v)
        part = basis[:, k + 1 :]
        part -= 2 * np.multiply.outer(part @ v, v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), basis


def symmetric_qr(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of the symmetric ``a``."""
    diag, off, basis = tridiagonal((a + a.T) / 2)
    turned = np.ascontiguousarray(basis.T)
    eps, hi, steps = np.finfo(float).eps, len(diag) - 1, 0
    while hi > 0:
        small = np.abs(off[:hi]) <= eps * (np.abs(diag[:hi]) + np.abs(diag[1 : hi + 1]))
        off[:hi][small] = 0
        if off[hi - 1] == 0:
            hi, steps = hi - 1, 0
            continue
        zeros = np.flatnonzero(off[:hi] == 0)
        lo = zeros[-1] + 1 if len(zeros) else 0
        steps += 1
        if steps > 100:
            raise ArithmeticError("the eigenvalues don't converge")
        half, last = (diag[hi - 1] - diag[hi]) / 2, off[hi - 1]
        shift = diag[hi] - last * last / (half + np.copysign(np.hypot(half, last), half))
        x, z = diag[lo] - shift, off[lo]
        for k in range(lo, hi):  # the bulge goes down
            r = np.hypot(x, z)
            c, s = (x / r, z / r) if r else (1.0, 0.0)
            if k > lo:
                off[k - 1] = r
            p, q, e = diag[k], diag[k + 1], off[k]
            diag[k], diag[k + 1] = c * c * p + 2 * c * s * e + s * s * q, s * s * p - 2 * c * s * e + c * c * q
            off[k] = c * s * (q - p) + (c * c - s * s) * e
            turned[k], turned[k + 1] = c * turned[k] + s * turned[k + 1], c * turned[k + 1] - s * turned[k]
            if k < hi - 1:
                x, z = off[k], s * off[k + 1]
                off[k + 1] *= c
    order = np.argsort(-diag, kind="stable")
    return diag[order], turned[order].T


@dataclass(frozen=True)
class Whitener:
    n: int
    sums: np.ndarray
    values: np.ndarray  # of the components, falling
    components: np.ndarray  # columns
    trace: float
    varied: np.ndarray  # whether a component has variance

    def apply(self, x: np.ndarray) -> np.ndarray:
        """Rows of integer vectors, whitened: a column a component."""
        scale = np.where(self.varied, 1 / np.sqrt(np.where(self.varied, self.values, 1)), 0)
        return ((x - self.sums / self.n) @ self.components) * scale

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Exact sums of (n x - sums)^2, in 64 bits where they are known to fit."""
        most = self.n * int(np.abs(x).max(initial=0)) + int(np.abs(self.sums).max())
        kind = np.int64 if most * most * x.shape[1] < 1 << 63 else object
        apart = self.n * x.astype(kind) - self.sums.astype(kind)
        return [int(v) if v < 1 << 63 else None for v in (apart * apart).sum(1)]


def fit(rows: DataFrame, d: int, components: int = COMPONENTS) -> tuple[Whitener | None, float]:
    """The whitening of the distinct vectors of ``rows`` and its distance to the identity; None without rows."""
    fit_list = storage.stage(rows.sparkSession, rows.select("x").distinct(), "fit_list")
    seen = moments(fit_list, d)
    if not seen.n:
        return None, 0.0
    values, basis = symmetric_qr(seen.products / seen.n)
    basis = basis * np.where(basis[np.abs(basis).argmax(0), np.arange(d)] < 0, -1.0, 1.0)
    k = min(components, d)
    varied = values[:k] > d * np.finfo(float).eps * max(values[0], 0)
    model = Whitener(seen.n, seen.sums, np.maximum(values[:k], 0), np.ascontiguousarray(basis[:, :k]), float(np.trace(seen.products)) / seen.n, varied)
    white = moments(fit_list, k, model.apply)
    apart = np.abs(white.products / white.n - np.eye(k))[np.ix_(varied, varied)]
    return model, float(apart.max(initial=0.0))


def whiten(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """A row per usable row and component: ``vec_id``, ``component`` (from 1), ``n``, ``deviation``, ``whitened``,
    ``explained`` and ``identity_error``."""
    rows, d = vectors.scaled(table, {"vec_id": id_col}, vec_col, SCALE, LARGEST)
    model, error = fit(rows, d, components) if d else (None, 0.0)
    kind = rows.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"

    def whole(batches):
        k = len(model.values)
        share = model.values / model.trace if model.trace else model.values * 0
        for b in vectors.nonempty(batches):
            x = vectors.matrix(b, d)
            m = b.num_rows
            again = np.repeat(np.arange(m), k)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("vec_id").take(pa.array(again)),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, model.n)),
                    pa.array(model.deviations(x), pa.int64()).take(pa.array(again)),
                    pa.array(model.apply(x).ravel()),
                    pa.array(np.tile(share, m)),
                    pa.array(np.full(m * k, error)),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    if model is None:
        return rows.sparkSession.createDataFrame([], schema)
    return rows.mapInArrow(whole, schema)


def op13_whitening(spark, sf_dir: str) -> DataFrame:
    """All usable rows of ``embeddings``, whitened along four components."""
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
