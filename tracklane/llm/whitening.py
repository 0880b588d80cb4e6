"""Embedding whitening: pivoted Cholesky of the centred scatter, one-sided Jacobi on its factor.

Entries become integers ``floor(256 c)``. The fit list holds each integer vector once,
however many rows repeat it. Two passes over it give, exactly, the sums per dimension and the
scatter: the whole part of each mean is taken off before multiplying, what is left of
the mean (below 1) is corrected in integers. So the covariance does not depend on the order
of rows or tasks. Each task sends one row per pair of dimensions, which Spark adds up;
the driver gets the ``d (d + 1) / 2`` totals and nothing that follows the rows.

On the driver the covariance ``V`` is factored as ``L L'`` with diagonal pivoting, which stops
at the numerical rank. Rotations of pairs of columns of ``L`` from the right make
them orthogonal; squared column norms are then the eigenvalues of ``V`` and the columns,
scaled to length 1 with the pivoting undone, its eigenvectors. Pairs that share no
column are rotated together. Nothing of ``V``'s condition is lost by forming ``L' L``.

Entries above 2^40 in size after centring are added up as doubles instead of integers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklane.llm.common import Scratch, ship, table

SCALE = 256
COMPONENTS = 4
BLOCK = 1 << 12  # rows multiplied at once
EXACT = 1 << 40  # centred entries up to here are summed as integers
SWEEPS = 60


def quantized(df: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, x): rows whose vector is whole, as integers.

    A null vector, one without entries, and one with a null or non-finite entry are dropped. Beyond the
    range of a long ``x`` takes its end. Of vectors of different lengths those of the most
    frequent length stay (the longest of equally frequent ones).
    """
    c = F.col(vector).cast("array<double>")
    whole = F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = df.select(F.col(key).alias("key"), c.alias("c")).filter(F.col("c").isNotNull() & (F.size("c") > 0) & whole.isNotNull() & whole)
    rows = rows.select("key", F.transform("c", lambda v: F.floor(v * SCALE)).alias("x"))
    length = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    return rows.filter(F.size("x") == (length[0]["d"] if length else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for batch in batches:
        for a in range(0, batch.num_rows, BLOCK):
            yield _matrix(batch.slice(a, BLOCK)["x"])


def _less(x: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """``x - whole`` as doubles, exact unless the difference leaves the range of a long."""
    wide = x.astype(np.float64) - whole
    return np.where(np.abs(wide) < 2.0**62, (x - whole).astype(np.float64), wide)


def column_sums(vectors: DataFrame) -> tuple[int, list[int], int]:
    """Number of vectors, exact sum per dimension, and largest distance of an entry from 0."""

    def sums(batches):
        n, high, low, most = 0, 0, 0, 0
        for x in _blocks(batches):
            n += len(x)
            high, low = high + (x >> 32).sum(axis=0), low + (x & 0xFFFFFFFF).sum(axis=0)
            most = np.maximum(most, np.abs(x.astype(np.float64)).max(axis=0))
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(high))), pa.array(np.full(len(high), n)), pa.array(high), pa.array(low), pa.array(most)],
                ["i", "n", "high", "low", "most"],
            )

    wide = lambda c: F.sum(F.col(c).cast("decimal(20,0)")).alias(c)
    rows = vectors.mapInArrow(sums, "i long, n long, high long, low long, most double").groupBy("i").agg(
        F.sum("n").alias("n"), wide("high"), wide("low"), F.max("most").alias("most")
    )
    rows = sorted(rows.collect(), key=lambda r: r["i"])  # one row per dimension
    if not rows:
        return 0, [], 0
    return rows[0]["n"], [(int(r["high"]) << 32) + int(r["low"]) for r in rows], int(max(r["most"] for r in rows))


@dataclass
class Whitening:
    """What the fit list gives; ``values`` and ``components`` hold at most ``COMPONENTS`` of them."""

    n: int
    whole: np.ndarray  # S // n
    rest: list[int]  # S % n
    values: np.ndarray
    components: np.ndarray  # a column each
    trace: float
    identity_error: float | None = None

    def projected(self, x: np.ndarray) -> np.ndarray:
        """Whitened coordinates of each row, NaN where the eigenvalue is 0."""
        offset = np.array([r / self.n for r in self.rest])
        centred = _less(x, self.whole) - offset
        with np.errstate(divide="ignore", invalid="ignore"):
            out = (centred @ self.components) / np.sqrt(self.values)
        out[:, self.values <= 0] = np.nan
        return out

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n x - S)^2 = (n (x - whole) - rest)^2; null beyond a long."""
        far = int(np.abs(_less(x, self.whole)).max(initial=0)) + 2
        if (self.n * far) ** 2 * x.shape[1] < 2**62:
            d = (x - self.whole) * self.n - np.array(self.rest, dtype=np.int64)
            return (d * d).sum(axis=1).tolist()
        exact = ((x.astype(object) - self.whole.astype(object)) * self.n - np.array(self.rest, dtype=object)) ** 2
        return [v if v < 2**63 else None for v in exact.sum(axis=1).tolist()]


def scatter(vectors: DataFrame, whole: np.ndarray, exact: bool) -> DataFrame:
    """(i, j, total): sums of products of the entries less ``whole``, for i <= j."""

    def products(batches):
        total = None
        for x in _blocks(batches):
            z = x - whole if exact else x.astype(np.float64) - whole
            most = float(np.abs(z).max(initial=0))
            if not exact or most * most * len(z) < 2**52:  # doubles hold every partial sum
                f = z.astype(np.float64)
                add = f.T @ f
            else:
                o = z.astype(object)
                add = o.T @ o
            add = np.array([[int(v) for v in row] for row in add], dtype=object) if exact else add
            total = add if total is None else total + add
        if total is not None:
            i, j = np.triu_indices(len(whole))
            sums = [str(v) for v in total[i, j]] if exact else total[i, j]
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(sums)], ["i", "j", "total"])

    kind = "string" if exact else "double"
    rows = vectors.mapInArrow(products, f"i long, j long, total {kind}")
    return rows.groupBy("i", "j").agg(F.sum(F.col("total").cast("decimal(38,0)" if exact else "double")).alias("total"))


def covariance(vectors: DataFrame) -> tuple[int, np.ndarray, list[int], np.ndarray]:
    """Number of vectors, whole and remaining part of ``S / n``, and the covariance."""
    n, sums, most = column_sums(vectors)
    whole = np.array([s // n for s in sums], dtype=np.int64) if n else np.zeros(0, np.int64)
    rest = [s % n for s in sums]
    exact = 2 * most < EXACT
    out = np.zeros((len(sums), len(sums)))
    for r in scatter(vectors, whole, exact).collect() if n else ():  # one row per pair of dimensions
        i, j = r["i"], r["j"]
        if exact:
            out[i, j] = out[j, i] = (n * int(r["total"]) - rest[i] * rest[j]) / (n * n)
        else:
            out[i, j] = out[j, i] = r["total"] / n - (rest[i] / n) * (rest[j] / n)
    return n, whole, rest, out


def pivoted_cholesky(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(L, order) with ``a[order][:, order] = L L'``; L is lower trapezoidal, as wide as the rank."""
    a = a.copy()
    d = len(a)
    order, factor = np.arange(d), np.zeros((d, d))
    floor = d * np.finfo(float).eps * max(a.diagonal().max(initial=0.0), 0.0)
    left = a.diagonal().copy()
    for k in range(d):
        p = k + int(np.argmax(left[k:]))
        if left[p] <= floor:
            return factor[:, :k], order
        for rows in (order, left):
            rows[[k, p]] = rows[[p, k]]
        factor[[k, p]] = factor[[p, k]]
        a[[k, p]] = a[[p, k]]
        a[:, [k, p]] = a[:, [p, k]]
        factor[k, k] = np.sqrt(left[k])
        factor[k + 1 :, k] = (a[k + 1 :, k] - factor[k + 1 :, :k] @ factor[k, :k]) / factor[k, k]
        left[k + 1 :] -= factor[k + 1 :, k] ** 2
    return factor, order


def _rounds(m: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Every pair of ``m`` columns once, in rounds of pairs that share none."""
    ring = list(range(m + m % 2))
    for _ in range(len(ring) - 1):
        pairs = [(ring[k], ring[-1 - k]) for k in range(len(ring) // 2)]
        pairs = [(min(p), max(p)) for p in pairs if max(p) < m]
        yield np.array([p[0] for p in pairs], dtype=int), np.array([p[1] for p in pairs], dtype=int)
        ring = [ring[0], ring[-1], *ring[1:-1]]


def one_sided_jacobi(factor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of ``L L'``, falling, and unit eigenvectors: rotated columns of L, their squared norms."""
    g = factor.copy()
    enough = 4 * np.finfo(float).eps
    for _ in range(SWEEPS):
        turned = False
        for p, q in _rounds(g.shape[1]):
            a, b = g[:, p], g[:, q]
            aa, bb, ab = (a * a).sum(axis=0), (b * b).sum(axis=0), (a * b).sum(axis=0)
            act = np.abs(ab) > enough * np.sqrt(aa * bb)
            if not act.any():
                continue
            turned = True
            with np.errstate(divide="ignore", over="ignore"):
                zeta = np.where(act, (bb - aa) / np.where(act, 2 * ab, 1), 0)
                t = np.where(zeta < 0, -1.0, 1.0) / (np.abs(zeta) + np.hypot(1, zeta))
            t = np.where(act, t, 0)
            c = 1 / np.hypot(1, t)
            s = c * t
            g[:, p], g[:, q] = c * a - s * b, s * a + c * b
        if not turned:
            break
    values = (g * g).sum(axis=0)
    order = np.argsort(-values, kind="stable")
    return values[order], g[:, order] / np.sqrt(values[order])


def fit(vectors: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of a table of distinct integer vectors ``x``; None without rows."""
    n, whole, rest, v = covariance(vectors)
    if not n:
        return None
    factor, order = pivoted_cholesky(v)
    values, unit = one_sided_jacobi(factor)
    k = min(components, len(v))
    e, u = np.zeros(k), np.zeros((len(v), k))
    have = min(k, len(values))
    e[:have] = values[:have]
    u[order, :have] = unit[:, :have]
    u *= np.where(u[np.abs(u).argmax(axis=0), np.arange(k)] < 0, -1.0, 1.0)
    out = Whitening(n, whole, rest, e, u, float(np.trace(v)))
    out.identity_error = _identity_error(vectors, out)
    return out


def _identity_error(vectors: DataFrame, model: Whitening) -> float | None:
    """Largest entry of the whitened fit list's covariance less the identity, measured on its rows."""
    k = int((model.values > 0).sum())

    def moments(batches):
        total = np.zeros((k + 1, k + 1))
        for x in _blocks(batches):
            w = np.hstack([np.ones((len(x), 1)), model.projected(x)[:, :k]])
            total += w.T @ w
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel()), pa.array(j.ravel()), pa.array(total.ravel())], ["i", "j", "total"])

    if not k:
        return None
    second = np.zeros((k + 1, k + 1))
    for r in vectors.mapInArrow(moments, "i long, j long, total double").groupBy("i", "j").agg(F.sum("total").alias("t")).collect():
        second[r["i"], r["j"]] = r["t"] / model.n
    return float(np.abs(second[1:, 1:] - np.outer(second[0, 1:], second[0, 1:]) - np.eye(k)).max())


def whiten(df: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per kept row of ``df`` and component: whitened coordinate, its share of the variance.

    Rows that repeat key or vector each get their own rows; a null key stays null. There
    are ``min(components, dimensions)`` components; one whose eigenvalue is 0 (fewer different
    directions than that, or a single vector) has ``whitened`` null and ``explained`` 0, or null where
    all vectors are equal; ``identity_error`` is over the others. ``deviation`` is null where it exceeds a long.
    Other columns of ``df`` are not looked at. Without rows the result is empty.
    """
    spark = df.sparkSession
    ship(spark)
    rows = quantized(df, key, vector)
    model = fit(Scratch(spark, "whitening").store(rows.select("x").distinct()), components)
    kind = dict(df.dtypes)[key]
    schema = f"key {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None:
        return spark.createDataFrame([], schema).withColumnRenamed("key", key)
    k = len(model.values)
    share = pa.array([float(v) / model.trace if model.trace > 0 else None for v in model.values], pa.float64())

    def coordinates(batches):
        for whole_batch in batches:
            for a in range(0, whole_batch.num_rows, BLOCK):
                batch = whole_batch.slice(a, BLOCK)
                x, m = _matrix(batch["x"]), batch.num_rows
                each = np.repeat(np.arange(m), k)
                flat = model.projected(x).ravel()
                yield pa.RecordBatch.from_arrays(
                    [
                        batch["key"].take(pa.array(each)),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                        pa.array(np.full(m * k, model.n)),
                        pa.array(model.deviations(x), pa.int64()).take(pa.array(each)),
                        pa.array(flat, mask=np.isnan(flat)),
                        share.take(pa.array(np.tile(np.arange(k), m))),
                        pa.array([model.identity_error] * (m * k), pa.float64()),
                    ],
                    ["key", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.mapInArrow(coordinates, schema).withColumnRenamed("key", key)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


QUERIES = {"op12_whitening": op12_whitening}

SQL: dict[str, str] = {}
