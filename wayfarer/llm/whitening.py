"""Whitening of vectors: principal components by cyclic Jacobi rotations, then projection.

1. Entries become integers, ``floor(scale * c) + shift``, so that sums are exact.
2. Spark sums each dimension; a second pass centres every vector before it multiplies
   and gives one partial scatter matrix a task, which Spark sums entry by entry.
3. The driver, which holds one d x d matrix for each length of vectors, rotates it
   until no off-diagonal entry matters beside the two diagonal ones it lies between.
   Unlike a criterion on the whole matrix this keeps small eigenvalues accurate.
4. The whitening matrix (k x d numbers) goes to all tasks, which project every vector.
   The covariance of what comes out is measured in one more pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfarer.llm.common import staged

#: Vectors that a task multiplies at once.
BATCH = 1024
#: Entries beyond this have no integer of their own; their vectors are left out as those with infinite ones are.
LARGEST = float(2**40)
#: Components under this share of the largest eigenvalue are rounding, not variance.
LEAST = 1e-13


def fit_list(vectors: DataFrame, scale: int = 1024, shift: int = 100_000) -> DataFrame:
    """vec_id, dim and x (array of long) of each row whose vector is there, finite and not empty."""
    v = F.col("embedding").cast("array<double>")
    fine = (F.size("vec") > 0) & F.forall("vec", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) <= LARGEST))
    # The condition holds for all rows that stay; it guards those that a filter moved below would still see.
    x = F.transform("vec", lambda c: F.when(F.abs(c) <= LARGEST, F.floor(c * F.lit(float(scale))).cast("long") + F.lit(shift)))
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("vec")).where(fine)
    return kept.select("vec_id", F.size("vec").alias("dim"), x.alias("x"))


def totals(x: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """For each length of vectors: how many there are, and the exact sum of each dimension."""
    by_place = x.select("dim", F.posexplode("x").alias("i", "value")).groupBy("dim", "i").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(38,0)")).alias("s"))
    found: dict[int, tuple[int, list[int]]] = {}
    for r in by_place.orderBy("dim", "i").collect():
        found.setdefault(r["dim"], (r["n"], []))[1].append(int(r["s"]))
    return found


@dataclass
class Whitening:
    """What tasks need for the vectors of one length."""

    n: int
    sums: list[int]
    #: One row for each component, divided by the root of its eigenvalue.
    matrix: np.ndarray
    explained: np.ndarray

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S/n: whole numbers first, so that only the fraction is rounded."""
        whole, rest = zip(*(divmod(s, self.n) for s in self.sums), strict=True)
        return (x - np.array(whole, np.int64)).astype(np.float64) - np.array([r / self.n for r in rest])

    def deviations(self, x: np.ndarray) -> list[int]:
        """Sum over dimensions of (n * x - S)**2, in integers of any size."""
        whole, rest = (np.array(v, object) for v in zip(*(divmod(s, self.n) for s in self.sums), strict=True))
        whole = whole.astype(np.int64)
        far = x - whole
        most = int(np.abs(far).max(initial=0)) + 1
        # (n * far - rest)**2 = n * (n * far**2 - 2 * far * rest) + rest**2; each sum below fits 64 bits or is done in objects.
        if most**2 * x.shape[1] < 2**62 and most * self.n * x.shape[1] < 2**62:
            square, cross = (far * far).sum(axis=1), (far * rest.astype(np.int64)).sum(axis=1)
        else:
            square, cross = (far.astype(object) ** 2).sum(axis=1), (far.astype(object) * rest).sum(axis=1)
        last = int((rest**2).sum())
        return [self.n * (self.n * int(a) - 2 * int(b)) + last for a, b in zip(square, cross, strict=True)]


def _matrices(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


def _scatter(of: dict[int, Whitening], whitened: bool):
    """Per task and length of vectors, rows of the sum of products of centred (or whitened) vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            sizes = batch.column("dim").to_numpy()
            for dim in np.unique(sizes).tolist():
                part = batch.filter(pa.array(sizes == dim))
                for i in range(0, part.num_rows, BATCH):
                    x = _matrices(part.column("x" if not whitened else "whitened").slice(i, BATCH), dim if not whitened else len(of[dim].matrix))
                    y = np.column_stack([x, np.ones(len(x))]) if whitened else of[dim].centred(x)
                    held[dim] = held.get(dim, 0) + y.T @ y
        for dim, m in held.items():
            i, j = np.triu_indices(len(m))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), dim, np.int32)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(m[i, j])], names=["dim", "i", "j", "value"])

    return run


def scatter(x: DataFrame, of: dict[int, Whitening], whitened: bool = False) -> dict[int, np.ndarray]:
    """The sum of products for each length of vectors; of whitened ones with a last column of ones."""
    parts = x.mapInArrow(_scatter(of, whitened), "dim int, i int, j int, value double")
    found: dict[int, np.ndarray] = {}
    for r in parts.groupBy("dim", "i", "j").agg(F.sum("value").alias("value")).collect():
        size = len(of[r["dim"]].matrix) + 1 if whitened else r["dim"]
        m = found.setdefault(r["dim"], np.zeros((size, size)))
        m[r["i"], r["j"]] = m[r["j"], r["i"]] = r["value"]
    return found


def rounds(d: int) -> list[np.ndarray]:
    """All pairs of 0 .. d - 1, each once, in rounds of pairs that share nothing (2 columns)."""
    ring = list(range(d + d % 2))
    out = []
    for _ in range(len(ring) - 1):
        half = len(ring) // 2
        pairs = [(min(p), max(p)) for p in zip(ring[:half], reversed(ring[half:]), strict=True) if max(p) < d]
        out.append(np.array(pairs, np.int64).reshape(-1, 2))
        ring = [ring[0], ring[-1], *ring[1:-1]]
    return out


def _turn(m: np.ndarray, p: np.ndarray, q: np.ndarray, c: np.ndarray, s: np.ndarray) -> None:
    """Rotate rows p and q of ``m`` into each other, pair by pair."""
    x, y = m[p], m[q]
    m[p], m[q] = c[:, None] * x - s[:, None] * y, s[:, None] * x + c[:, None] * y


def jacobi(matrix: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues in falling order and unit eigenvectors (columns) of a symmetric matrix.

    A sweep goes through all pairs of dimensions cyclically; pairs that share no
    dimension are rotated together. It ends when no rotation was needed: each
    off-diagonal entry is below the rounding of the diagonal ones it lies between. Of
    either sign, the one is taken that makes a vector's largest entry positive.
    """
    a, v = np.array(matrix, np.float64), np.eye(len(matrix))
    eps, tiny = np.finfo(np.float64).eps * max(1.0, len(a)) ** 0.5, np.finfo(np.float64).tiny
    for _ in range(sweeps):
        turned = False
        for pairs in rounds(len(a)):
            p, q = pairs[:, 0], pairs[:, 1]
            off, dp, dq = a[p, q], a[p, p], a[q, q]
            need = np.abs(off) > np.maximum(eps * np.sqrt(np.abs(dp)) * np.sqrt(np.abs(dq)), tiny)
            if not need.any():
                continue
            turned = True
            p, q, off, dp, dq = p[need], q[need], off[need], dp[need], dq[need]
            # The smaller of the two angles that make a[p, q] vanish.
            with np.errstate(over="ignore"):
                theta = (dq - dp) / (2 * off)
                t = np.where(theta >= 0, 1.0, -1.0) / (np.abs(theta) + np.hypot(theta, 1))
            c = 1 / np.hypot(t, 1)
            s = t * c
            # Rows, then, as the matrix is symmetric, the rows of its transpose.
            _turn(a, p, q, c, s)
            a = np.ascontiguousarray(a.T)
            _turn(a, p, q, c, s)
            a[p, q] = a[q, p] = 0.0
            a[p, p], a[q, q] = dp - t * off, dq + t * off
            _turn(v, p, q, c, s)
        if not turned:
            break
    else:
        raise ArithmeticError(f"off-diagonal entries are left after {sweeps} sweeps")
    order = np.argsort(-np.diag(a), kind="stable")
    v = v[order].T
    if len(v):
        v = v * np.where(v[np.abs(v).argmax(axis=0), np.arange(len(v))] < 0, -1.0, 1.0)
    return np.diag(a)[order], v


def fitted(x: DataFrame, components: int) -> dict[int, Whitening]:
    """The whitening of each length of vectors."""
    of = {dim: Whitening(n, s, np.zeros((0, dim)), np.zeros(0)) for dim, (n, s) in totals(x).items()}
    for dim, m in scatter(x, of).items():
        fit = of[dim]
        values, vectors = jacobi(m / fit.n)
        k = min(components, int((values > LEAST * max(values[0], 0)).sum()))
        fit.matrix = (vectors[:, :k] / np.sqrt(values[:k])).T
        fit.explained = values[:k] / values.sum() if k else np.zeros(0)
    return of


def _projected(of: dict[int, Whitening]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("dim").to_numpy()
            for dim in np.unique(sizes).tolist():
                fit, part = of[dim], batch.filter(pa.array(sizes == dim))
                for i in range(0, part.num_rows, BATCH):
                    some = part.slice(i, BATCH)
                    x = _matrices(some.column("x"), dim)
                    y = fit.centred(x) @ fit.matrix.T
                    lists = pa.ListArray.from_arrays(np.arange(0, y.size + 1, max(1, y.shape[1]), dtype=np.int32) if y.shape[1] else np.zeros(len(x) + 1, np.int32), pa.array(y.ravel()))
                    far = pa.array([str(d) for d in fit.deviations(x)], pa.string())
                    yield pa.RecordBatch.from_arrays([some.column("vec_id"), some.column("dim"), far, lists], names=["vec_id", "dim", "deviation", "whitened"])

    return run


def whitened(vectors: DataFrame, components: int = 8, scale: int = 1024, shift: int = 100_000) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error.

    One row for each vector that takes part and each of the first ``components``
    principal components, numbered from 1 by falling eigenvalue; all vectors that take
    part are the fit list. ``deviation`` is the exact sum of (n * x - S)**2 over the
    dimensions; null where it needs more than 64 bits.

    Null vectors, vectors with null or non-finite entries, and ones beyond 2**40 take
    no part. Vectors of different lengths have a fit of their own each, and empty ones
    no component. Components without variance (fewer vectors than components, equal
    vectors) give no rows. Rows with a null or repeated vec_id are rows like all
    others. Other columns are ignored. No rows give no rows.
    """
    spark = vectors.sparkSession
    x = fit_list(vectors, scale, shift)
    of = {dim: fit for dim, fit in fitted(x, components).items() if len(fit.matrix)}
    rows = staged(x.where(F.col("dim").isin(list(of))).mapInArrow(_projected(of), "vec_id long, dim int, deviation string, whitened array<double>"), "whitened")
    known = [(-1, 0, 0, 0.0, 0.0)]
    for dim, m in scatter(rows, of, whitened=True).items():
        fit = of[dim]
        mean = m[-1, :-1] / fit.n
        error = float(np.abs(m[:-1, :-1] / fit.n - np.outer(mean, mean) - np.eye(len(fit.matrix))).max())
        known += [(dim, k + 1, fit.n, float(e), error) for k, e in enumerate(fit.explained)]
    about = spark.createDataFrame(known, "dim int, component int, n long, explained double, identity_error double")
    long = rows.select("vec_id", "dim", F.expr("try_cast(deviation AS bigint)").alias("deviation"), F.posexplode("whitened").alias("at", "whitened")).withColumn("component", F.col("at") + 1)
    # At most ``components`` rows for each length of vectors.
    return long.join(F.broadcast(about), ["dim", "component"]).select("vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error")
