"""Whitening of embeddings by pivoted Cholesky and one-sided Jacobi.

Components become whole numbers (``floor(scale * c) + shift``), and the list to fit is each distinct vector of them once.
Tasks add up its length and sums, then the products of its centred vectors; what reaches the driver is one triangle of the
scatter matrix, whose size is set by the dimensions alone. There it is factored by a Cholesky decomposition with diagonal
pivots, which shows the rank, and plane rotations make the columns of the triangular factor orthogonal: their squared norms
are the eigenvalues of the scatter, the normalised columns its eigenvectors, small ones as accurate as large ones. A last
pass over the list measures the covariance of what the components make of it.

Scale: one shuffle of vectors (equal ones meet in the map tasks first), then passes that emit one array a task.

Defined cases: vectors that are null, empty, of another length than most, or hold null or non-finite components, or ones of
2^52 or more after scaling, take no part; rows with them are dropped. Rows with equal or null ids each keep their row. There are as
many components as the scatter has rank, so none for a single vector, and none for an empty table. A deviation beyond a long
is null. Extra columns pass through; ones named like the new columns are replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import add_columns, column, packed, unpacked
from foliospark.operators.shared import materialise, task_sums

SCALE, SHIFT, KEEP = 64, 1_000_000, 16
LARGE, SWEEPS = 2.0**52, 60


@dataclass(frozen=True)
class Whitening:
    """``n`` vectors with sums ``sums``; ``axes`` has a component per column, ``values`` the eigenvalues of the covariance."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    axes: np.ndarray
    trace: float
    identity_error: float

    @property
    def explained(self) -> list[float]:
        return (self.values / self.trace).tolist() if len(self.values) else []

    def centred(self, x: np.ndarray) -> np.ndarray:
        return _centred(x, self.n, self.sums)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """The exact sum over dimensions of ``(n * x - sum)^2``."""
        y = x - np.array([s // self.n for s in self.sums], np.int64)
        rest = np.array([s % self.n for s in self.sums], np.int64)
        most = float(self.n) * (float(abs(y).max(initial=0)) + 1)
        if most * most * max(1, x.shape[1]) < 2.0**62:
            far = self.n * y - rest
            return (far * far).sum(1).tolist()
        far = self.n * y.astype(object) - rest.astype(object)
        exact = (far * far).sum(1) if x.shape[1] else [0] * len(x)
        return [int(v) if v < 1 << 63 else None for v in exact]

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.axes / np.sqrt(self.values)


def _centred(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """Less the mean: its whole part is taken off in whole numbers, so nothing is rounded away from large values."""
    whole, rest = np.array([s // n for s in sums], np.int64), np.array([s % n for s in sums])
    return (x - whole) - rest / n


def fixed_point(rows: DataFrame, vec_col: str, scale: int, shift: int, name: str) -> DataFrame:
    """The rows that take part, their vectors as whole numbers under ``name``, whatever their length."""
    v = column(vec_col)
    scaled = lambda c: F.floor(c.cast("double") * scale)
    fine = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double") * scale) < LARGE))
    return rows.where(F.coalesce(fine & (F.size(v) > 0), F.lit(False))).withColumn(name, F.transform(v, lambda c: scaled(c) + F.lit(shift).cast("long")))


def matrix(values: pa.Array, d: int) -> np.ndarray:
    return values.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _added(fn: Callable[[np.ndarray], np.ndarray], d: int) -> Callable[[Iterator[pa.RecordBatch]], np.ndarray | None]:
    """The sum of ``fn`` over a task's batches of vectors."""
    def total(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
        own = None
        for batch in batches:
            if batch.num_rows:
                made = fn(matrix(batch.column(0), d))
                own = made if own is None else own + made
        return own

    return total


def pivoted_cholesky(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(low, order)`` with ``low @ low.T`` equal to ``a[order][:, order]``; as many columns as ``a`` has rank."""
    a, d = a.copy(), len(a)
    low, order = np.zeros((d, d)), np.arange(d)
    least = d * np.finfo(float).eps * max(0.0, np.diag(a).max(initial=0))
    for k in range(d):
        j = k + int(np.argmax(np.diag(a)[k:]))
        if a[j, j] <= least:
            return low[:, :k], order
        swap = [j, k]
        a[[k, j]] = a[swap]
        a[:, [k, j]] = a[:, swap]
        low[[k, j]] = low[swap]
        order[[k, j]] = order[swap]
        low[k:, k] = a[k:, k] / np.sqrt(a[k, k])
        a[k + 1:, k + 1:] -= np.outer(low[k + 1:, k], low[k + 1:, k])
    return low, order


def orthogonalised(low: np.ndarray) -> np.ndarray:
    """Rotate pairs of columns until all are orthogonal. A round turns disjoint pairs at once; rounds go through all pairs."""
    w = low.T.copy()
    r = len(w)
    order, half = np.arange(r + r % 2), (r + 1) // 2
    close = np.sqrt(max(1, low.shape[0])) * np.finfo(float).eps
    for _ in range(SWEEPS):
        turned = False
        for _ in range(len(order) - 1):
            i, j = order[:half], order[::-1][:half]
            real = (i < r) & (j < r)
            i, j = i[real], j[real]
            x, y = w[i], w[j]
            a, b, g = (x * x).sum(1), (y * y).sum(1), (x * y).sum(1)
            turn = abs(g) > close * np.sqrt(a * b)
            if turn.any():
                turned = True
                i, j, x, y, a, b, g = (v[turn] for v in (i, j, x, y, a, b, g))
                zeta = (b - a) / (2 * g)
                t = np.where(zeta < 0, -1.0, 1.0) / (abs(zeta) + np.sqrt(1 + zeta * zeta))
                c = 1 / np.sqrt(1 + t * t)
                w[i], w[j] = c[:, None] * x - (c * t)[:, None] * y, (c * t)[:, None] * x + c[:, None] * y
            order = np.concatenate((order[:1], order[-1:], order[1:-1]))
        if not turned:
            break
    return w.T


def components(scatter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns, both as many as the rank."""
    low, order = pivoted_cholesky(scatter)
    turned = orthogonalised(low)
    norms = np.sqrt((turned * turned).sum(0))
    by = np.argsort(-norms, kind="stable")
    axes = np.empty_like(turned)
    axes[order] = turned / norms
    return norms[by] ** 2, axes[:, by]


def fit(rows: DataFrame, vec_col: str = "embedding", keep: int = KEEP, scale: int = SCALE, shift: int = SHIFT) -> Whitening:
    """The first ``keep`` components of the distinct vectors of ``rows``."""
    x = fixed_point(rows.select(column(vec_col)), vec_col, scale, shift, "_x").select("_x")
    common = x.groupBy(F.size("_x").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if not common:
        return Whitening(0, (), np.zeros(0), np.zeros((0, 0)), 0.0, 0.0)
    d = common["d"]
    once = materialise(x.where(F.size("_x") == d).distinct())

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, own = 0, np.zeros(d, np.int64)
        for batch in batches:
            n, own = n + batch.num_rows, own + matrix(batch.column(0), d).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(range(d + 1), pa.int32()), pa.array([n, *own.tolist()], pa.int64())], ["at", "v"])

    found = once.mapInArrow(sums, "at int, v long").groupBy("at").agg(F.sum("v").alias("v")).orderBy("at").collect()  # a number a dimension
    n, own = found[0]["v"], tuple(r["v"] for r in found[1:])
    upper = np.triu_indices(d)

    def products(y: np.ndarray) -> np.ndarray:
        z = _centred(y, n, own)
        return (z.T @ z)[upper]

    scatter = np.zeros((d, d))
    scatter[upper] = task_sums(once, _added(products, d))
    scatter = scatter + np.triu(scatter, 1).T
    values, axes = components(scatter)
    trace = float(np.diag(scatter).sum() / n)
    made = Whitening(n, own, values[:keep] / n, axes[:, :keep], trace, 0.0)
    k = len(made.values)
    if not k:
        return made

    def covered(y: np.ndarray) -> np.ndarray:
        w = made.whitened(y)
        return np.concatenate(((w.T @ w).ravel(), w.sum(0)))

    total = task_sums(once, _added(covered, d)) / n
    mean = total[k * k:]
    error = abs(total[:k * k].reshape(k, k) - np.outer(mean, mean) - np.eye(k)).max()
    return Whitening(n, own, made.values, made.axes, trace, float(error))


def transform(rows: DataFrame, model: Whitening, vec_col: str = "embedding", scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """The rows that take part, with ``deviation`` and ``whitened``, one value a component."""
    d, new = len(model.sums), ("deviation", "whitened")
    own = rows.select(*[column(c) for c in rows.columns if c not in new])
    used = fixed_point(own.select(packed(own), column(vec_col).alias("v")), "v", scale, shift, "x").where(F.size("x") == d).select("_row", "x")

    def made(values: pa.Array) -> list[pa.Array]:
        x = matrix(values, d)
        return [pa.array(model.deviations(x), pa.int64()), pa.array(list(model.whitened(x)), pa.list_(pa.float64()))]

    done = add_columns(used, ["x"], [("deviation", "long"), ("whitened", "array<double>")], made)
    return done.select(*unpacked(done, own.columns), *new)


def by_component(done: DataFrame, model: Whitening, *kept: Column) -> DataFrame:
    """A row for each component: ``component`` from 1, ``whitened`` and ``explained``, with the columns in ``kept``."""
    explained = F.array(*[F.lit(float(e)) for e in model.explained]).cast("array<double>")
    rows = done.select(*kept, F.posexplode("whitened").alias("_at", "whitened"), explained.alias("_explained"))
    return rows.withColumn("component", F.col("_at") + 1).withColumn("explained", F.get("_explained", "_at")).drop("_at", "_explained")
