"""Whitening of embeddings by spectral divide and conquer of their covariance.

Entries become integers (256ths, rounded down), the fit list is each distinct integer vector once. Sums
are exact; the covariance is added up from centred vectors, task by task. On the driver, which has a
d by d matrix and nothing else, the covariance less a shift is taken to its polar factor by QDWH
iterations: half of that factor plus the identity projects on the eigenvectors above the shift. Bases of
the projector's range and of the rest split the matrix in two smaller ones, down to single components.
The matrix of the components asked for goes to the tasks, which whiten all rows.

How it scales: one shuffle, for the distinct vectors, with repeats removed before it; a task adds d * d / 2
sums, which meet in d * d / 2 groups. The fit list is written once below the shared folder.

Defined cases: a vector that is null or has null or non-finite entries, or whose length isn't the most
frequent one (the larger of equally frequent ones), is left out; repeated rows are whitened
alike and fitted once; ids may repeat or be null; with fewer dimensions than components asked for, all
are given; a component without variance has null in ``whitened`` and counts not in ``identity_error``;
without any variance ``explained`` and ``identity_error`` are null; a ``deviation`` beyond 64 bits is null;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.session import written

SCALE, COMPONENTS = 256, 4
EPS = float(np.finfo(np.float64).eps)


def polar(a: np.ndarray, most: int = 30) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix by dynamically weighted Halley iterations."""
    n = len(a)
    x, low = a / np.linalg.norm(a), EPS
    for _ in range(most):
        d = np.cbrt(4 * (1 - low**2) / low**4)
        root = np.sqrt(1 + d)
        wa = root + np.sqrt(8 - 4 * d + 8 * (2 - low**2) / (low**2 * root)) / 2
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        q, _ = np.linalg.qr(np.vstack([np.sqrt(wc) * x, np.eye(n)]))
        new = wb / wc * x + (wa - wb / wc) / np.sqrt(wc) * q[:n] @ q[n:].T
        new = (new + new.T) / 2
        low = min(1.0, low * (wa + wb * low**2) / (1 + wc * low**2))
        moved = np.linalg.norm(new - x)
        x = new
        if low > 1 - 10 * EPS and moved < n * 1e-14 ** (1 / 3):
            break
    return x


def shifts(a: np.ndarray) -> Iterator[float]:
    """Where to split: in the middle of the diagonal, else at its mean, else beside it.

    The mean lies strictly between the smallest and the largest eigenvalue, unless all are equal.
    """
    diagonal = np.sort(np.diag(a))
    mean, spread = float(diagonal.mean()), np.linalg.norm(a - np.diag(np.full(len(a), diagonal.mean()))) / np.sqrt(len(a))
    yield float(np.median(diagonal))
    yield mean
    for part in (1 / 16, -1 / 16, 1 / 4, -1 / 4, 1 / 2, -1 / 2, 1 / 64, -1 / 64):
        yield mean + part * spread


def eigen(a: np.ndarray, scale: float | None = None, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and unit eigenvectors (columns) of a symmetric matrix, in no order."""
    n = len(a)
    scale = np.linalg.norm(a) if scale is None else scale
    off = np.linalg.norm(a - np.diag(np.diag(a)))
    if n == 1 or off <= EPS * scale:
        return np.diag(a).copy(), np.eye(n)
    best = None
    rng = np.random.default_rng(seed)
    for shift in shifts(a):
        moved = a - shift * np.eye(n)
        if not np.linalg.norm(moved) > 0:
            continue
        projector = (polar(moved) + np.eye(n)) / 2
        k = int(round(float(np.trace(projector))))
        if not 0 < k < n:
            continue
        # a second product takes out what the first basis has of the other part
        first, _ = np.linalg.qr(projector @ rng.standard_normal((n, k)))
        basis, _ = np.linalg.qr(projector @ first, mode="complete")
        split = basis.T @ a @ basis
        left = np.linalg.norm(split[k:, :k])
        if best is None or left < best[0]:
            best = (left, k, basis, split)
        if left <= 8 * n * EPS * scale:
            break
    if best is None:  # all eigenvalues are equal up to rounding
        return np.diag(a).copy(), np.eye(n)
    _, k, basis, split = best
    split = (split + split.T) / 2
    high, vh = eigen(split[:k, :k], scale, seed + 1)
    low, vl = eigen(split[k:, k:], scale, seed + 2)
    return np.concatenate([high, low]), np.hstack([basis[:, :k] @ vh, basis[:, k:] @ vl])


def components(covariance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues from the largest on, and their unit eigenvectors in columns."""
    _, vectors = eigen(covariance)
    values = np.einsum("ij,ik,kj->j", vectors, covariance, vectors)
    order = np.argsort(-values, kind="stable")
    return values[order], vectors[:, order]


def integers(value: Column) -> Column:
    return F.transform(value, lambda c: F.floor(c.cast("double") * SCALE))


def usable(rows: DataFrame, embedding: str, key: str) -> tuple[DataFrame, int]:
    """Ids with the integer vectors that count, and their length (0 without any)."""
    vector = F.col(embedding)
    finite = F.forall(vector, lambda c: c.isNotNull() & (F.abs(c) < float("inf")) & ~F.isnan(c))
    good = rows.where(vector.isNotNull() & finite).select(F.col(key).cast("long").alias("vec_id"), vector.alias("v"))
    size = F.size("v").alias("size")
    top = good.groupBy(size).count().orderBy(F.desc("count"), F.desc("size")).first()
    dims = top["size"] if top else 0
    return good.where(F.size("v") == dims).select("vec_id", integers(F.col("v")).alias("x")), dims


def matrix(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    """The vectors of a batch, one per row."""
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _sums(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[pa.RecordBatch]:
    n, sums, most = 0, [0] * dims, 0
    for batch in batches:
        x = matrix(batch, dims)
        if len(x):
            largest = max(abs(int(x.min())), abs(int(x.max())))
            wide = largest * len(x) >= 1 << 62
            sums = [a + int(b) for a, b in zip(sums, x.astype(object).sum(0) if wide else x.sum(0), strict=True)]
            n, most = n + len(x), max(most, largest)
    if n:
        from decimal import Decimal

        kind = pa.decimal128(38, 0)
        columns = [pa.array(range(dims), pa.int32()), pa.array([Decimal(s) for s in sums], kind)]
        same = [pa.array([n] * dims, pa.int64()), pa.array([Decimal(most)] * dims, kind)]
        yield pa.RecordBatch.from_arrays([*columns, *same], ["i", "s", "n", "most"])


def _products(batches: Iterator[pa.RecordBatch], dims: int, mean: np.ndarray) -> Iterator[pa.RecordBatch]:
    total = np.zeros((dims, dims))
    for batch in batches:
        centred = matrix(batch, dims) - mean
        total += centred.T @ centred
    i, j = np.triu_indices(dims)
    yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], ["i", "j", "p"])


def added(rows: DataFrame, run, dims: int) -> np.ndarray:
    """The symmetric matrix of products that tasks have summed."""
    made = rows.mapInArrow(run, "i int, j int, p double").groupBy("i", "j").agg(F.sum("p").alias("p"))
    out = np.zeros((dims, dims))
    for r in made.collect():  # dims * dims / 2 rows
        out[r.i, r.j] = out[r.j, r.i] = r.p
    return out


@dataclass
class Whitening:
    """What the tasks need: sums and rows of the fit list, and the components asked for."""

    n: int
    sums: list[int]
    most: int
    #: One column per component: the eigenvector over the root of its eigenvalue; NaN without variance.
    matrix: np.ndarray
    explained: list[float | None]
    identity_error: float | None = None

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return self.deviations(x).astype(np.float64) / self.n @ self.matrix

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exactly."""
        largest = max(abs(int(x.min())), abs(int(x.max()))) if x.size else 0
        if self.n * largest + max(map(abs, self.sums), default=0) < 1 << 62:
            return x * np.int64(self.n) - np.array(self.sums, np.int64)
        return x.astype(object) * self.n - np.array(self.sums, object)

    def squares(self, x: np.ndarray) -> list[int | None]:
        """Sums of squared deviations; None beyond 64 bits."""
        d = self.deviations(x)
        largest = max(abs(int(d.min())), abs(int(d.max()))) if d.size else 0
        if largest**2 * max(d.shape[1], 1) < 1 << 62:
            return (d * d).sum(1).tolist()
        exact = d.astype(object)
        return [s if s < 1 << 63 else None for s in (exact * exact).sum(1).tolist()]


def _crosses(batches: Iterator[pa.RecordBatch], dims: int, model: Whitening, kept: list[int]) -> Iterator[pa.RecordBatch]:
    """Sums of whitened values and of their products; the last row and column hold the sums."""
    total = np.zeros((len(kept) + 1, len(kept) + 1))
    for batch in batches:
        y = model.whiten(matrix(batch, dims))[:, kept]
        y = np.hstack([y, np.ones((len(y), 1))])
        total += y.T @ y
    i, j = np.triu_indices(len(kept) + 1)
    yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], ["i", "j", "p"])


def fit(rows: DataFrame, dims: int, most_components: int | None = COMPONENTS) -> Whitening | None:
    """The whitening of the distinct vectors ``x`` of ``rows``; None without any.

    Runs jobs; the distinct vectors are written once below the shared folder.
    """
    listed = written(rows.select("x").distinct(), "whitening-fit")
    made = listed.mapInArrow(partial(_sums, dims=dims), "i int, s decimal(38,0), n long, most decimal(38,0)")
    found = made.groupBy("i").agg(F.sum("s").alias("s"), F.sum("n").alias("n"), F.max("most").alias("most")).orderBy("i").collect()
    if not found:
        return None
    n, sums = found[0].n, [int(r.s) for r in found]
    mean = np.array([s / n for s in sums])
    covariance = added(listed, partial(_products, dims=dims, mean=mean), dims) / n
    values, vectors = components(covariance)
    count = dims if most_components is None else min(dims, most_components)
    trace = float(np.trace(covariance))
    real = [bool(v > dims * EPS * max(values[0], 0)) for v in values[:count]]
    scaled = np.array([vectors[:, i] / np.sqrt(values[i]) if real[i] else np.full(dims, np.nan) for i in range(count)]).T
    explained = [float(values[i]) / trace if trace > 0 else None for i in range(count)]
    model = Whitening(n, sums, int(found[0].most), scaled.reshape(dims, count), explained)
    kept = [i for i, ok in enumerate(real) if ok]
    if kept:
        sums_of = added(listed, partial(_crosses, dims=dims, model=model, kept=kept), len(kept) + 1)
        middle = sums_of[-1, :-1] / n
        whole = sums_of[:-1, :-1] / n - np.outer(middle, middle)
        model.identity_error = float(np.abs(whole - np.eye(len(kept))).max())
    return model


SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def _whitened(batches: Iterator[pa.RecordBatch], dims: int, model: Whitening) -> Iterator[pa.RecordBatch]:
    count = len(model.explained)
    for batch in batches:
        x = matrix(batch, dims)
        each = np.repeat(np.arange(len(x)), count)
        values = model.whiten(x).reshape(-1)
        columns = [
            batch.column("vec_id").take(pa.array(each)),
            pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), len(x))),
            pa.array(np.full(len(each), model.n), pa.int64()),
            pa.array(model.squares(x), pa.int64()).take(pa.array(each)),
            pa.array(values, pa.float64(), mask=np.isnan(values)),
            pa.array(model.explained * len(x), pa.float64()),
            pa.array([model.identity_error] * len(each), pa.float64()),
        ]
        yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])


def whiten(rows: DataFrame, most_components: int | None = COMPONENTS, embedding: str = "embedding", key: str = "vec_id") -> DataFrame:
    """One row per usable vector and component."""
    usable_rows, dims = usable(rows, embedding, key)
    model = fit(usable_rows, dims, most_components) if dims else None
    if model is None:
        return rows.sparkSession.createDataFrame([], SCHEMA)
    return usable_rows.mapInArrow(partial(_whitened, dims=dims, model=model), SCHEMA)
