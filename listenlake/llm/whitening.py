"""Whitening of embeddings by a bidiagonal qd solver.

Vectors become whole numbers, so that counts, sums and deviations are exact.  Each task reduces the centred rows of its blocks to one
small triangle by QR, a tree of group-bys reduces the triangles of all tasks to a single one, ``R``, with ``R'R`` the scatter matrix;
the covariance itself is never formed, which would square its condition.  ``R`` is a matrix of the vectors' dimensions, whatever
their number.  Householder reflections turn it into a bidiagonal one, ``B``; the differential quotient-difference algorithm with shifts
finds the squares of its singular values, and twisted factorisations of ``B'B`` less each of them give the vectors, from the end at
which they are largest.  The reflections carry these back, and every row is projected on them in one last pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import settled

#: Entries are taken in steps of 1 / SCALE and moved up by OFFSET; beyond LARGEST steps they stay there, so that doubles hold them.
SCALE, OFFSET, LARGEST = 1024, 100_000, 1 << 52
#: Rows that are reduced at once, and triangles that one task of the tree takes.
BLOCK_ROWS, FAN = 2048, 16
EPS = float(np.finfo(np.float64).eps)


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its entries are finite numbers."""
    return vector.isNotNull() & F.coalesce(F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf"))), F.lit(False))


# Householder, dqds and twisted factorisations: of one small matrix, whose size is the vectors' dimension


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal and upper diagonal of ``B``, and the orthogonal ``P``, with ``r = Q B P'``."""
    a, n = np.array(r, dtype=np.float64), r.shape[1]
    right = []

    def reflect(x: np.ndarray) -> np.ndarray | None:
        """The unit vector whose reflection leaves only the first entry of ``x``."""
        tail = np.abs(x).max() if len(x) else 0.0
        if tail == 0:
            return None
        u = x / tail
        u[0] += np.copysign(np.sqrt(u @ u), u[0])
        return u / np.sqrt(u @ u)

    for k in range(n):
        if (u := reflect(a[k:, k])) is not None:
            a[k:, k:] -= 2 * np.outer(u, u @ a[k:, k:])
        if k + 1 < n and (v := reflect(a[k, k + 1 :])) is not None:
            a[k:, k + 1 :] -= 2 * np.outer(a[k:, k + 1 :] @ v, v)
            right.append((k + 1, v))
    p = np.eye(n)
    for k, v in reversed(right):
        p[k:, :] -= 2 * np.outer(v, v @ p[k:, :])
    return np.diagonal(a).copy(), np.diagonal(a, 1).copy(), p


def dqds(q: list[float], e: list[float]) -> list[float]:
    """The eigenvalues, falling, of ``B'B``, from the squares of the diagonal and the upper diagonal of ``B``.

    Every sweep is shifted by a bound from below on the smallest eigenvalue: the reciprocal of the trace of the inverse, whose
    terms a sweep without shift yields.  No sweep can fail then, and small eigenvalues keep their relative accuracy.
    """
    found: list[float] = []
    todo = [(list(map(float, q)), list(map(float, e)), 0.0)]
    while todo:
        q, e, shift = todo.pop()
        while q:
            if len(q) == 1:
                found.append(shift + q.pop())
                break
            small = (100 * EPS) ** 2
            cut = next((i for i in range(len(e) - 1, -1, -1) if e[i] <= small * (shift + q[i + 1]) or e[i] <= small * (shift + q[i])), None)
            if cut is not None:
                todo.append((q[: cut + 1], e[:cut], shift))
                q, e = q[cut + 1 :], e[cut + 1 :]
                continue
            if 1.5 * q[0] < q[-1]:  # the small end belongs at the bottom
                q.reverse()
                e.reverse()
            d, inverse = q[0], 0.0
            for i in range(len(e)):
                inverse += 1 / d if d > 0 else float("inf")
                d = d * (q[i + 1] / (d + e[i]))
            inverse += 1 / d if d > 0 else float("inf")
            tau = (1 - 8 * len(q) * EPS) / inverse
            while True:
                new_q, new_e, d = [0.0] * len(q), [0.0] * len(e), q[0] - tau
                fine = d >= 0
                for i in range(len(e)):
                    if not fine:
                        break
                    new_q[i] = d + e[i]
                    if new_q[i] <= 0:
                        fine = False
                        break
                    ratio = q[i + 1] / new_q[i]
                    new_e[i] = e[i] * ratio
                    d = d * ratio - tau
                    fine = d >= 0
                if fine:
                    break
                tau = tau / 2 if tau > EPS * q[-1] else 0.0  # rounding took the bound over the eigenvalue
            new_q[-1] = d
            q, e, shift = new_q, new_e, shift + tau
    return sorted(found, reverse=True)


class Twisted:
    """Twisted factorisations of ``B'B - eigenvalue``, for the vector that belongs to the eigenvalue."""

    def __init__(self, a: np.ndarray, b: np.ndarray, eigenvalue: float):
        n = len(a)
        pivot, lower = (a * a).tolist(), (b / a[:-1]).tolist() if n > 1 else []
        tiny = EPS * EPS * max(max(pivot), eigenvalue, 1e-300)
        self.down, self.up, s, p = [0.0] * max(0, n - 1), [0.0] * max(0, n - 1), [0.0] * n, [0.0] * n
        s[0] = -eigenvalue
        for i in range(n - 1):  # from the top: L D L'
            d = s[i] + pivot[i] or tiny
            self.down[i] = pivot[i] * lower[i] / d
            s[i + 1] = self.down[i] * lower[i] * s[i] - eigenvalue
        p[n - 1] = pivot[n - 1] - eigenvalue
        for i in range(n - 2, -1, -1):  # from the bottom: U D U'
            d = pivot[i] * lower[i] * lower[i] + p[i + 1] or tiny
            ratio = pivot[i] / d
            self.up[i] = lower[i] * ratio
            p[i] = p[i + 1] * ratio - eigenvalue
        self.gamma = np.abs(np.array(s) + np.array(p) + eigenvalue)
        self.gamma[np.isnan(self.gamma)] = np.inf

    def vector(self, twist: int) -> np.ndarray:
        """The unit vector from a factorisation that meets at ``twist``."""
        z = np.zeros(len(self.gamma))
        z[twist] = 1.0
        for i in range(twist - 1, -1, -1):
            z[i] = -self.down[i] * z[i + 1]
        for i in range(twist, len(z) - 1):
            z[i + 1] = -self.up[i] * z[i]
        z = z / np.abs(z).max()
        return z / np.sqrt(z @ z)


def _product(a: np.ndarray, b: np.ndarray, z: np.ndarray) -> np.ndarray:
    """``B'B z``."""
    y = a * z
    y[:-1] += b * z[1:]
    x = a * y
    x[1:] += b * y[:-1]
    return x


def singular(r: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, float]:
    """The largest eigenvalues of ``r'r``, falling, their unit vectors as columns, and the sum of all eigenvalues.

    Vectors of eigenvalues that agree to a thousandth are made orthogonal to one another; where their factorisations give the same
    vector, the next best twists are taken.  A zero on the diagonal of ``B`` counts as a rounding error of the largest entry.
    """
    n = r.shape[1]
    if not n or not np.any(r):
        return np.zeros(min(n, most)), np.eye(n)[:, :most], 0.0
    unit = float(np.abs(r).max())
    a, b, p = bidiagonal(r / unit)
    size = max(np.abs(a).max(), np.abs(b).max() if n > 1 else 0.0)
    a = np.where(np.abs(a) < EPS * size, EPS * size, a)
    b = np.where(np.abs(b) < EPS * EPS * size, 0.0, b)
    values = dqds((a * a).tolist(), (b * b).tolist())
    vectors = np.zeros((n, 0))
    near = 0  # the first of the values that agree with the present one
    for k in range(min(n, most)):
        if values[near] - values[k] > 1e-3 * values[near]:
            near = k
        # a value's block: B falls apart where its upper diagonal is zero
        best = None
        for start, end in _pieces(b):
            part = Twisted(a[start:end], b[start : end - 1], values[k])
            for twist in np.argsort(part.gamma, kind="stable")[: k - near + 2]:
                z = np.zeros(n)
                z[start:end] = part.vector(int(twist))
                for _ in range(2):
                    z -= vectors[:, near:] @ (vectors[:, near:].T @ z)
                    z -= vectors @ (vectors.T @ z)
                left = np.sqrt(z @ z)
                if left < 1e-4:
                    continue
                z /= left
                off = np.abs(_product(a, b, z) - (z @ _product(a, b, z)) * z).max() + abs(z @ _product(a, b, z) - values[k])
                if best is None or off < best[0]:
                    best = (off, z)
        vectors = np.concatenate([vectors, (best[1] if best else _any(vectors))[:, None]], axis=1)
    exact = np.array([z @ _product(a, b, z) for z in vectors.T])
    order = np.argsort(-exact, kind="stable")
    return exact[order] * unit * unit, (p @ vectors)[:, order], float(np.sum(a * a) + np.sum(b * b)) * unit * unit


def _pieces(b: np.ndarray) -> list[tuple[int, int]]:
    cuts = [0, *(np.flatnonzero(b == 0) + 1).tolist(), len(b) + 1]
    return list(zip(cuts, cuts[1:]))


def _any(vectors: np.ndarray) -> np.ndarray:
    """A unit vector orthogonal to the given ones."""
    rest = np.eye(len(vectors)) - vectors @ vectors.T
    z = rest[:, np.argmax((rest * rest).sum(axis=0))]
    return z / np.sqrt(z @ z)


# The rows


def _steps(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as whole steps, a row each; entries that a shorter vector lacks count as zeros."""
    size = np.asarray(column.value_lengths())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = np.full((len(size), width), OFFSET, dtype=np.int64)
    steps = np.clip(np.floor(flat * SCALE), -LARGEST, LARGEST).astype(np.int64) + OFFSET
    x[np.repeat(np.arange(len(size)), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = steps
    return x


class Whitening:
    """The fitted transformation: counts and sums, the directions, and how much of the variance each explains."""

    def __init__(self, n: int, sums: list[int], values: np.ndarray, directions: np.ndarray, total: float):
        self.n, self.sums, self.width = n, sums, len(sums)
        #: Variances along the components; zero where they are no more than rounding.
        self.variance = np.where(values > (self.width * EPS) ** 2 * max(1e-300, float(values.max(initial=0))), values / max(1, n), 0.0)
        self.directions, self.explained = directions, values / total if total > 0 else np.full(len(values), np.nan)
        self.middle = [round(s / n) if abs(s) < 1 << 52 else (2 * s + n) // (2 * n) for s in sums] if n else []
        self.rest = [s - n * m for s, m in zip(sums, self.middle)]

    def centred(self, x: np.ndarray) -> np.ndarray:
        """``x - S / n``: the difference to a whole number near the mean is exact, so that one rounding is left."""
        return (x - np.array(self.middle, dtype=np.int64)) - np.array([r / self.n for r in self.rest])

    def deviation(self, x: np.ndarray) -> list[int]:
        """The sum over dimensions of ``(n x - S) ** 2``, exactly."""
        d = x - np.array(self.middle, dtype=np.int64)
        far, spare = int(np.abs(d).max(initial=0)), max(map(abs, self.rest), default=0)
        if self.width * far * max(far, spare) < 1 << 62:
            squares, mixed = (d * d).sum(axis=1).tolist(), (d * np.array(self.rest, dtype=np.int64)).sum(axis=1).tolist()
        else:
            squares, mixed = ([sum(f(int(v), r) for v, r in zip(row, self.rest)) for row in d] for f in (lambda v, r: v * v, lambda v, r: v * r))
        n, last = self.n, sum(r * r for r in self.rest)
        return [n * n * s - 2 * n * m + last for s, m in zip(squares, mixed)]

    def white(self, x: np.ndarray) -> np.ndarray:
        """Centred rows on the components, scaled to unit variance; not a number along components without variance."""
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.variance > 0, (self.centred(x) @ self.directions) / np.sqrt(self.variance), np.nan)


def _sums(width: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = [0] * width, 0
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK_ROWS):
                x = _steps(batch.column("vector").slice(start, BLOCK_ROWS), width)
                n += len(x)
                high, low = (x >> 26).sum(axis=0).tolist(), (x & ((1 << 26) - 1)).sum(axis=0).tolist()  # halves that a block's sum can hold
                total = [t + (h << 26) + v for t, h, v in zip(total, high, low)]
        yield pa.RecordBatch.from_arrays([pa.array(range(width + 1), pa.int32()), pa.array([Decimal(v) for v in [*total, n]], pa.decimal128(38, 0))], names=["at", "total"])

    return work


def _triangle(rows: np.ndarray) -> np.ndarray:
    """The triangle of a QR factorisation, as many rows as columns."""
    r = np.linalg.qr(rows, mode="r")
    return r if len(r) == r.shape[1] else np.concatenate([r, np.zeros((r.shape[1] - len(r), r.shape[1]))])


def fit(rows: DataFrame, components: int = 8, vector_column: str = "embedding") -> Whitening:
    """Fits the components to all usable vectors.

    Vectors that are null or hold a null or non-finite entry take no part.  A shorter vector counts as filled up with zeros, which an
    empty one is; entries beyond 2**52 steps stay at that bound.  Repeated rows each count.  Without rows the result has no dimension.
    """
    from pyspark import TaskContext

    some = rows.select(F.col(vector_column).alias("vector")).where(usable(F.col("vector")))
    width = some.agg(F.max(F.size("vector"))).first()[0] or 0
    got = {r["at"]: int(r["total"]) for r in some.mapInArrow(_sums(width), "at int, total decimal(38,0)").groupBy("at").agg(F.sum("total").alias("total")).collect()}  # a row for each dimension, and their number
    n, sums = got.get(width, 0), [got.get(i, 0) for i in range(width)]
    if not n or not width:
        return Whitening(n, sums, np.zeros(0), np.zeros((width, 0)), 0.0)
    start = Whitening(n, sums, np.zeros(0), np.zeros((width, 0)), 0.0)

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = None
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                x = start.centred(_steps(batch.column("vector").slice(at, BLOCK_ROWS), width))
                r = _triangle(x if r is None else np.concatenate([r, x]))
        if r is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([r.tobytes()], pa.binary())], names=["at", "r"])

    def joined(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("at")
        r = _triangle(np.concatenate([np.frombuffer(x).reshape(width, width) for x in group["r"]]))
        return pd.DataFrame({"at": [int(group["at"].iloc[0]) // FAN], "r": [r.tobytes()]})

    level = settled(some.mapInArrow(reduced, "at int, r binary"))
    while level.count() > 1:
        level = settled(level.groupBy(F.expr(f"at div {FAN}")).applyInPandas(joined, "at int, r binary"))  # FAN triangles meet in a task
    r = np.frombuffer(level.first()["r"]).reshape(width, width)  # one matrix of the vectors' dimension
    values, directions, total = singular(r, components)
    return Whitening(n, sums, values, directions, total)


def identity_error(rows: DataFrame, model: Whitening, vector_column: str = "embedding") -> float | None:
    """The largest absolute entry of the whitened rows' covariance minus the identity, over components that have variance."""
    live = np.flatnonzero(model.variance > 0)
    if not len(live):
        return None
    k = len(live)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k))
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                w = model.white(_steps(batch.column("vector").slice(at, BLOCK_ROWS), model.width))[:, live]
                total[0] += w.sum(axis=0)
                total[1:] += w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array(range(total.size), pa.int32()), pa.array(total.ravel())], names=["at", "total"])

    some = rows.select(F.col(vector_column).alias("vector")).where(usable(F.col("vector")))
    got = some.mapInArrow(moments, "at int, total double").groupBy("at").agg(F.sum("total").alias("total")).toPandas()  # k * (k + 1) rows
    total = np.zeros((k + 1) * k)
    total[got["at"]] = got["total"]
    total = total.reshape(k + 1, k) / model.n
    return float(np.abs(total[1:] - np.outer(total[0], total[0]) - np.eye(k)).max())


def whiten(rows: DataFrame, components: int = 8, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """Every usable row on every component: ``vec_id, component, n, deviation, whitened, explained, identity_error``.

    Components are numbered from 1 by falling variance; there are at most as many as dimensions.  ``deviation`` is a decimal, exact,
    and null beyond 38 digits.  Along a component without variance ``whitened`` is null, and without any variance so are ``explained`` and
    ``identity_error``.  Null and repeated ids pass through, row by row; an empty table gives an empty one; other columns are not read.
    See ``fit`` for odd vectors.
    """
    model = fit(rows, components, vector_column)
    error = identity_error(rows, model, vector_column)
    k = len(model.variance)
    explained = [None if np.isnan(x) else float(x) for x in model.explained]
    some = rows.select(F.col(id_column).alias("vec_id"), F.col(vector_column).alias("vector")).where(usable(F.col("vector")))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows if k else 0, BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                x = _steps(part.column("vector"), model.width)
                each = pa.array(np.repeat(np.arange(len(x)), k))
                far = pa.array([Decimal(v) if v < 10**38 else None for v in model.deviation(x)], pa.decimal128(38, 0))
                white = model.white(x).ravel()
                yield pa.RecordBatch.from_arrays(
                    [part.column("vec_id").take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(white), model.n)), far.take(each), pa.array(white, from_pandas=True), pa.array(explained * len(x), pa.float64()), pa.array([error] * len(white), pa.float64())],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    kind = some.schema["vec_id"].dataType.simpleString()
    return some.mapInArrow(work, f"vec_id {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")
