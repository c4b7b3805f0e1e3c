"""Embedding whitening by spectrum slicing.

The covariance of the distinct quantised vectors is summed as exact integers
around the rounded means, so it is the exact covariance rounded once.  Inertia
counts of LDL^T factors of the shifted covariance (Bunch-Kaufman pivots) isolate
each of the leading eigenvalues in an interval of its own, Rayleigh quotient
iteration converges in it, and counts on both sides of the limit certify the
number.  Only sums of d x d entries reach the driver; d is the vectors' length.

Cases: vectors that are null or hold null or non-finite entries are dropped, so
are those of another length than the most common one (of equally common lengths
the greatest); quantised entries beyond 2**61 in size are set to that bound; a
``deviation`` beyond 64 bits is null; repeated rows are returned each; components
without variance (fewer distinct vectors than dimensions, constant entries) are
left out, as they cannot be whitened; an empty table gives no rows; columns but
``vec_id`` and ``embedding`` are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagemill.session import materialize

SCALE = 64
OFFSET = 1_000_000
WIDE = 1 << 61
COMPONENTS = 16
EXACT = 1 << 53  # integers below are exact in double precision
LIMB = 32
LIMBS = 6
BATCH = 1 << 13  # vectors multiplied together
WHITENED = (
    "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
)


def quantised(vectors: DataFrame) -> DataFrame:
    """``vec_id`` and ``x`` of all usable rows, whatever their length."""
    entries = F.transform("embedding", lambda c: c.cast("double"))
    whole = F.forall("_c", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    size = float(WIDE) / SCALE
    x = F.transform("_c", lambda c: F.floor(F.lit(SCALE) * F.greatest(F.least(c, F.lit(size)), F.lit(-size))).cast("long") + OFFSET)
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), entries.alias("_c")).where(
        F.col("_c").isNotNull() & F.coalesce(whole, F.lit(False))
    ).select("vec_id", x.alias("x"))


def matrix(batch: pa.RecordBatch, name: str, width: int) -> np.ndarray:
    column = batch.column(batch.schema.get_field_index(name))
    return np.asarray(column.flatten(), dtype=np.int64).reshape(len(column), width)


def exact_sums(df: DataFrame, add: Callable, cells: int) -> list[int]:
    """Sums of whole numbers of any size over all batches: ``add(batch)`` gives ``cells`` integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cells, dtype=object)
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                total += add(batch.slice(at, BATCH))
        used = [c for c in range(cells) if total[c]]
        limbs = [[(int(total[c]) >> (LIMB * k)) & ((1 << LIMB) - 1) if k < LIMBS - 1 else int(total[c]) >> (LIMB * k) for c in used] for k in range(LIMBS)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(used, pa.int64()), *(pa.array(one, pa.int64()) for one in limbs)],
            names=["cell", *(f"l{k}" for k in range(LIMBS))],
        )

    names = [f"l{k}" for k in range(LIMBS)]
    parts = df.mapInArrow(run, ", ".join(["cell long", *(f"{n} long" for n in names)]))
    out = [0] * cells
    for row in parts.groupBy("cell").agg(*(F.sum(n).alias(n) for n in names)).collect():  # one row a cell
        out[row["cell"]] = sum(row[n] << (LIMB * k) for k, n in enumerate(names))
    return out


def inertia(matrix: np.ndarray, shift: float) -> tuple[int, int]:
    """Numbers of positive and negative eigenvalues of ``matrix - shift`` by LDL^T with Bunch-Kaufman pivots."""
    a = matrix - shift * np.eye(len(matrix))
    growth = (1 + math.sqrt(17)) / 8
    positive = negative = k = 0

    def swap(i: int, j: int) -> None:
        if i != j:
            a[[i, j]] = a[[j, i]]
            a[:, [i, j]] = a[:, [j, i]]

    while k < len(a):
        below = np.abs(a[k + 1 :, k])
        most = float(below.max()) if len(below) else 0.0
        pivot, single = abs(a[k, k]), True
        if max(pivot, most) == 0.0:
            k += 1
            continue
        if pivot < growth * most:
            r = k + 1 + int(below.argmax())
            row = np.abs(a[r, k:])
            row[r - k] = 0.0
            wide = float(row.max())
            if pivot * wide >= growth * most * most:
                pass
            elif abs(a[r, r]) >= growth * wide:
                swap(k, r)
            else:
                swap(k + 1, r)
                single = False
        if single:
            d = a[k, k]
            positive, negative = positive + (d > 0), negative + (d < 0)
            column = a[k + 1 :, k].copy()
            a[k + 1 :, k + 1 :] -= np.outer(column / d, column)
            k += 1
        else:
            e = a[k : k + 2, k : k + 2].copy()
            if e[0, 0] * e[1, 1] - e[0, 1] * e[1, 0] < 0:
                positive, negative = positive + 1, negative + 1
            elif e[0, 0] + e[1, 1] > 0:
                positive += 2
            else:
                negative += 2
            block = a[k + 2 :, k : k + 2].copy()
            a[k + 2 :, k + 2 :] -= block @ np.linalg.solve(e, block.T)
            k += 2
    return positive, negative


class Slicer:
    """Leading eigenpairs of a symmetric matrix, each isolated and certified by counts."""

    def __init__(self, matrix: np.ndarray):
        self.matrix = matrix
        radius = np.abs(matrix).sum(axis=1)
        self.norm = float(radius.max()) if len(matrix) else 0.0
        self.grain = 4 * np.finfo(float).eps * self.norm * max(len(matrix), 8)
        self.counts = {-self.norm - self.grain: len(matrix), self.norm + self.grain: 0}

    def above(self, shift: float) -> int:
        if shift not in self.counts:
            self.counts[shift] = inertia(self.matrix, shift)[0]
        return self.counts[shift]

    def isolate(self, number: int, width: float = math.inf) -> tuple[float, float]:
        """An interval of at most ``width`` that holds the eigenvalue of that number and no other, unless they are closer than rounding."""
        low = max(s for s, n in self.counts.items() if n >= number)
        high = min((s for s, n in self.counts.items() if n < number and s > low), default=self.norm + self.grain)
        while high - low > self.grain and (self.above(low) != number or self.above(high) != number - 1 or high - low > width):
            middle = (low + high) / 2
            if self.above(middle) >= number:
                low = middle
            else:
                high = middle
        return low, high

    def solve(self, shift: float, right: np.ndarray) -> np.ndarray:
        """One step of inverse iteration; an exact eigenvalue as shift is moved by rounding."""
        for move in (0.0, self.grain / 8, self.grain):
            try:
                out = np.linalg.solve(self.matrix - (shift + move) * np.eye(len(self.matrix)), right)
            except np.linalg.LinAlgError:
                continue
            if np.isfinite(out).all() and (length := float(np.linalg.norm(out))) > 0:
                return out / length
        return right

    def pair(self, number: int, found: list[np.ndarray]) -> tuple[float, np.ndarray]:
        """Eigenvalue and unit vector of that number (from 1, falling), orthogonal to those found."""
        basis = np.array(found).reshape(len(found), len(self.matrix))

        def clear(v: np.ndarray) -> np.ndarray:
            for _ in range(2):
                v = v - basis.T @ (basis @ v)
            return v / max(float(np.linalg.norm(v)), np.finfo(float).tiny)

        low, high = self.isolate(number)
        while True:
            start = np.random.default_rng(number).standard_normal(len(self.matrix))
            v = clear(self.solve((low + high) / 2, clear(start)))
            v = clear(self.solve((low + high) / 2, v))
            best = (math.inf, 0.0, v)
            for _ in range(12):
                image = self.matrix @ v
                value = float(v @ image)
                rest = float(np.linalg.norm(image - value * v))
                if rest >= best[0]:
                    break
                best = (rest, value, v)
                v = clear(self.solve(value, v))
            _, value, v = best
            inside = low - self.grain <= value <= high + self.grain
            if inside and self.above(value - 2 * self.grain) >= number and self.above(value + 2 * self.grain) < number:
                return value, v
            if high - low <= self.grain:  # closer than rounding: numbers within the cluster are free
                return value, v
            low, high = self.isolate(number, (high - low) / 4)

    def leading(self, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Values and vectors (rows) of up to ``most`` eigenvalues that differ from zero."""
        values: list[float] = []
        vectors: list[np.ndarray] = []
        for number in range(1, min(most, len(self.matrix)) + 1) if self.norm else ():
            value, vector = self.pair(number, vectors)
            if value <= 4 * self.grain:
                break
            values.append(value)
            vectors.append(vector)
        return np.array(values), np.array(vectors).reshape(len(vectors), len(self.matrix))


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """Each usable row on the leading components, scaled to unit variance."""
    spark = vectors.sparkSession
    every = quantised(vectors)
    lengths = every.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    none = spark.createDataFrame([], WHITENED)
    if lengths is None or not lengths["d"]:
        return none
    d = int(lengths["d"])
    rows = every.where(F.size("x") == d)
    fit = materialize(rows.select("x").distinct(), "fit_list")

    def add_up(batch: pa.RecordBatch) -> np.ndarray:
        x = matrix(batch, "x", d)
        sums = (x >> 31).sum(axis=0).astype(object) * (1 << 31) + (x & ((1 << 31) - 1)).sum(axis=0).astype(object)
        return np.r_[sums, np.array([len(x)], dtype=object)]

    *sums, n = exact_sums(fit, add_up, d + 1)
    middle = [(2 * s + n) // (2 * n) for s in sums]  # rounded means
    offset = [n * m - s for s, m in zip(sums, middle)]
    centre = np.array(middle, dtype=np.int64)

    def multiply(batch: pa.RecordBatch) -> np.ndarray:
        z = matrix(batch, "x", d) - centre
        most = int(np.abs(z).max()) if z.size else 0
        if most * most * len(z) < EXACT:
            own = z.astype(float)
            return (own.T @ own).astype(np.int64).astype(object).ravel()
        own = z.astype(object)
        return own.T.dot(own).ravel()

    squares = exact_sums(fit, multiply, d * d)
    # n^2 V = n * sum(z z') - sum(z) sum(z)', with sum(z) = -offset; rounded once
    covariance = np.array([
        float(Fraction(n * squares[i * d + j] - offset[i] * offset[j], n * n)) for i in range(d) for j in range(d)
    ]).reshape(d, d)
    values, axes = Slicer(covariance).leading(components)
    if not len(values):
        return none
    shift = np.array([float(Fraction(o, n)) for o in offset])
    projection = (axes / np.sqrt(values)[:, None]).T
    trace = float(sum((Fraction(n * squares[i * d + i] - offset[i] ** 2, n * n) for i in range(d)), Fraction(0)))
    k = len(values)

    def project(x: np.ndarray) -> np.ndarray:
        return ((x - centre).astype(float) + shift) @ projection

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k))
        for batch in batches:
            own = project(matrix(batch, "x", d))
            total[:k] += own.T @ own
            total[k] += own.sum(axis=0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["cell", "amount"]
        )

    found = np.zeros((k + 1) * k)
    for cell, amount in fit.mapInArrow(moments, "cell long, amount double").groupBy("cell").agg(F.sum("amount")).collect():
        found[cell] = amount
    found = found.reshape(k + 1, k) / n
    error = float(np.abs(found[:k] - np.outer(found[k], found[k]) - np.eye(k)).max())
    explained = values / trace
    rest = np.array(offset, dtype=object)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH):
                batch = whole.slice(at, BATCH)
                x = matrix(batch, "x", d)
                z = x - centre
                most = n * (int(np.abs(z).max() if z.size else 0) + 1)
                kind = np.int64 if most * most * d < 1 << 63 else object
                apart = ((n * z.astype(kind) + rest.astype(kind)) ** 2).sum(axis=1).tolist()
                apart = [v if v < 1 << 63 else None for v in apart]
                rows = len(x)
                again = np.repeat(np.arange(rows), k)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(again)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                        pa.array(np.full(rows * k, n, np.int64)), pa.array(apart, pa.int64()).take(pa.array(again)),
                        pa.array(project(x).ravel()), pa.array(np.tile(explained, rows)), pa.array(np.full(rows * k, error)),
                    ],
                    names=[f.split()[0] for f in WHITENED.split(", ")],
                )

    return rows.mapInArrow(describe, WHITENED)
