"""Whitening of vectors from an exact covariance: digit-slice products of integer matrices.

Components become integers, floor(SCALE * c) + OFFSET. Each integer is split into limbs of BITS bits; the product of two limb
matrices is a float64 matrix product (BLAS) of numbers so small that every partial sum is a whole number below 2^53, hence
exact. Limb products are recombined as Python's integers, so sums over all rows, sums of products and the covariance
n * sum(x y) - sum(x) * sum(y) are exact at any size; only the last division rounds. Sums are merged by Spark in pieces that
fit a long. The driver gets one row a pair of dimensions (and piece), whatever the number of vectors, and decomposes it.

Vectors that are null or hold null, NaN or infinite entries are left out. Shorter vectors are filled with zeros up to the
longest one. Components whose variance is nothing but rounding (fewer rows than dimensions, equal rows) have no unit variance
to be scaled to and are left out, so n rows give less than n components, and no rows or equal rows give none.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywork.llm.codes import DIGITS, cut, kept, matrix

SCALE, OFFSET, COMPONENTS = 1024, 100_000, 8
#: Bits of a limb, and rows in one product: 2 * BITS and the bits of ROWS are 53 at most.
BITS, ROWS = 16, 2**20
#: A variance below this share of the largest is rounding.
NOISE = 1e-13
PRIME = 2**31 - 1


def limbs(x: np.ndarray) -> list[np.ndarray]:
    """x = sum of limb k << (BITS * k), as doubles; the last limb has the sign."""
    out, rest = [], x
    while True:
        if len(rest) == 0 or (np.abs(rest) < 2**BITS).all():
            return [*out, rest.astype(np.float64)]
        out.append((rest & (2**BITS - 1)).astype(np.float64))
        rest = rest >> BITS


def product(x: np.ndarray) -> np.ndarray:
    """x^T x of an integer matrix, as Python's integers."""
    total = np.zeros((x.shape[1], x.shape[1]), object)
    for at in range(0, len(x), ROWS):
        cut_ = limbs(x[at : at + ROWS])
        for i, a in enumerate(cut_):
            for j in range(i, len(cut_)):
                g = (a.T @ cut_[j]).astype(np.int64).astype(object) << (BITS * (i + j))
                total = total + (g if i == j else g + g.T)
    return total


@dataclass
class Moments:
    """Rows, sums by dimension and sums of products, all exact."""

    n: int
    sums: list[int]
    products: list[list[int]]

    def covariance(self) -> list[list[int]]:
        """n^2 times the covariance (divisor n), exact."""
        return [[self.n * p - a * b for p, b in zip(row, self.sums, strict=True)] for row, a in zip(self.products, self.sums, strict=True)]


def moments(vectors: DataFrame, width: int, vector: str = "embedding") -> Moments:
    """Exact moments of all rows: each task multiplies its batches with a column of ones beside them, Spark adds the tasks' results."""
    side = width + 1

    def multiplied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((side, side), object)
        for b in batches:
            x = integers(b.column(0), width)
            total = total + product(np.hstack([x, np.ones((len(x), 1), x.dtype)]))
        rows = [(i, k, piece) for i in range(side) for k, piece in enumerate(cut([int(v) for v in total[i, i:]]))] if total[-1, -1] else []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.list_(pa.int64())), strict=True)], ["i", "piece", "sums"])

    found = vectors.select(F.col(vector).cast("array<double>").alias(vector)).mapInArrow(multiplied, "i int, piece int, sums array<long>")
    each = found.select("i", "piece", F.posexplode("sums").alias("at", "v")).groupBy("i", "piece", "at").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v"))
    total = [[0] * side for _ in range(side)]
    for r in each.collect():
        i, j = r["i"], r["i"] + r["at"]
        total[i][j] += int(r["v"]) * 10 ** (DIGITS * r["piece"])
        total[j][i] = total[i][j]
    return Moments(total[-1][-1], total[-1][:-1], [row[:-1] for row in total[:-1]])


def integers(column: pa.Array, width: int) -> np.ndarray:
    x = matrix(column, width, SCALE)
    return x + OFFSET


def rank(m: list[list[int]]) -> int:
    """Rank of an integer matrix modulo a prime: never above the true one, and below it with a chance of about 1 in PRIME."""
    a = np.array([[x % PRIME for x in row] for row in m], np.int64).reshape(len(m), -1)
    r = 0
    for c in range(a.shape[1]):
        rows = np.flatnonzero(a[r:, c])
        if not len(rows):
            continue
        p = r + int(rows[0])
        a[[r, p]] = a[[p, r]]
        a[r] = a[r] * pow(int(a[r, c]), PRIME - 2, PRIME) % PRIME
        below = a[r + 1 :]
        below -= below[:, c : c + 1] * a[r] % PRIME
        below %= PRIME
        r += 1
        if r == len(a):
            break
    return r


@dataclass
class Basis:
    """What whitens a row: moments, unit eigenvectors (columns) by falling eigenvalue, those eigenvalues, the trace."""

    moments: Moments
    vectors: np.ndarray
    values: np.ndarray
    trace: float


def decomposed(m: Moments, components: int = COMPONENTS) -> Basis:
    """Eigenvectors of the covariance; it is scaled by its largest entry, so no size of numbers overflows."""
    scaled, n = m.covariance(), m.n
    top = max((abs(x) for row in scaled for x in row), default=0)
    if not top:
        return Basis(m, np.zeros((len(scaled), 0)), np.zeros(0), 0.0)
    values, vectors = np.linalg.eigh(np.array([[x / top for x in row] for row in scaled]))
    order = np.argsort(-values, kind="stable")[: min(components, rank(scaled))]
    order = order[values[order] > NOISE * values.max()]
    unit = float(Fraction(top, n * n))
    return Basis(m, vectors[:, order], values[order] * unit, float(Fraction(sum(scaled[i][i] for i in range(len(scaled))), n * n)))


def centred(x: np.ndarray, m: Moments) -> np.ndarray:
    """n x - sum(x), exact: in 64 bits where they hold it."""
    top = int(np.abs(x).max(initial=0)) * m.n + max((abs(s) for s in m.sums), default=0)
    return x.astype(np.int64) * m.n - np.array(m.sums, np.int64) if top < 2**62 else x.astype(object) * m.n - np.array(m.sums, object)


def deviations(y: np.ndarray) -> list[int]:
    """Sum of squares of each row, exact."""
    if y.dtype != object and int(np.abs(y).max(initial=0)) ** 2 * max(y.shape[1], 1) < 2**63:
        return np.einsum("ij,ij->i", y, y).tolist()
    return [int(v) for v in (y.astype(object) * y.astype(object)).sum(1)] if y.shape[1] else [0] * len(y)


def projected(y: np.ndarray, basis: Basis) -> np.ndarray:
    return np.array(y / basis.moments.n if y.dtype != object else [[float(Fraction(v, basis.moments.n)) for v in row] for row in y.tolist()], np.float64).reshape(len(y), -1) @ (basis.vectors / np.sqrt(basis.values))


def identity_error(vectors: DataFrame, basis: Basis, width: int, vector: str = "embedding") -> float:
    """Largest entry, in size, of the covariance of all whitened rows less the identity; 0 where there is no component."""
    k = len(basis.values)

    def squared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k + 1))
        for b in batches:
            w = projected(centred(integers(b.column(0), width), basis.moments), basis)
            total += w.T @ np.hstack([w, np.ones((len(w), 1))])
        yield pa.RecordBatch.from_arrays([pa.array(total.ravel().tolist(), pa.float64()), pa.array(range(k * (k + 1)), pa.int32())], ["v", "at"])

    if not k:
        return 0.0
    found = vectors.select(F.col(vector).cast("array<double>").alias(vector)).mapInArrow(squared, "v double, at int").groupBy("at").agg(F.sum("v").alias("v"))
    total = np.zeros(k * (k + 1))
    for r in found.collect():
        total[r["at"]] = r["v"]
    total = total.reshape(k, k + 1) / basis.moments.n
    return float(np.abs(total[:, :k] - np.outer(total[:, k], total[:, k]) - np.eye(k)).max())


ROWS_OUT = "component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_exact string"


def fitted(vectors: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> tuple[Basis, int]:
    """The basis of all rows of vectors, which are kept ones, and their width."""
    width = vectors.agg(F.max(F.size(vector)).alias("n")).first()["n"] or 0
    return decomposed(moments(vectors, width, vector), components), width


def whitened(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """key and ROWS_OUT, a row for each kept vector and component.

    deviation is null where it exceeds 64 bits; deviation_exact has all its digits.
    """
    rows = kept(vectors.select(key, F.col(vector).cast("array<double>").alias(vector)), key, vector)
    basis, width = fitted(rows, vector, components)
    error, k = identity_error(rows, basis, width, vector), len(basis.values)
    explained = (basis.values / basis.trace).tolist() if k else []

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y = centred(integers(b.column(1), width), basis.moments)
            far, w = deviations(y), projected(y, basis) if k else np.zeros((len(y), 0))
            again = lambda x: np.repeat(np.array(x, object), k)
            columns = [
                b.column(0).take(pa.array(np.repeat(np.arange(len(y)), k))), pa.array(np.tile(np.arange(1, k + 1), len(y)), pa.int32()), pa.array(np.full(len(y) * k, basis.moments.n), pa.int64()), pa.array(again([v if v < 2**63 else None for v in far]), pa.int64()),
                pa.array(w.ravel(), pa.float64()), pa.array(np.tile(explained, len(y)), pa.float64()), pa.array(np.full(len(y) * k, error), pa.float64()), pa.array(again([str(v) for v in far]), pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, [key, *[c.split()[0] for c in ROWS_OUT.split(", ")]])

    return rows.mapInArrow(write, f"`{key}` {rows.schema[key].dataType.simpleString()}, {ROWS_OUT}")
