"""Vector compression by product codes: small codebooks of integers, trained and applied with annular norm pruning.

A vector's components become integers, floor(scale * x), and are cut into PARTS equal parts. Each part has a codebook of
ENTRIES entries. To find the nearest entry, entries are sorted by norm; the distance to the entry of nearest norm bounds the
norms that a nearer entry can have (the triangle inequality), a binary search gives that interval, and only the entries in it
are compared, exactly. The bound shrinks as nearer entries are found. Distances and sums are whole numbers throughout, so
results don't depend on the order of rows.

What comes to the driver and goes to the tasks is the codebooks alone: ENTRIES rows of a vector's length.

Vectors that are null or hold null, NaN or infinite components are left out. Shorter vectors are filled with zeros up to the
longest one, and that to a multiple of PARTS. Rows of equal vec_id are taken in the order of their components; null ids come
last. Fewer than ENTRIES rows make smaller codebooks, no rows give none. Components too large for 64-bit distances are
worked out in whole numbers of any size. Repeated rows are rows of their own.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywork.llm.common import stored

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Up to this size of components (and 1024 of them a part), squared distances fit 64 bits.
SMALL = 2**25
#: What sums are cut into on their way through Spark, and the digits of one such piece.
DIGITS = 18


def whole(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * v) of finite doubles, exactly: 64-bit where that holds them, else Python's integers."""
    top = float(np.abs(values).max(initial=0.0))
    if top * scale < 2**62:
        return np.floor(values * scale).astype(np.int64)
    return np.array([math.floor(v) * scale if abs(v) >= 2**53 else math.floor(v * scale) for v in values.tolist()], dtype=object)


def kept(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The rows whose vector has finite components only."""
    sound = F.col(vector).isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.where(sound)


def matrix(column: pa.Array, width: int, scale: int) -> np.ndarray:
    """Rows of a list column as integers, filled with zeros up to width."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = whole(np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64), scale)
    if len(lengths) and (lengths == width).all():
        return flat.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width), flat.dtype)
    out[np.repeat(np.arange(len(lengths)), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


@dataclass
class Ring:
    """One part's entries in order of their norms."""

    entries: np.ndarray  # (n, width) in order of norm
    norms: np.ndarray  # doubles
    index: np.ndarray  # place in the codebook

    @classmethod
    def of(cls, entries: np.ndarray) -> Ring:
        norms = norms_of(entries)
        order = np.lexsort((np.arange(len(entries)), norms))
        return cls(entries[order], norms[order], order)


def norms_of(rows: np.ndarray) -> np.ndarray:
    if rows.dtype == object:
        return np.array([math.sqrt(x) if x < 2**1000 else math.inf for x in (rows * rows).sum(1).tolist()], np.float64)
    x = rows.astype(np.float64)
    return np.sqrt(np.einsum("ij,ij->i", x, x))


def distances(rows: np.ndarray, entries: np.ndarray) -> np.ndarray:
    gap = rows - entries
    return (gap * gap).sum(1) if gap.dtype == object else np.einsum("ij,ij->i", gap, gap)


def nearest(rows: np.ndarray, ring: Ring) -> tuple[np.ndarray, np.ndarray, int]:
    """Codebook place and squared distance of the nearest entry of each row (ties to the lower place), and how many distances it took.

    Norms and roots are doubles, so the interval is widened by more than they can be off; what lies in it is compared exactly.
    """
    n, k = len(rows), len(ring.norms)
    norms = norms_of(rows)
    at = np.clip(np.searchsorted(ring.norms, norms), 0, k - 1)
    before = np.maximum(at - 1, 0)
    with np.errstate(invalid="ignore"):
        at = np.where(np.abs(ring.norms[before] - norms) < np.abs(ring.norms[at] - norms), before, at)
    best, place, asked = distances(rows, ring.entries[at]), ring.index[at].copy(), n
    seen_low, seen_high = at.copy(), at.copy()
    live = np.arange(n)
    while len(live):
        reach = np.sqrt(best[live].astype(np.float64)) if best.dtype != object else np.array([math.sqrt(x) if x < 2**1000 else math.inf for x in best[live].tolist()])
        with np.errstate(invalid="ignore"):
            slack = reach + (norms[live] + reach + 1.0) * 1e-12
            low, high = np.searchsorted(ring.norms, norms[live] - slack, "left"), np.searchsorted(ring.norms, norms[live] + slack, "right") - 1
            huge = ~np.isfinite(norms[live]) | ~np.isfinite(reach)
        low, high = np.where(huge, 0, low), np.where(huge, k - 1, high)
        down, up = seen_low[live] > low, seen_high[live] < high
        for side, step, seen in ((down, -1, seen_low), (up, 1, seen_high)):
            who = live[side]
            if not len(who):
                continue
            seen[who] += step
            j = seen[who]
            d, p = distances(rows[who], ring.entries[j]), ring.index[j]
            asked += len(who)
            better = (d < best[who]) | ((d == best[who]) & (p < place[who]))
            best[who[better]], place[who[better]] = d[better], p[better]
        live = live[down | up]
    return place, best, asked


def added(rows: np.ndarray, place: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows of each place, exact: the doubles of a batch of small integers stay below 2^53."""
    out = np.zeros((n, rows.shape[1]), object)
    if rows.dtype == object:
        np.add.at(out, place, rows)
        return out
    at = place[:, None] * rows.shape[1] + np.arange(rows.shape[1])
    return np.bincount(at.ravel(), rows.ravel(), n * rows.shape[1]).astype(np.int64).reshape(out.shape).astype(object)


def cut(sums: list[int]) -> list[list[int]]:
    """Whole numbers of any size as rows of pieces of DIGITS decimal digits, least first, all of one sign."""
    out, rest, base = [], [abs(x) for x in sums], 10**DIGITS
    signs = [-1 if x < 0 else 1 for x in sums]
    while True:
        out.append([s * (x % base) for s, x in zip(signs, rest, strict=True)])
        rest = [x // base for x in rest]
        if not any(rest):
            return out


Codebooks = list[list[list[int]]]  # part, entry, component


def widths(vectors: DataFrame, vector: str, parts: int) -> int:
    longest = vectors.agg(F.max(F.size(vector)).alias("n")).first()["n"] or 0
    return -(-longest // parts) * parts


def begun(vectors: DataFrame, width: int, key: str, vector: str, scale: int, parts: int, entries: int) -> Codebooks:
    """Each part of the first vectors by id."""
    first = vectors.orderBy(F.col(key).asc_nulls_last(), vector).limit(entries).select(F.col(vector).cast("array<double>").alias(vector)).collect()
    rows = [[math.floor(v) * scale if abs(v) >= 2**53 else math.floor(v * scale) for v in r[vector]] + [0] * (width - len(r[vector])) for r in first]
    size = width // parts
    return [[r[p * size : (p + 1) * size] for r in rows] for p in range(parts)]


def rings(codebooks: Codebooks) -> list[Ring]:
    top = max((abs(x) for part in codebooks for e in part for x in e), default=0)
    return [Ring.of(np.array(part, np.int64 if top <= SMALL else object).reshape(len(part), len(part[0]) if part else 0)) for part in codebooks]


def fitting(x: np.ndarray, known: list[Ring]) -> np.ndarray:
    """x as 64-bit integers where distances fit them, else as Python's."""
    small = x.dtype != object and np.abs(x).max(initial=0) <= SMALL and x.shape[1] <= 1024 * len(known) and all(r.entries.dtype != object for r in known)
    return x if small else x.astype(object)


def moved(vectors: DataFrame, codebooks: Codebooks, width: int, vector: str, scale: int) -> Codebooks:
    """The codebooks after one round: each entry the floor of the mean of the parts nearest to it; unused entries stay."""
    known, parts, entries, size = rings(codebooks), len(codebooks), len(codebooks[0]), width // len(codebooks)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((parts, entries, size), object), np.zeros((parts, entries), np.int64)
        for b in batches:
            x = fitting(matrix(b.column(0), width, scale), known)
            for p in range(parts):
                own = x[:, p * size : (p + 1) * size]
                place, _, _ = nearest(own, known[p])
                counts[p] += np.bincount(place, minlength=entries)
                sums[p] += added(own, place, entries)
        rows = [(p, e, k, piece, int(counts[p, e]) if k == 0 else 0) for p in range(parts) for e in range(entries) if counts[p, e] for k, piece in enumerate(cut([int(v) for v in sums[p, e]]))]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.int64()), strict=True)], ["part", "entry", "piece", "sums", "n"])

    found = vectors.select(F.col(vector).cast("array<double>").alias(vector)).mapInArrow(summed, "part int, entry int, piece int, sums array<long>, n long")
    # At most PARTS x ENTRIES x a vector's length of rows: a task sends no more than its codebooks.
    each = found.select("part", "entry", "piece", "n", F.posexplode("sums").alias("at", "v")).groupBy("part", "entry", "piece", "at").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v"), F.sum("n").alias("n"))
    out = [[list(e) for e in part] for part in codebooks]
    totals: dict[tuple[int, int], list[int]] = {}
    count: dict[tuple[int, int], int] = {}
    for r in each.collect():
        totals.setdefault((r["part"], r["entry"]), [0] * size)[r["at"]] += int(r["v"]) * 10 ** (DIGITS * r["piece"])
        if r["piece"] == 0:
            count[r["part"], r["entry"]] = r["n"]
    for (p, e), t in totals.items():
        out[p][e] = [x // count[p, e] for x in t]
    return out


def trained(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: int = SCALE, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[Codebooks, int]:
    """Codebooks after rounds of assignment and means over all kept rows, and the width of their vectors."""
    width = widths(vectors, vector, parts)
    codebooks = begun(vectors, width, key, vector, scale, parts, entries)
    for _ in range(rounds if codebooks[0] else 0):
        codebooks = moved(vectors, codebooks, width, vector, scale)
    return codebooks, width


def sha256_of(codebooks: Codebooks) -> str:
    return hashlib.sha256(",".join(str(x) for part in codebooks for e in part for x in e).encode()).hexdigest()


def coded(vectors: DataFrame, codebooks: Codebooks, width: int, vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """Adds code (two hex digits a part) and error (squared distances summed over parts) to the other columns of kept rows.

    error is null where it exceeds 64 bits.
    """
    known, parts, size = rings(codebooks), len(codebooks), width // len(codebooks)
    others = [c for c in vectors.columns if c not in (vector, "code", "error")]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.select(*others).schema)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = fitting(matrix(b.column(len(others)), width, scale), known)
            error, places = np.zeros(len(x), object), np.zeros((len(x), parts), np.uint8)
            for p in range(parts if len(x) else 0):
                place, best, _ = nearest(x[:, p * size : (p + 1) * size], known[p])
                places[:, p] = place
                error = error + best
            text = [r.tobytes().hex() for r in places]
            whole_ = [int(e) if int(e) < 2**63 else None for e in error.tolist()]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(others)], pa.array(text, pa.string()), pa.array(whole_, pa.int64())], [*others, "code", "error"])

    return vectors.select(*others, F.col(vector).cast("array<double>").alias(vector)).mapInArrow(code, f"{kinds}, code string, error long")


def compressed(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """key, code, error, label_error, codebooks_sha256 of each kept row.

    label_error sums error over equal labels, nulls together. Codes are stored, summed by label and joined with the sums by
    label: two plain exchanges, so adaptive execution can split a label that holds many rows.
    """
    rows = stored(kept(vectors, key, vector).select(F.col(key), F.col(label), F.col(vector).cast("array<double>").alias(vector)), "vectors")
    codebooks, width = trained(rows, key, vector)
    codes = stored(coded(rows, codebooks, width, vector), "codes")
    sums = codes.groupBy(F.col(label).alias("_label")).agg(F.sum("error").alias("label_error"))
    every = codes.join(sums, F.col(label).eqNullSafe(F.col("_label")))
    return every.select(key, "code", "error", "label_error", F.lit(sha256_of(codebooks)).alias("codebooks_sha256"))
