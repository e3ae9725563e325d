"""Embedding whitening from bit-sliced scatter sums.

Vectors become whole numbers ``x = floor(scale * c)``. The fit list holds every
distinct ``x`` vector once; it is made by one ``distinct`` (partial before the
shuffle, so a vector that many rows share is no hot key) and written as a table.

Scatter. A task takes some thousand vectors at a time, subtracts each dimension's
least value among them and packs every bit of every dimension across the rows into
64-bit words, one bit plane each. The cross-product of two dimensions is the sum
over pairs of planes of ``2 ** (a + b)`` times the ones in their AND; with the
shifts added back in whole numbers this is exact whatever the data. Tasks send
``d * (d + 1) / 2`` sums in limbs of 40 bits, which Spark adds up; the driver gets
that many rows, a number that does not grow with the vectors.

Components. The covariance ``(n * X'X - S S') / n ** 2`` is formed in whole numbers,
divided once, and given to ``eigh``. A second pass over the fit list measures the
covariance of the whitened coordinates; its distance from the identity is reported.

Edge cases: vectors that are null or hold null, NaN or infinite entries take no
part, and neither do those of another length than the most frequent one (of
equally frequent lengths, the longest), nor empty ones. Rows that repeat an id, a
vector or both, and null ids, each give their own result rows. With fewer than
four dimensions there are as many components. A component without variance
(eigenvalue under ``d * 2 ** -50`` of the largest) has a null ``whitened`` and is
left out of ``identity_error``; without any variance ``explained`` and
``identity_error`` are null. Values beyond 64 bits saturate; ``deviation`` is null
beyond 38 digits. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelode.llm.common import written

LIMB, LIMBS = 40, 5
CELLS = 1 << 20  # numbers of a batch that are expanded at a time
DIGITS = 10 ** 38


@dataclass
class Fit:
    """What the fit list gives: count, sums, components (columns), eigenvalues, shares of the variance."""

    n: int
    sums: list[int]
    largest: int
    axes: np.ndarray
    values: np.ndarray
    explained: list[float | None]
    identity_error: float | None = None


def quantised(vectors: DataFrame, scale: int) -> DataFrame:
    """vec_id, x (array<bigint>) of the rows that take part."""
    bad = F.exists("embedding", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = vectors.select("vec_id", "embedding").where(F.col("embedding").isNotNull() & (F.size("embedding") > 0)).where(~bad)
    rows = rows.select("vec_id", F.transform("embedding", lambda c: F.floor(c.cast("double") * scale).cast("bigint")).alias("x"))
    best = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.where(F.size("x") == (best["d"] if best else 0))


def planes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least value of each dimension, and the bit planes (dimension, bit, word) of what is left above it."""
    low = x.min(0)
    rest = np.ascontiguousarray((x.view(np.uint64) - low.view(np.uint64)).T)
    bits = max(int(rest.max()).bit_length(), 1)
    out = np.zeros((len(rest), bits, -(-x.shape[0] // 64) * 8), np.uint8)
    for b in range(bits):
        packed = np.packbits((rest >> np.uint64(b) & np.uint64(1)).astype(bool), axis=1)
        out[:, b, :packed.shape[1]] = packed
    return low, out.view(np.uint64)


def scatter(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact sums of each dimension and of each product of two dimensions (upper triangle), as Python integers."""
    low, sliced = planes(x)
    d, bits, words = sliced.shape
    rows = x.shape[0]
    small = 2 * bits + rows.bit_length() < 62
    weight = np.array([1 << b for b in range(bits)], np.int64 if small else object)
    above = np.bitwise_count(sliced).sum(2, dtype=np.int64).astype(weight.dtype) @ weight
    cross = np.zeros((d, d), weight.dtype)
    for i in range(d):
        for a in range(bits):
            ones = np.bitwise_count(sliced[i:] & sliced[i, a]).sum(2, dtype=np.int64)
            cross[i, i:] += (ones.astype(weight.dtype) @ weight) * (1 << a)
    low, above, cross = low.astype(object), above.astype(object), cross.astype(object)
    cross = cross + np.outer(low, above) + np.outer(above, low) + rows * np.outer(low, low)
    return above + rows * low, np.triu(cross)


def _matrices(batches: Iterator[pa.RecordBatch], column: str = "x") -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Parts of the batches with their vectors as a matrix; all vectors of a table have one length."""
    for batch in batches:
        if batch.num_rows:
            d = len(batch.column(column)[0])
            step = max(CELLS // d, 64)
            for first in range(0, batch.num_rows, step):
                part = batch.slice(first, step)
                yield part, part.column(column).flatten().to_numpy().reshape(part.num_rows, d)


def _limbs(value: int) -> list[int]:
    out = []
    for _ in range(LIMBS - 1):
        out.append(value & ((1 << LIMB) - 1))
        value >>= LIMB
    return [*out, value]


def _moments(rows: DataFrame) -> tuple[int, list[int], list[list[int]]]:
    """Count, sums and products of the vectors."""
    names = [f"l{i}" for i in range(LIMBS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, cross = 0, None, None
        for _, x in _matrices(batches):
            s, c = scatter(x)
            n, sums, cross = n + len(x), s if sums is None else sums + s, c if cross is None else cross + c
        if n:
            d = len(sums)
            found = [(-2, -2, n)] + [(-1, i, int(sums[i])) for i in range(d)] + [(i, j, int(cross[i, j])) for i in range(d) for j in range(i, d)]
            limbs = list(zip(*(_limbs(v) for _, _, v in found)))
            yield pa.RecordBatch.from_arrays([
                pa.array([f[0] for f in found], pa.int32()), pa.array([f[1] for f in found], pa.int32()), *(pa.array(x, pa.int64()) for x in limbs),
            ], ["i", "j", *names])

    parts = rows.select("x").mapInArrow(run, "i int, j int, " + ", ".join(f"{x} long" for x in names))
    cells = parts.groupBy("i", "j").agg(*(F.sum(x).alias(x) for x in names)).collect()  # d * (d + 3) / 2 + 1 rows
    value = {(c.i, c.j): sum(c[x] << (LIMB * k) for k, x in enumerate(names)) for c in cells}
    if not value:
        return 0, [], []
    d = sum(i == -1 for i, _ in value)
    return value[-2, -2], [value[-1, i] for i in range(d)], [[value[min(i, j), max(i, j)] for j in range(d)] for i in range(d)]


def fit(rows: DataFrame, components: int = 4) -> Fit:
    """Components of the distinct vectors of ``rows`` (x)."""
    listed = written(rows.select("x").distinct(), "vectors")
    n, sums, cross = _moments(listed)
    d, k = len(sums), min(components, len(sums))
    if not n:
        return Fit(0, [], 0, np.zeros((0, 0)), np.zeros(0), [])
    whole = [[n * cross[i][j] - sums[i] * sums[j] for j in range(d)] for i in range(d)]
    cov = np.array([[v / (n * n) for v in row] for row in whole])
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1][:k], axes[:, ::-1][:, :k]
    trace = sum(whole[i][i] for i in range(d)) / (n * n)
    values = np.where(values > max(values[0], 0) * d * 2.0 ** -50, values, 0.0)
    largest = isqrt(max(cross[i][i] for i in range(d))) + 1
    found = Fit(n, sums, largest, axes, values, [float(v / trace) if trace else None for v in values])
    found.identity_error = _identity_error(listed, found)
    return found


def _centred(x: np.ndarray, fit: Fit) -> np.ndarray:
    """``n * x - S`` exactly."""
    small = fit.n * (2 * fit.largest) < 2 ** 62
    return x * fit.n - np.array(fit.sums, np.int64) if small else x.astype(object) * fit.n - np.array(fit.sums, object)


def _projected(centred: np.ndarray, fit: Fit) -> np.ndarray:
    z = (centred / fit.n).astype(float) @ fit.axes
    return np.divide(z, np.sqrt(fit.values), out=np.full(z.shape, np.nan), where=fit.values > 0)


def _identity_error(rows: DataFrame, fit: Fit) -> float | None:
    use = np.flatnonzero(fit.values > 0)
    if not len(use):
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(use) + 1, len(use)))
        for _, x in _matrices(batches):
            w = _projected(_centred(x, fit), fit)[:, use]
            total += np.vstack([w.sum(0), w.T @ w])
        yield pa.RecordBatch.from_arrays([pa.array(range(total.size), pa.int32()), pa.array(total.ravel())], ["at", "v"])

    sums = rows.mapInArrow(run, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).orderBy("at").collect()
    total = np.array([r.v for r in sums]).reshape(len(use) + 1, len(use)) / fit.n
    return float(np.abs(total[1:] - np.outer(total[0], total[0]) - np.eye(len(use))).max())


def deviations(centred: np.ndarray) -> list[int]:
    """Exact sum of squares of each row."""
    if centred.dtype == object:
        return [int(v) for v in (centred * centred).sum(1)]
    size = np.abs(centred)
    most = int(size.max(initial=0))
    if most * most * centred.shape[1] < 2 ** 63:
        return (centred * centred).sum(1).tolist()
    a, b, c = size & 0x1FFFFF, size >> 21 & 0x1FFFFF, size >> 42
    parts = [(a * a).sum(1), 2 * (a * b).sum(1), (2 * a * c + b * b).sum(1), 2 * (b * c).sum(1), (c * c).sum(1)]
    return [sum(v << (21 * k) for k, v in enumerate(row)) for row in zip(*(p.tolist() for p in parts))]


def whiten(vectors: DataFrame, scale: int = 256, components: int = 4) -> DataFrame:
    """vec_id, component, n, deviation (decimal), whitened, explained, identity_error: one row per vector and component."""
    rows = quantised(vectors, scale)
    model = fit(rows, components)
    k = len(model.values)
    kind = rows.schema["vec_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _matrices(batches):
            centred = _centred(x, model)
            far = [Decimal(v) if v < DIGITS else None for v in deviations(centred)]
            m = len(x)
            take = pa.array(np.repeat(np.arange(m), k))
            yield pa.RecordBatch.from_arrays([
                part.column("vec_id").take(take), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, model.n)),
                pa.array(far, pa.decimal128(38, 0)).take(take), pa.array(_projected(centred, model).ravel(), from_pandas=True),
                pa.array(model.explained * m, pa.float64()), pa.array([model.identity_error] * (m * k), pa.float64()),
            ], ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(
        run, f"vec_id {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    )
