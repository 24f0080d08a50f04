"""Whitening of embeddings from a bit-sliced scatter matrix.

Entries become whole numbers. Less their smallest value, the numbers of a dimension are cut into bit planes,
and a plane is packed across the rows into 64-bit words. The sum of products of two dimensions is the sum,
over pairs of their planes, of the common ones times the planes' weights: AND and population count alone. All
sums are whole numbers, also when they are centred: ``n * sum(x * y) - sum(x) * sum(y)`` is exact, and only the
covariance made from it is a double. Its eigenvectors are found on the driver; it holds dimensions squared
numbers, whatever the number of rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Entries are scaled by this and moved by that before they are cut to whole numbers.
SCALE, OFFSET = 64, 1_000_000
#: Scaled entries beyond this, where doubles have no fractions, are taken as this.
LARGEST = float(1 << 53)
#: Rows packed at a time, and bits of one limb of a sum.
PACKED_ROWS, LIMB = 4096, 32
MOST_COMPONENTS = 32


def usable(rows: DataFrame, name: str, vector: str) -> DataFrame:
    """(name, v): the rows whose vector is not null, has no null or non-finite entry and the usual length.

    The usual length is the commonest, the larger of two equally common ones. Empty vectors have none.
    """
    entry_is_fine = F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    held = rows.select(F.col(name), F.col(vector).cast("array<double>").alias("v"))
    held = held.where(F.col("v").isNotNull() & (F.size("v") > 0)).where(entry_is_fine)
    length = held.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return held.where(F.size("v") == (length["d"] if length else 0))


def whole_numbers(batch, column: str = "v"):
    """The vectors of an Arrow batch as a table of 64-bit numbers, a row each."""
    flat = batch.column(column).flatten().to_numpy(zero_copy_only=False)
    scaled = np.clip(np.floor(SCALE * flat), -LARGEST, LARGEST).astype(np.int64) + OFFSET
    return scaled.reshape(batch.num_rows, -1)


def column_figures(rows: DataFrame) -> list:
    """Per dimension, in order: number of rows, smallest, largest, sum. Every task sends one row a dimension."""

    def run(batches):
        import pyarrow as pa

        n, low, high, total = 0, None, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            x = whole_numbers(batch)
            # Halves of the bits, so that no sum of a batch leaves 64 bits.
            sums = [int(a) * (1 << LIMB) + int(b) for a, b in zip((x >> LIMB).sum(axis=0), (x & ((1 << LIMB) - 1)).sum(axis=0))]
            if total is None:
                low, high, total = x.min(axis=0), x.max(axis=0), sums
            else:
                low, high = np.minimum(low, x.min(axis=0)), np.maximum(high, x.max(axis=0))
                total = [a + b for a, b in zip(total, sums)]
            n += len(x)
        if total is not None:
            d = len(total)
            columns = [
                pa.array(range(d), pa.int32()), pa.array([n] * d, pa.int64()), pa.array(low), pa.array(high),
                pa.array([Decimal(t) for t in total], pa.decimal128(38, 0)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["d", "n", "low", "high", "total"])

    per_task = rows.select("v").mapInArrow(run, "d int, n long, low long, high long, total decimal(38,0)")
    return (
        per_task.groupBy("d")
        .agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum("total").alias("total"))
        .orderBy("d")
        .collect()
    )


def bit_planes(y, bits: list[int]):
    """All planes of all dimensions, lowest bit first, packed across the rows: (planes, words).

    ``y`` holds numbers from 0 on; dimension d has ``bits[d]`` planes.
    """
    n = len(y)
    planes = np.zeros((sum(bits), -(-n // 64) * 64), np.uint8)
    at = 0
    for d, count in enumerate(bits):
        shifts = np.arange(count, dtype=np.uint64)
        planes[at : at + count, :n] = (y[:, d].astype(np.uint64)[None, :] >> shifts[:, None]) & np.uint64(1)
        at += count
    return np.packbits(planes, axis=1, bitorder="little").view("<u8")


def cross_products(planes, bits: list[int], sums: list) -> None:
    """Add the products of all pairs of dimensions (first <= second) to ``sums``, one table a limb."""
    shifts = np.concatenate([np.arange(b) for b in bits])
    first = np.concatenate([[0], np.cumsum(bits)])
    for d in range(len(bits)):
        others, starts = planes[first[d] :], first[d:-1] - first[d]
        for p in range(first[d], first[d + 1]):
            common = np.bitwise_count(others & planes[p]).sum(axis=1, dtype=np.int64)
            weight = shifts[first[d] :] + shifts[p]
            for limb in range(int(weight.max()) // LIMB + 1):
                mine = np.where(weight // LIMB == limb, common << (weight % LIMB), 0)
                sums[limb][d, d:] += np.add.reduceat(mine, starts)
    for limb in range(len(sums) - 1):
        sums[limb + 1] += sums[limb] >> LIMB
        sums[limb] &= (1 << LIMB) - 1


def scatter(rows: DataFrame, low: list[int], bits: list[int]):
    """Sums of products of every two dimensions of the rows less ``low``: a table of Python numbers.

    A task sends one row a pair of dimensions, as limbs of 32 bits; they are added up by Spark.
    """
    d = len(low)
    limbs = 2 * max(bits) // LIMB + 2
    names = [f"limb{i}" for i in range(limbs)]

    def run(batches):
        import pyarrow as pa

        sums, least = [np.zeros((d, d), np.int64) for _ in range(limbs)], np.array(low, np.int64)
        for batch in batches:
            if batch.num_rows:
                y = whole_numbers(batch) - least
                for at in range(0, len(y), PACKED_ROWS):
                    cross_products(bit_planes(y[at : at + PACKED_ROWS], bits), bits, sums)
        i, j = np.triu_indices(d)
        columns = [pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), *[pa.array(s[i, j]) for s in sums]]
        yield pa.RecordBatch.from_arrays(columns, names=["i", "j", *names])

    per_task = rows.select("v").mapInArrow(run, "i int, j int, " + ", ".join(f"{c} long" for c in names))
    out = np.zeros((d, d), object)
    totals = per_task.groupBy("i", "j").agg(*[F.sum(F.col(c).cast("decimal(20,0)")).alias(c) for c in names])
    for row in totals.collect():
        out[row["i"], row["j"]] = out[row["j"], row["i"]] = sum(int(row[c]) << (LIMB * k) for k, c in enumerate(names))
    return out


@dataclass
class Whitening:
    """A fit: rows, sums of each dimension, eigenvalues from the largest, unit eigenvectors as columns."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def loadings(self) -> np.ndarray:
        """What projects a centred row; a component without spread gives 0."""
        least = len(self.values) * np.finfo(float).eps * max(self.values.max(initial=0.0), 0.0)
        spread = self.values > least
        scale = np.where(spread, 1 / np.sqrt(np.where(spread, self.values, 1.0)), 0.0)
        return self.vectors * scale


def fit(rows: DataFrame) -> Whitening | None:
    """The whitening of all ``rows`` (column v); None without rows."""
    figures = column_figures(rows)
    if not figures:
        return None
    n, low = figures[0]["n"], [r["low"] for r in figures]
    bits = [max(1, (r["high"] - r["low"]).bit_length()) for r in figures]
    less = scatter(rows, low, bits)
    sums = [int(r["total"]) for r in figures]
    # Sums of the numbers less their smallest; moving a dimension leaves the covariance as it is.
    moved = [s - n * a for s, a in zip(sums, low)]
    d = len(low)
    covariance = np.array([[(n * less[i, j] - moved[i] * moved[j]) / (n * n) for j in range(d)] for i in range(d)], float)
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1], vectors[:, ::-1]
    # Of both signs the one that makes the largest entry positive.
    sign = np.sign(vectors[np.argmax(np.abs(vectors), axis=0), np.arange(d)])
    return Whitening(n, sums, values, vectors * np.where(sign == 0, 1, sign), float(np.trace(covariance)))


def centred(x, fitted: Whitening):
    """``n * x - sums``, exact: 64-bit numbers where they are large enough, else Python's."""
    far = max(abs(s) for s in fitted.sums) + fitted.n * int(np.abs(x).max(initial=0))
    kind = np.int64 if far < 1 << 62 else object
    return x.astype(kind) * fitted.n - np.array(fitted.sums, kind)


def deviations(apart) -> list:
    """Sum of squares of each row, exact; None where it leaves 64 bits."""
    widest = int(np.abs(apart).max(initial=0))
    if apart.dtype == np.int64 and widest * widest * apart.shape[1] < 1 << 63:
        return (apart * apart).sum(axis=1).tolist()
    exact = (apart.astype(object) ** 2).sum(axis=1)
    return [int(e) if e < 1 << 63 else None for e in exact]


def identity_error(rows: DataFrame, fitted: Whitening, count: int) -> float:
    """The largest absolute entry of the covariance of the whitened rows less the identity."""
    loadings = fitted.loadings[:, :count]

    def run(batches):
        import pyarrow as pa

        products, total = np.zeros((count, count)), np.zeros(count)
        for batch in batches:
            if batch.num_rows:
                z = (centred(whole_numbers(batch), fitted) / fitted.n).astype(float) @ loadings
                products += z.T @ z
                total += z.sum(axis=0)
        i, j = np.indices((count, count)).reshape(2, -1).astype(np.int32)
        # Row -1 holds the sums themselves.
        columns = [np.concatenate([i, np.full(count, -1, np.int32)]), np.concatenate([j, np.arange(count, dtype=np.int32)])]
        values = np.concatenate([products.ravel(), total])
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in [*columns, values]], names=["i", "j", "value"])

    added = rows.select("v").mapInArrow(run, "i int, j int, value double").groupBy("i", "j").agg(F.sum("value").alias("value"))
    products, mean = np.zeros((count, count)), np.zeros(count)
    for r in added.collect():
        if r["i"] < 0:
            mean[r["j"]] = r["value"] / fitted.n
        else:
            products[r["i"], r["j"]] = r["value"] / fitted.n
    return float(np.abs(products - np.outer(mean, mean) - np.eye(count)).max())


def whitened(
    rows: DataFrame, name: str = "vec_id", vector: str = "embedding", components: int = MOST_COMPONENTS
) -> DataFrame:
    """(name, component, n, deviation, whitened, explained, identity_error) of every usable row and component.

    Rows whose vector is null, empty, of another than the usual length, or with a null or non-finite entry are
    left out; copies and repeated or null ids each count. Entries too large for exact numbers are taken as the
    largest. A component without spread (a rank below ``components``) is 0 in every row and then counts as an
    error of 1; without any spread ``explained`` is 0. ``deviation`` is null where it leaves 64 bits. A table
    without usable rows gives an empty result; other columns are ignored.
    """
    held = usable(rows, name, vector)
    kind = rows.schema[name].dataType.simpleString()
    schema = f"{name} {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    fitted = fit(held)
    if fitted is None:
        return rows.sparkSession.createDataFrame([], schema)
    count = min(components, len(fitted.sums))
    loadings = fitted.loadings[:, :count]
    explained = fitted.values[:count] / fitted.trace if fitted.trace > 0 else np.zeros(count)
    error = identity_error(held, fitted, count)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            apart = centred(whole_numbers(batch), fitted)
            z = (apart / fitted.n).astype(float) @ loadings
            each = pa.array(np.repeat(np.arange(len(z)), count))
            columns = [
                batch.column(name).take(each),
                pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), len(z))),
                pa.array(np.full(z.size, fitted.n, np.int64)),
                pa.array(deviations(apart), pa.int64()).take(each),
                pa.array(z.ravel()),
                pa.array(np.tile(explained, len(z))),
                pa.array(np.full(z.size, error)),
            ]
            names = [name, "component", "n", "deviation", "whitened", "explained", "identity_error"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return held.mapInArrow(run, schema)
