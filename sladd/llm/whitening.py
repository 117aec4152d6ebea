"""Whitening of embeddings with exact sums from bit planes.

Entries become integers, ``floor(scale * c)``. A block of rows is shifted so that each dimension starts at 0, and each bit of
each dimension is packed across the rows into 64-bit words. The sum of products of two dimensions is then the sum over their
planes of ``2^(p + q)`` times the number of bits set in both: AND and popcount, without a rounding error whatever the number of
rows. Every task adds its blocks up in Python integers and returns one row a pair of dimensions, which Spark sums as decimals.
The driver gets these sums, ``d * (d + 1) / 2`` of them for ``d`` dimensions, centres them as integers
(``n * sum(x y) - sum(x) * sum(y)``), divides once, and takes the eigenvectors of the covariance. A common offset of the entries,
however large, cancels before anything is rounded.

Cases: vectors that are null or empty, or hold null or non-finite entries are dropped; the dimension is the most frequent
length of the others (the longest of ties), and vectors of another length are dropped, as no covariance is defined for them;
scaled entries beyond 2^60 count as 2^60; repeated rows count each and come back each; a direction without deviation (equal
vectors, or fewer vectors than dimensions) has ``whitened`` and ``explained`` 0 and is left out of the check against the
identity; a deviation of more than 38 digits is null; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from sladd.llm.common import short_batches

#: Rows whose bit planes are packed together.
BLOCK = 1 << 14
#: Sums of products are shuffled in two parts, so that they never outgrow a decimal.
LOW = 1 << 60
PARTS = "i int, j int, high decimal(38,0), low decimal(38,0)"


def is_clean(vector: Column) -> Column:
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~bad


def dimension(vectors: DataFrame, vector: str = "embedding") -> int | None:
    """The most frequent length of the clean vectors, or None where there are none."""
    clean = vectors.filter(is_clean(F.col(vector))).groupBy(F.size(vector).alias("d")).count()
    top = clean.orderBy(F.col("count").desc(), F.col("d").desc()).first()
    return top and top.d


def clean_vectors(vectors: DataFrame, d: int, key: str, vector: str) -> DataFrame:
    fits = F.size(vector) == d
    return short_batches(vectors).filter(is_clean(F.col(vector)) & fits).select(key, F.col(vector).cast("array<double>").alias("vector"))


def integers(column, d: int, scale: float) -> np.ndarray:
    """Rows of an Arrow list column of equal lengths as floored integers."""
    values = np.asarray(column.flatten(), np.float64).reshape(-1, d)
    return np.floor(np.clip(values * scale, -float(LOW), float(LOW))).astype(np.int64)


def bit_planes(y: np.ndarray) -> np.ndarray:
    """``[plane, dimension, word]`` of non-negative integers ``[row, dimension]``."""
    n, d = y.shape
    bits = max(1, int(y.max()).bit_length())
    out = np.zeros((bits, d, -(-n // 64) * 8), np.uint8)
    columns = np.ascontiguousarray(y.T)
    for p in range(bits):
        packed = np.packbits(((columns >> p) & 1).astype(np.uint8), axis=1)
        out[p, :, : packed.shape[1]] = packed
    return out.view(np.uint64)


def cross_products(planes: np.ndarray) -> np.ndarray:
    """``[i, j]``: sums of products of two dimensions, as Python integers."""
    bits, d, _ = planes.shape
    flat = planes.reshape(bits * d, -1)
    both = np.zeros((bits * d, bits * d), np.int64)
    for k in range(bits * d):
        both[k, k:] = np.bitwise_count(flat[k] & flat[k:]).sum(axis=1, dtype=np.int64)
    both = (np.triu(both, 1).T + both).reshape(bits, d, bits, d)
    out = np.zeros((d, d), object)
    for p in range(bits):
        for q in range(bits):
            out += both[p, :, q, :].astype(object) << (p + q)
    return out


def scatter(x: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of rows, sums and sums of products of integer rows, as Python integers."""
    low = x.min(axis=0)
    planes = bit_planes(x - low)
    bits = len(planes)
    ones = np.bitwise_count(planes).sum(axis=2, dtype=np.int64).astype(object)
    y = sum(ones[p] << p for p in range(bits))
    n, low = len(x), low.astype(object)
    products = cross_products(planes) + np.outer(low, y) + np.outer(y, low) + n * np.outer(low, low)
    return n, y + n * low, products


def sums_of(vectors: DataFrame, d: int, key: str, vector: str, scale: float) -> tuple[int, np.ndarray, np.ndarray]:
    """Number, sums and sums of products over all clean rows."""

    def partial(batches):
        n, total, products, waiting, size = 0, np.zeros(d, object), np.zeros((d, d), object), [], 0

        def add():
            nonlocal n, total, products, waiting, size
            if size:
                k, s, c = scatter(np.concatenate(waiting))
                n, total, products, waiting, size = n + k, total + s, products + c, [], 0

        for batch in batches:
            waiting.append(integers(batch.column(1), d, scale))
            size += batch.num_rows
            if size >= BLOCK:
                add()
        add()
        if n:
            rows = [(-1, -1, n), *((i, -1, s) for i, s in enumerate(total)), *((i, j, products[i, j]) for i in range(d) for j in range(i, d))]
            i, j, value = zip(*rows)
            number = pa.decimal128(38, 0)
            high, low = ([f(int(v)) for v in value] for f in (lambda v: v // LOW, lambda v: v % LOW))
            yield pa.record_batch([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(high, number), pa.array(low, number)], names=["i", "j", "high", "low"])

    rows = clean_vectors(vectors, d, key, vector).mapInArrow(partial, PARTS).groupBy("i", "j").agg(F.sum("high").alias("high"), F.sum("low").alias("low"))
    n, total, products = 0, np.zeros(d, object), np.zeros((d, d), object)
    for r in rows.collect():
        value = int(r.high) * LOW + int(r.low)
        if r.i < 0:
            n = value
        elif r.j < 0:
            total[r.i] = value
        else:
            products[r.i, r.j] = products[r.j, r.i] = value
    return n, total, products


@dataclass
class Whitening:
    """Exact moments of the integers, and the directions of the covariance by falling eigenvalue."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray  # one column a direction
    explained: np.ndarray
    scale: float

    @classmethod
    def of(cls, n: int, sums: np.ndarray, products: np.ndarray, components: int, scale: float) -> "Whitening":
        centred = n * products - np.outer(sums, sums)
        covariance = np.array([[int(c) / (n * n) for c in row] for row in centred], np.float64)
        values, vectors = np.linalg.eigh(covariance)
        values, vectors = values[::-1], vectors[:, ::-1]
        flat = values <= max(values[0], 0) * len(values) * np.finfo(float).eps
        values = np.where(flat, 0.0, values)[:components]
        trace = np.trace(covariance)
        return cls(n, sums, values, vectors[:, :components].copy(), values / trace if trace > 0 else values, scale)

    def project(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``n * x - sum`` of integer rows, exact, and their whitened coordinates."""
        low, high = (int(m) for m in (x.min(initial=0), x.max(initial=0)))
        widest = max(abs(self.n * v - int(s)) for v in (low, high) for s in (min(self.sums), max(self.sums)))
        kind = np.int64 if self.n * max(abs(low), abs(high)) < 1 << 62 and widest**2 * len(self.sums) < 1 << 62 else object
        moved = self.n * x.astype(kind) - self.sums.astype(kind)
        safe = np.where(self.values > 0, self.values, 1.0)
        white = (moved / self.n).astype(np.float64) @ self.vectors / np.sqrt(safe)
        return moved, np.where(self.values > 0, white, 0.0)


def fit(vectors: DataFrame, components: int = 32, key: str = "vec_id", vector: str = "embedding", scale: float = 64.0) -> Whitening | None:
    """Directions of all clean vectors; None where there are none."""
    d = dimension(vectors, vector)
    return d and Whitening.of(*sums_of(vectors, d, key, vector, scale), components, scale)


def whiten(vectors: DataFrame, model: Whitening | None, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``key, deviation, whitened``: squared distance from the mean times ``n^2``, exact, and the coordinates by direction."""
    kind = vectors.schema[key].dataType.simpleString()
    schema = f"key {kind}, deviation decimal(38,0), whitened array<double>"
    if model is None:
        return vectors.sparkSession.createDataFrame([], schema).withColumnRenamed("key", key)
    d, k = model.vectors.shape

    def run(batches):
        for batch in batches:
            moved, white = model.project(integers(batch.column(1), d, model.scale))
            deviation = (moved * moved).sum(axis=1)
            if deviation.dtype == object:
                deviation = [v if v < 10**38 else None for v in map(int, deviation)]
            rows = pa.ListArray.from_arrays(pa.array(np.arange(0, (len(white) + 1) * k, k), pa.int32()), pa.array(white.ravel()))
            yield pa.record_batch([batch.column(0), pa.array(deviation).cast(pa.decimal128(38, 0)) if not isinstance(deviation, list) else pa.array(deviation, pa.decimal128(38, 0)), rows],
                                  names=["key", "deviation", "whitened"])

    return clean_vectors(vectors, d, key, vector).mapInArrow(run, schema).withColumnRenamed("key", key)


def identity_error(whitened: DataFrame, model: Whitening | None) -> float | None:
    """Largest absolute entry of the whitened rows' covariance minus the identity, over directions with deviation."""
    if model is None:
        return None
    k = int((model.values > 0).sum())

    def partial(batches):
        total, products = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            w = np.asarray(batch.column(0).flatten(), np.float64).reshape(batch.num_rows, -1)[:, :k]
            total += w.sum(axis=0)
            products += w.T @ w
        i, j = np.indices((k + 1, k)).reshape(2, -1)
        yield pa.record_batch([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(np.vstack([products, total]).ravel())], names=["i", "j", "v"])

    if not k:
        return 0.0
    rows = whitened.select("whitened").mapInArrow(partial, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))
    sums = np.zeros((k + 1, k))
    for r in rows.collect():
        sums[r.i, r.j] = r.v
    mean = sums[k] / model.n
    return float(np.abs(sums[:k] / model.n - np.outer(mean, mean) - np.eye(k)).max())
