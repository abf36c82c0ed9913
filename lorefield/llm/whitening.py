"""Whitening of embeddings over an exact scatter matrix held as residues."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow import small_batches

#: Primes start below this; centred residues are below 2**20, so BLOCK_ROWS products sum exactly in a double.
PRIME_BELOW = 1 << 21
BLOCK_ROWS = 4096
#: Whole numbers below this are exact in a long with room for the offset; larger ones have no place in the lattice.
LARGEST = 1 << 61
#: Rows of one step between Arrow and NumPy.
STEP_ROWS = 16_384


def primes_for(bound: int) -> list[int]:
    """The largest primes below PRIME_BELOW whose product exceeds ``2 * bound + 1``; two at least."""
    found, product, p = [], 1, PRIME_BELOW
    while product <= 2 * bound + 1 or len(found) < 2:
        p -= 1
        if all(p % q for q in range(2, int(p**0.5) + 1)):
            found.append(p)
            product *= p
    return found


def lattice(vector: Column, scale: int, offset: int) -> Column:
    """Entries ``floor(scale * c) + offset`` as longs."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * scale).cast("bigint") + offset)


def is_sound(vector: Column, scale: int) -> Column:
    """Not null, not empty, all entries finite and within the lattice."""
    entry = lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double") * scale) < float(LARGEST))
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, entry), F.lit(False))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _sum_rows(rows: DataFrame, modulus: bool) -> list:
    """Lists ``v`` added up by ``(k, i)``, entry by entry and modulo ``k`` if asked.

    Each task adds up the keys it owns as their lists stream in, so it holds one list a key.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for k, i, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), range(batch.num_rows)):
                v = batch.column(2)[at].values.to_numpy(zero_copy_only=False)
                total = sums[k, i] + v if (k, i) in sums else v
                sums[k, i] = total % k if modulus else total
        if sums:
            yield pa.record_batch([pa.array([k for k, _ in sums]), pa.array([i for _, i in sums], pa.int32()), pa.array(list(sums.values()))], ["k", "i", "v"])

    return rows.repartition("k", "i").mapInArrow(add, rows.schema).collect()  # the entries of a matrix of dimensions


def residue_scatter(vectors: DataFrame, d: int, bound: int) -> tuple[int, list[int], np.ndarray]:
    """Count, sums and scatter (``sum x x'``) of whole-number vectors, exactly, as Python integers.

    ``vectors`` has one column of lists of ``d`` longs; ``bound`` is not below any entry
    of the result in size.  Each partition multiplies residues modulo several primes, as
    products of doubles that stay below 2**53; the reduced sums are added modulo the
    primes and put together by Chinese remaindering.  A row of ones among the dimensions
    gives sums and count.  The driver gets ``(d + 1)**2`` residues for each prime.
    """
    primes = primes_for(bound)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {p: np.zeros((d + 1, d + 1), np.int64) for p in primes}
        rows = 0
        for batch in batches:
            rows += batch.num_rows
            for start in range(0, batch.num_rows, BLOCK_ROWS):
                x = _matrix(batch.column(0).slice(start, BLOCK_ROWS), d)
                for p in primes:
                    r = np.ones((len(x), d + 1))
                    r[:, :d] = (x + p // 2) % p - p // 2
                    sums[p] = (sums[p] + (r.T @ r).astype(np.int64)) % p
        if rows:
            flat = [(p, i, row) for p in primes for i, row in enumerate(sums[p])]
            yield pa.record_batch([pa.array([p for p, _, _ in flat]), pa.array([i for _, i, _ in flat], pa.int32()), pa.array([row for _, _, row in flat])], ["k", "i", "v"])

    small_batches(vectors.sparkSession)
    residues = {(r.k, r.i): r.v for r in _sum_rows(vectors.mapInArrow(multiply, "k bigint, i int, v array<bigint>"), True)}
    product = 1
    for p in primes:
        product *= p
    whole = np.zeros((d + 1, d + 1), object)
    for p in primes:
        rest = product // p
        part = np.array([residues[p, i] for i in range(d + 1)] if residues else np.zeros((d + 1, d + 1), int), object)
        whole += part * (rest * pow(rest, -1, p))
    whole %= product
    whole = np.where(whole > product // 2, whole - product, whole)
    return int(whole[d, d]), [int(v) for v in whole[d, :d]], whole[:d, :d]


def whitening_of(n: int, sums: list[int], scatter: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Whitening matrix (dimensions x components) and the shares of variance of the components.

    ``n * scatter - sums sums'`` is exact; only then the covariance becomes doubles.  A
    component whose variance is none up to rounding has a column of NaN.
    """
    d = len(sums)
    centred = n * scatter - np.outer(np.array(sums, object), np.array(sums, object))
    cov = np.array([[c / (n * n) for c in row] for row in centred], float)
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values, kind="stable")[:k]
    values, vectors = values[order], vectors[:, order]
    vectors *= np.where(vectors[np.abs(vectors).argmax(axis=0), range(vectors.shape[1])] < 0, -1.0, 1.0)
    real = values > max(values[0], 0) * d * 4 * np.finfo(float).eps
    trace = float(np.trace(cov))
    shares = np.where(real, values, 0.0) / trace if trace > 0 else np.zeros(len(values))
    return vectors / np.sqrt(np.where(real, values, np.nan)), shares


class Centred:
    """Rows of whole numbers less their mean ``sums / n``: exact deviations, and doubles rounded once."""

    def __init__(self, n: int, sums: list[int]):
        self.n = n
        self.base = np.array([s // n for s in sums], np.int64)
        self.rest = np.array([s % n for s in sums], np.int64)

    def doubles(self, x: np.ndarray) -> np.ndarray:
        return (x - self.base) - self.rest / self.n

    def deviations(self, x: np.ndarray) -> pa.Array:
        """Sums of ``(n * x - sums)**2`` as decimals of 38 digits; null beyond them."""
        near = x - self.base
        reach = (int(np.abs(near).max(initial=0)) + 1) * self.n
        if len(self.base) * reach * reach < 1 << 63:
            return pa.array(((self.n * near - self.rest) ** 2).sum(axis=1)).cast(pa.decimal128(38, 0))
        exact = ((self.n * near.astype(object) - self.rest.astype(object)) ** 2).sum(axis=1)
        return pa.array([Decimal(int(v)) if v < 10**38 else None for v in exact], pa.decimal128(38, 0))


def whiten_embeddings(df: DataFrame, components: int = 32, scale: int = 64, offset: int = 1_000_000, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Projects vectors on their principal components, each with unit variance.

    Entries become whole numbers ``floor(scale * c) + offset``, so that counts, sums and
    scatter are exact however large the table and the offset are (`residue_scatter`); the
    eigenvectors of the covariance are found in double precision on the driver, from
    ``d * d`` numbers.  The table is read four times, never shuffled; what moves are sums.

    Returns a row for each vector: ``id, n, deviation`` (exact sum over dimensions of
    ``(n * x - sums)**2``, a decimal; null beyond 38 digits), ``whitened`` and
    ``explained`` (lists by component, from the largest variance) and
    ``identity_error``, the largest entry of the covariance of all whitened vectors less
    the identity.  Components without variance are null in ``whitened``, with share 0,
    and do not count for the error.

    Vectors that are null or empty, or hold null, non-finite or larger entries than a
    long can hold, are left out; so are those of another length than the most frequent
    one (of equally frequent ones, the longest).  Null and repeated ids and equal vectors
    are kept.  An empty table gives none.  Columns not named are not read.
    """
    spark = df.sparkSession
    schema = "id {}, n bigint, deviation decimal(38,0), whitened array<double>, explained array<double>, identity_error double".format(df.schema[id_col].dataType.simpleString())
    sound = df.where(is_sound(F.col(vector_col), scale)).select(F.col(id_col).alias("id"), lattice(F.col(vector_col), scale, offset).alias("x"))
    most = F.array_max(F.transform("x", lambda v: F.abs(v)))
    first = sound.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n"), F.max(most).alias("most")).orderBy(F.desc("n"), F.desc("d")).first()
    if first is None:
        return spark.createDataFrame([], schema).withColumnRenamed("id", id_col)
    d, k = first.d, min(components, first.d)
    sound = sound.where(F.size("x") == d)
    n, sums, scatter = residue_scatter(sound.select("x"), d, first.n * max(first.most, 1) ** 2)
    matrix, shares = whitening_of(n, sums, scatter, k)
    centred, usable = Centred(n, sums), ~np.isnan(matrix[0])

    def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
        for batch in batches:
            for start in range(0, batch.num_rows, STEP_ROWS):
                part = batch.slice(start, STEP_ROWS)
                yield part, _matrix(part.column("x"), d)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k))
        for _, x in steps(batches):
            w = centred.doubles(x) @ matrix
            total[:k] += w.T @ w
            total[k] += w.sum(axis=0)
        yield pa.record_batch([pa.array([0] * (k + 1), pa.int64()), pa.array(range(k + 1), pa.int32()), pa.array(list(total))], ["k", "i", "v"])

    table = {r.i: np.array(r.v) for r in _sum_rows(sound.mapInArrow(moments, "k bigint, i int, v array<double>"), False)}
    mean = table[k] / n
    cov = np.array([table[i] for i in range(k)]) / n - np.outer(mean, mean)
    error = float(np.abs((cov - np.eye(k))[usable][:, usable]).max(initial=0.0))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in steps(batches):
            w = centred.doubles(x) @ matrix
            flat = pa.array(w.ravel(), mask=np.isnan(w.ravel()))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, w.size + 1, k), pa.int32()), flat)
            yield pa.record_batch([part.column("id"), centred.deviations(x), lists], ["id", "deviation", "whitened"])

    kind = df.schema[id_col].dataType.simpleString()
    out = sound.mapInArrow(project, f"id {kind}, deviation decimal(38,0), whitened array<double>")
    explained = F.array(*(F.lit(float(s)) for s in shares))
    return out.select(F.col("id").alias(id_col), F.lit(n).cast("bigint").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(error).alias("identity_error"))
