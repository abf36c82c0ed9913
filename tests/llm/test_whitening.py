"""Whitening against exact fractions and NumPy, with vectors that break plain sums of squares."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorefield.llm.queries import op12_whitening
from lorefield.llm.whitening import Centred, primes_for, residue_scatter, whiten_embeddings, whitening_of

SCHEMA = "vec_id bigint, embedding array<double>"


def lattice(vectors):
    return [[math.floor(64 * float(c)) + 1_000_000 for c in v] for v in vectors]


def exact(x):
    n, d = len(x), len(x[0])
    sums = [sum(v[j] for v in x) for j in range(d)]
    dev = [sum((n * v[j] - sums[j]) ** 2 for j in range(d)) for v in x]
    cov = [[sum((n * v[i] - sums[i]) * (n * v[j] - sums[j]) for v in x) / n**3 for j in range(d)] for i in range(d)]
    return n, sums, dev, np.array(cov)


def check(found, ids, vectors, components=32):
    x = lattice(vectors)
    n, sums, dev, cov = exact(x)
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    by_id = {r.vec_id: r for r in found}
    assert sorted(by_id) == sorted(ids) and {r.n for r in found} == {n}
    assert [int(by_id[i].deviation) for i in ids] == dev
    got = np.array([by_id[i].whitened for i in ids], float)
    centred = np.array([[(n * v - s) / n for v, s in zip(row, sums)] for row in x])
    assert np.allclose(np.abs(got), np.abs(centred @ axes / np.sqrt(values)), atol=1e-7)
    assert np.allclose(found[0].explained, values / np.trace(cov), rtol=1e-9)
    assert np.abs(np.cov(got.T, bias=True) - np.eye(got.shape[1])).max() < 1e-8 and found[0].identity_error < 1e-8


def test_scatter_is_exact_beyond_doubles(spark):
    rnd = random.Random(3)
    rows = [[rnd.randint(-(10**12), 10**12) for _ in range(5)] for _ in range(300)]
    n, sums, scatter = residue_scatter(spark.createDataFrame([(r,) for r in rows], "x array<bigint>").repartition(7), 5, 300 * 10**24)
    assert n == 300 and sums == [sum(r[j] for r in rows) for j in range(5)]
    assert scatter.tolist() == [[sum(r[i] * r[j] for r in rows) for j in range(5)] for i in range(5)]


def test_primes_cover_the_bound():
    for bound in (0, 1, 10**6, 10**30):
        found = primes_for(bound)
        assert len(set(found)) == len(found) >= 2 and math.prod(found) > 2 * bound + 1 and max(found) < 1 << 21


def test_long_deviations_are_exact():
    rows = np.array([[1 << 40, 3], [-(1 << 40), 5], [7, 1 << 41]], np.int64)
    sums = [int(s) for s in rows.astype(object).sum(axis=0)]
    want = [sum((3 * int(v) - s) ** 2 for v, s in zip(row, sums)) for row in rows]
    assert [int(v) for v in Centred(3, sums).deviations(rows).to_pylist()] == want


def test_whitened_rows_equal_numpy(spark):
    rnd = np.random.default_rng(4)
    vectors = (rnd.normal(size=(400, 6)) @ rnd.normal(size=(6, 6)) * [1, 10, 0.5, 3, 100, 1]).tolist()
    df = spark.createDataFrame(list(enumerate(vectors)), SCHEMA).withColumns({"n": F.lit(1), "x": F.lit("a"), "id": F.lit(2)})
    check(whiten_embeddings(df.repartition(5)).collect(), range(400), vectors)
    two = whiten_embeddings(df, components=2).collect()
    assert {len(r.whitened) for r in two} == {2}


def test_odd_vectors_are_left_out(spark):
    rnd = np.random.default_rng(5)
    vectors = rnd.normal(size=(40, 3)).tolist() + [[1.0, 2.0, 3.0]] * 4
    odd = [None, [], [1.0, None, 2.0], [1.0, math.nan, 2.0], [math.inf, 0.0, 0.0], [1.0, 2.0], [1e300, 0.0, 0.0]]
    rows = [(i, v) for i, v in enumerate(vectors)] + [(1000 + i, v) for i, v in enumerate(odd)]
    check(whiten_embeddings(spark.createDataFrame(rows, SCHEMA)).collect(), range(44), vectors)
    repeated = whiten_embeddings(spark.createDataFrame([(None, v) for v in vectors] + [(7, v) for v in vectors], SCHEMA)).collect()
    assert len(repeated) == 88 and sum(r.vec_id is None for r in repeated) == 44


def test_tables_without_variance(spark):
    assert whiten_embeddings(spark.createDataFrame([], SCHEMA)).collect() == []
    flat = whiten_embeddings(spark.createDataFrame([(1, [2.0, 3.0])] * 3, SCHEMA)).collect()
    assert [(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in flat] == [(3, 0, [None, None], [0.0, 0.0], 0.0)] * 3
    line = whiten_embeddings(spark.createDataFrame([(i, [float(i), 5.0]) for i in range(9)], SCHEMA)).collect()
    assert all(r.whitened[0] is not None and r.whitened[1] is None for r in line) and line[0].explained == [1.0, 0.0]
    matrix, shares = whitening_of(1, [3], np.array([[9]], object), 1)
    assert np.isnan(matrix).all() and shares.tolist() == [0.0]


def test_query_has_a_row_for_each_component(spark):
    vectors = {r.vec_id: r.embedding for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()}
    got = op12_whitening(spark, "/root/testdata/sf0.001")
    assert dict(got.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}
    rows = got.collect()
    assert len(rows) == 32 * len(vectors) and {r.component for r in rows} == set(range(1, 33))
    _, _, dev, _ = exact(lattice(vectors.values())) if len(vectors) < 50 else (0, 0, None, 0)
    x = np.array(lattice(vectors.values()), object)
    dev = dict(zip(vectors, ((len(x) * x - x.sum(axis=0)) ** 2).sum(axis=1)))
    assert all(r.deviation == dev[r.vec_id] for r in rows)


@pytest.mark.parametrize("size", [1, 2])
def test_small_tables(spark, size):
    got = whiten_embeddings(spark.createDataFrame([(i, [float(i), -2.0 * i]) for i in range(size)], SCHEMA)).collect()
    assert len(got) == size and got[0].n == size
