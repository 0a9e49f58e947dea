import numpy as np
import pytest
from pyspark.sql import functions as F

from linkloom.operators import matrix


def frame(spark, m):
    rows = [(int(i), int(j), float(m[i, j])) for i, j in zip(*np.nonzero(m))]
    return spark.createDataFrame(rows, "i int, j int, v double")


def dense(df, shape):
    out = np.zeros(shape)
    for r in df.collect():
        out[r["i"], r["j"]] += r["v"]
    return out


CASES = {
    "identity": (np.eye(2), np.eye(2)),
    "two": (np.array([[1.4, 2.5], [3.9, 4.3]]), np.array([[5.1, 6.0], [7.2, 8.8]])),
    "three": (np.arange(1.0, 10).reshape(3, 3), np.arange(1.0, 10).reshape(3, 3).T),
}


@pytest.mark.parametrize("name", CASES)
@pytest.mark.parametrize("prune", ["partial", "sum"])
def test_fixed_products(spark, name, prune):
    a, b = CASES[name]
    got = dense(matrix.product(frame(spark, a), frame(spark, b), prune=prune, float32=False), (len(a), b.shape[1]))
    assert np.allclose(got, a @ b, atol=1e-9)


def test_very_sparse(spark):
    a, b = np.zeros((10, 7)), np.zeros((7, 12))
    a[5, 6], b[6, 7] = 1.6, 8.25
    assert [(r["i"], r["j"], round(r["v"], 6)) for r in matrix.product(frame(spark, a), frame(spark, b), float32=False).collect()] == [(5, 7, 13.2)]


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("slice_rows", [None, 3])
def test_random_products(spark, seed, slice_rows):
    rng = np.random.default_rng(seed)
    n, k, m = rng.integers(10, 30, 3)
    a, b = rng.random((n, k)) * (rng.random((n, k)) < 0.4), rng.random((k, m))
    got = dense(matrix.product(frame(spark, a), frame(spark, b), slice_rows=slice_rows), (n, m))
    assert np.allclose(got, a @ b, atol=1e-4)


def test_pruning_differs(spark):
    a, b = np.array([[0.1, 0.1]]), np.array([[0.1], [0.1]])
    assert matrix.product(frame(spark, a), frame(spark, b), threshold=0.015).count() == 0
    assert matrix.product(frame(spark, a), frame(spark, b), threshold=0.015, prune="sum").count() == 1


def test_self_product_is_lower_with_unit_diagonal(spark):
    p = np.array([[0.5, 0.5], [0.0, 1.0]])
    got = {(r["i"], r["j"]): r["v"] for r in matrix.self_product(frame(spark, p), decay=0.6, float32=False).collect()}
    assert got == {(0, 0): 1.0, (1, 1): 1.0, (1, 0): pytest.approx(0.15)}


def test_expand_transpose_and_bounds(spark):
    m = spark.createDataFrame([(0, 0, 1.0), (2, 1, 0.5)], "i int, j int, v double")
    assert sorted(map(tuple, matrix.expand_symmetric(m).collect())) == [(0, 0, 1.0), (1, 2, 0.5), (2, 1, 0.5)]
    assert sorted(map(tuple, matrix.transpose(m).collect())) == [(0, 0, 1.0), (1, 2, 0.5)]
    assert matrix.drop_diagonal(m).count() == 1 and matrix.lower_triangle(m).count() == 2
    assert matrix.checked_bounds(m, 3, 2).count() == 2
    with pytest.raises(Exception, match="out of bounds"):
        matrix.checked_bounds(m, 2, 2).collect()


def test_empty_product(spark):
    none = spark.createDataFrame([], "i int, j int, v double")
    assert matrix.product(none, none).count() == 0
    assert matrix.drop_zeros(none.withColumn("v", F.lit(0.0))).count() == 0
