import numpy as np
import pytest
from pyspark.sql import functions as F

from linkloom import catalog
from linkloom.operators import blocks, evidence, matrix
from linkloom.storage import stage

from .test_matrix import dense, frame


def shuffled_rows(spark, run):
    """The result of ``run`` and the rows that its stages shuffled."""
    store = spark.sparkContext._jsc.sc().statusStore()

    def total():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
        return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))

    before = total()
    return run(), total() - before


def test_no_shuffle_of_pairs(spark):
    """One key of 300 rows and columns makes 90,000 sums of 600 entries."""
    a, b = frame(spark, np.ones((300, 1))), frame(spark, np.ones((1, 300)))
    n, rows = shuffled_rows(spark, lambda: matrix.product(a, b, 0.5, prune="sum").count())
    assert n == 90_000 and rows < 10_000


@pytest.mark.parametrize("entries, most, batch", [(1 << 21, 1 << 27, 1 << 19), (40, 1 << 27, 7), (12, 60, 1)])
@pytest.mark.parametrize("side", [None, "above", "below"])
def test_sums_of_blocks(spark, entries, most, batch, side):
    """Whatever the blocks and batches are, sums and rows left out together are the product."""
    rng = np.random.default_rng(entries)
    a, b = rng.random((60, 25)) * (rng.random((60, 25)) < 0.3), rng.random((25, 50)) * (rng.random((25, 50)) < 0.3)
    a[7] = 1.0
    left, right = frame(spark, a).toDF("i", "k", "x"), frame(spark, b).toDF("k", "j", "y")
    sums, large = blocks.block_sums(left, right, None, side, entries, most, batch)
    out = {r["i"] for r in large.collect()}
    assert (7 in out) == (entries < 25) and (not out or entries < 40)
    got = {(r["i"], r["j"]): r["s"] for r in sums.collect()}
    keep = {None: lambda i, j: True, "above": lambda i, j: i < j, "below": lambda i, j: i >= j}[side]
    want = {(i, j): (a @ b)[i, j] for i in range(60) for j in range(50) if keep(i, j) and i not in out and ((a[i] > 0) & (b[:, j] > 0)).any()}
    assert got == {p: pytest.approx(v) for p, v in want.items()}


def test_rows_beyond_a_block(spark):
    rng = np.random.default_rng(2)
    a, b = rng.random((20, 30)), rng.random((30, 20))
    a[:10, 5:] = 0
    for lower in (False, True):
        got = dense(matrix.product(frame(spark, a), frame(spark, b), 1.0, 0.5, "sum", lower=lower, block_entries=20), (20, 20))
        want = np.where(a @ b > 1, a @ b / 2, 0)
        assert np.allclose(got, np.tril(want) if lower else want)


def test_odd_entries(spark):
    """Null and negative indices, null values, no entries."""
    a = spark.createDataFrame([(None, 1, 1.0), (-5, 1, 2.0), (3, None, 9.0), (3, 1, None), (9, 2, 1.0), (4, 1, 1.0), (4, 1, 1.0)], "i int, j int, v double")
    b = spark.createDataFrame([(1, None, 1.0), (1, 1 << 40, 3.0), (None, 1, 9.0)], "i bigint, j bigint, v double")
    got = matrix.product(a, b, 0.5, prune="sum")
    assert got.dtypes == [("i", "int"), ("j", "bigint"), ("v", "double")]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([(i, j, x * y) for i, x in ((None, 1.0), (-5, 2.0), (4, 2.0)) for j, y in ((None, 1.0), (1 << 40, 3.0))], key=repr)
    none = stage(a.limit(0), "none")
    assert matrix.product(none, b, prune="sum").count() == matrix.product(a, b.limit(0), prune="sum").count() == 0


@pytest.mark.parametrize("entries", [1 << 21, 2])
def test_evidence_of_all_arrays(spark, entries):
    """Pairs and their common neighbours as sets tell, also where an id has more neighbours than a block."""
    sets = {1: {1, 2, 3}, 2: {2, 3}, 5: {3}, -4: {1, 2, 3, 9}, 7: {8}, 8: set()}
    arrays = stage(spark.createDataFrame([(q, sorted(a)) for q, a in sets.items()], "id int, neighbours array<int>"), "arrays")
    got = evidence.evidence_of_all_arrays(arrays, block_entries=entries)
    assert got.dtypes == [("q1", "int"), ("q2", "int"), ("e", "double")]
    want = [(p, q, 1 - 2.0 ** -len(sets[p] & sets[q])) for p in sets for q in sets if p != q and sets[p] & sets[q]]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_evidence_shuffles_no_pairs(spark, tmp_path):
    """600 lines of 300 customers and two parts make 89,700 ordered pairs."""
    spark.range(300).select(F.col("id").alias("o_orderkey"), F.col("id").alias("o_custkey")).write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(600).select((F.col("id") % 300).alias("l_orderkey"), F.floor(F.col("id") / 300).alias("l_partkey")).write.parquet(f"{tmp_path}/lineitem.parquet")
    n, rows = shuffled_rows(spark, lambda: catalog.QUERIES["evidence_intersect"](spark, str(tmp_path)).count())
    assert n == 89_700 and rows < 20_000
