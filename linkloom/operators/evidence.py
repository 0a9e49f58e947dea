"""Evidence of similarity: how many neighbours two queries share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.functions import evidence_of
from linkloom.operators.blocks import BLOCK_ENTRIES, block_sums
from linkloom.operators.matrix import SLICE_ROWS, _sliced
from linkloom.storage import stage


def common_neighbours(edges: DataFrame, slice_rows: int | None = SLICE_ROWS) -> DataFrame:
    """``q1 < q2, n``: ads that both queries share. Clicks do not count; edges are distinct first."""
    pairs = edges.select("a", "q").distinct()
    left, right, on = _sliced(pairs.select("a", F.col("q").alias("q1")), pairs.select("a", F.col("q").alias("q2")), "a", slice_rows)
    return left.join(right, on).filter("q1 < q2").groupBy("q1", "q2").agg(F.count(F.lit(1)).alias("n"))


def evidence(edges: DataFrame, slice_rows: int | None = SLICE_ROWS) -> DataFrame:
    """``q1 < q2, n, e`` with e = 1 - 2^-n."""
    return common_neighbours(edges, slice_rows).select("q1", "q2", "n", evidence_of(F.col("n")).alias("e"))


def evidence_for(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """``q1, q2, n, e`` of the given distinct ``q1, q2`` pairs only; those that share nothing are left out.

    The ads of whichever query has fewer are listed for a pair and looked up among the
    edges of the other, so no list of a popular query travels with its pairs.
    """
    links = edges.select("q", "a").distinct()
    degrees = links.groupBy("q").agg(F.count(F.lit(1)).alias("d"))
    one, two = degrees.select(F.col("q").alias("q1"), F.col("d").alias("d1")), degrees.select(F.col("q").alias("q2"), F.col("d").alias("d2"))
    small = F.col("d1") <= F.col("d2")
    asked = pairs.select("q1", "q2").join(one, "q1").join(two, "q2")
    asked = asked.select("q1", "q2", F.when(small, F.col("q1")).otherwise(F.col("q2")).alias("q"), F.when(small, F.col("q2")).otherwise(F.col("q1")).alias("other"))
    listed = asked.join(links, "q").select("q1", "q2", F.col("other").alias("q"), "a")
    shared = listed.join(links, ["q", "a"], "left_semi").groupBy("q1", "q2").agg(F.count(F.lit(1)).alias("n"))
    return shared.select("q1", "q2", "n", evidence_of(F.col("n")).alias("e"))


def query_pairs(edges: DataFrame, slice_rows: int | None = SLICE_ROWS) -> DataFrame:
    """Distinct ``q1 < q2`` that share an ad."""
    return common_neighbours(edges, slice_rows).select("q1", "q2")


def evidence_of_arrays(pairs: DataFrame, arrays: DataFrame) -> DataFrame:
    """``q1, q2, e`` in both orders for ``q1, q2`` pairs, from ``id, neighbours`` arrays.

    Pairs without common neighbours are left out. Arrays are taken apart, so that pairs
    carry ids and no arrays.
    """
    edges = arrays.select(F.col("id").alias("q"), F.explode("neighbours").alias("a"))
    return _both_orders(evidence_for(pairs, edges))


def evidence_of_all_arrays(arrays: DataFrame, slice_rows: int | None = SLICE_ROWS, block_entries: int = BLOCK_ENTRIES) -> DataFrame:
    """``q1, q2, e`` in both orders for all pairs of ``id, neighbours`` arrays that share a neighbour.

    Pairs are made and their arrays intersected block by block of ids, so that no pair is shuffled; only ids of
    more than ``block_entries`` neighbours, or as many pairs as a block may have, are paired by a join. Ids are whole numbers.
    """
    edges = stage(arrays.select(F.col("id").alias("q"), F.explode("neighbours").alias("a")).distinct(), "array-edges")
    one, two = edges.select(F.col("q").alias("i"), F.col("a").alias("k"), F.lit(1.0).alias("x")), edges.select(F.col("a").alias("k"), F.col("q").alias("j"), F.lit(1.0).alias("y"))
    sums, large = block_sums(one, two, None, "above", block_entries)
    found = sums.select(F.col("i").alias("q1"), F.col("j").alias("q2"), evidence_of(F.col("s")).alias("e"))
    if not large.isEmpty():
        few = edges.join(large, edges.q == large.i, "left_semi").select("a", F.col("q").alias("q1"))
        left, right, on = _sliced(few, edges.select("a", F.col("q").alias("q2")), "a", slice_rows)
        rest = left.join(right, on).filter("q1 < q2").groupBy("q1", "q2").agg(F.count(F.lit(1)).alias("n"))
        found = found.unionByName(rest.select("q1", "q2", evidence_of(F.col("n")).alias("e")))
    return _both_orders(found)


def _both_orders(found: DataFrame) -> DataFrame:
    both = F.explode(F.array(F.struct("q1", "q2"), F.struct(F.col("q2").alias("q1"), F.col("q1").alias("q2")))).alias("p")
    return found.select(both, "e").select("p.q1", "p.q2", "e")
