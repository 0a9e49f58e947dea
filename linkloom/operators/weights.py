"""Click statistics of nodes and the two transition-weight matrices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.functions import rounded, spread_of


def filter_clicks(edges: DataFrame, least: int) -> DataFrame:
    """Edges of at least ``least`` clicks. Zero clicks have no weight and never stay."""
    return edges.filter((F.col("clicks") >= least) & (F.col("clicks") > 0))


def node_stats(edges: DataFrame, node: str, single: bool = False) -> DataFrame:
    """``node, n, total, spread``: edges, sum of clicks, and e^-variance of the clicks of a node."""
    sums = edges.groupBy(node).agg(F.count(F.lit(1)).alias("n"), F.sum("clicks").alias("total"), F.sum(F.col("clicks") * F.col("clicks")).alias("squares"))
    return sums.select(node, "n", "total", spread_of(F.col("n"), F.col("total"), F.col("squares"), single).alias("spread"))


def max_ids(edges: DataFrame) -> DataFrame:
    """``max_q, max_a`` in one row; null for no edges. Dimensions are these plus one."""
    return edges.agg(F.max("q").alias("max_q"), F.max("a").alias("max_a"))


def weight_matrix(edges: DataFrame, row: str, column: str, single: bool = False) -> DataFrame:
    """``i, j, v``: spread of the row node times the share of the column node's clicks.

    ``row="a", column="q"`` is the ads-by-queries matrix, the other way round the
    queries-by-ads one. ``single``: shares, variances and weights are single-precision numbers.
    """
    rows = node_stats(edges, row, single).select(row, "spread")
    columns = node_stats(edges, column).select(column, "total")
    joined = edges.join(columns, column).join(rows, row)
    value = F.col("spread") * rounded(F.col("clicks").cast("double") / F.col("total"), single)
    return joined.select(F.col(row).alias("i"), F.col(column).alias("j"), value.cast("float" if single else "double").alias("v"))


def both_weights(edges: DataFrame) -> DataFrame:
    """``q, a, a2q, q2a``: the weights of both matrices, from one pass over the edges."""
    q = node_stats(edges, "q").select("q", F.col("total").alias("total_q"), F.col("spread").alias("spread_q"))
    a = node_stats(edges, "a").select("a", F.col("total").alias("total_a"), F.col("spread").alias("spread_a"))
    clicks = F.col("clicks").cast("double")
    return edges.join(q, "q").join(a, "a").select("q", "a", (F.col("spread_a") * (clicks / F.col("total_q"))).alias("a2q"), (F.col("spread_q") * (clicks / F.col("total_a"))).alias("q2a"))
