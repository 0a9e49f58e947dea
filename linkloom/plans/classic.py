"""Classic similarity of the nodes of a directed graph by their in-neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.storage import stage, unstage


def classic_simrank(links: DataFrame, damping: float = 0.8, iterations: int = 5, denominator: str = "sum") -> DataFrame:
    """``x >= y, s``: similarity of node pairs of ``src, dst`` edges of positive weight; x = y has 1.

    s(x, y) = damping / d * sum of s(i, j) over in-neighbours i of x and j of y,
    where d is the sum of their numbers, or their product with
    ``denominator="product"``. Each sweep uses the values of the one before; pairs
    without a similar pair of in-neighbours have no row and count as 0. The sum
    runs over joins of similar pairs with edges, so unrelated pairs cost nothing.
    """
    if denominator not in ("sum", "product"):
        raise ValueError("denominator must be 'sum' or 'product'")
    edges = links.filter("dst is not null")
    edges = edges.filter("weight > 0") if "weight" in edges.columns else edges
    edges = stage(edges.select("src", "dst").distinct(), "graph")
    fans = edges.groupBy("dst").agg(F.count(F.lit(1)).alias("n"))
    ids = edges.select(F.explode(F.array("src", "dst")).alias("x")).distinct()
    same = ids.select(F.col("x"), F.col("x").alias("y"), F.lit(1.0).alias("s"))
    now = stage(same, "classic")
    one, two = edges.select(F.col("src").alias("x"), F.col("dst").alias("u")), edges.select(F.col("src").alias("y"), F.col("dst").alias("w"))
    n_u, n_w = fans.select(F.col("dst").alias("u"), F.col("n").alias("n_u")), fans.select(F.col("dst").alias("w"), F.col("n").alias("n_w"))
    count = (F.col("n_u") + F.col("n_w")) if denominator == "sum" else F.col("n_u") * F.col("n_w")
    for _ in range(iterations):
        turned = F.when(F.col("x") != F.col("y"), F.array(F.struct("x", "y"), F.struct(F.col("y").alias("x"), F.col("x").alias("y")))).otherwise(F.array(F.struct("x", "y")))
        whole = now.select(F.explode(turned).alias("p"), "s").select("p.x", "p.y", "s")
        sums = whole.join(one, "x").join(two, "y").filter("u > w").groupBy("u", "w").agg(F.sum("s").alias("t"))
        new = sums.join(n_u, "u").join(n_w, "w").select(F.col("u").alias("x"), F.col("w").alias("y"), (F.lit(damping) * F.col("t") / count).alias("s"))
        after = stage(new.unionByName(same), "classic")
        unstage(now)
        now = after
    return now


def similarity_of(similar: DataFrame, pairs: DataFrame) -> DataFrame:
    """``x, y, s`` for asked pairs in any order; 1 for a node and itself, 0 where nothing is stored."""
    keys = pairs.select("x", "y", F.greatest("x", "y").alias("hi"), F.least("x", "y").alias("lo"))
    stored = similar.select(F.col("x").alias("hi"), F.col("y").alias("lo"), "s")
    s = F.when(F.col("x") == F.col("y"), F.lit(1.0)).otherwise(F.coalesce("s", F.lit(0.0)))
    return keys.join(stored, ["hi", "lo"], "left").select("x", "y", s.alias("s"))


def similar_to(similar: DataFrame, node) -> DataFrame:
    """``y, s`` of everything similar to one node, itself left out."""
    off = similar.filter("x <> y")
    rows = off.filter((F.col("x") == node) | (F.col("y") == node))
    return rows.select(F.when(F.col("x") == node, F.col("y")).otherwise(F.col("x")).alias("y"), "s")
