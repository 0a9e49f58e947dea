"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage, unstage


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
    return row["n"], row["h"]


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``(node, root)`` for every node of ``(u, v)`` long edges; root is the smallest node reachable.

    Each round links the larger neighbours of a node to its smallest neighbour,
    then the smaller ones; the number of edges never grows and the rounds are
    few (the square of the logarithm of a component at most). Minima are partial
    aggregates, so a hub costs no task its whole neighbourhood; each round ends
    in a written table. Raises if ``most_rounds`` don't suffice. Empty in, empty
    out; self links are ignored.
    """
    edges = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = stage(edges, "links")
    before = _state(edges)
    for _ in range(most_rounds if before[0] else 0):
        both = edges.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.col("v").alias("y")), F.struct(F.col("v").alias("x"), F.col("u").alias("y")))).alias("e")).select("e.*")
        lowest = both.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("m"))
        large = both.filter("y > x").join(lowest, "x").select(F.col("y").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = stage(large, "links-large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        after = stage(small.select("e.*").filter("u <> v").distinct(), "links-small")
        unstage(edges, large)
        edges, state = after, _state(after)
        if state == before:
            break
        before = state
    else:
        if before[0]:
            raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
