"""Joins of several sorted inputs, sorts, and checks of row counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkloom.storage import stage


def join_many(frames: list[DataFrame], key: str, how: str = "inner") -> DataFrame:
    """Joins frames ``key, value`` on ``key``: columns ``key, value_1, value_2, ...``.

    ``how``: "inner", "outer" (all keys), or "override" (all keys, one column
    ``value`` from the last frame that has the key). Keys join bucketed or sorted
    inputs without a shuffle where Spark finds them so.
    """
    if not frames:
        raise ValueError("at least one input is needed")
    if how not in ("inner", "outer", "override"):
        raise ValueError("how must be 'inner', 'outer' or 'override'")
    marked = [f.select(key, F.struct(F.col("value")).alias(f"s{n}")) for n, f in enumerate(frames, 1)]
    joined = reduce(lambda x, y: x.join(y, key, "inner" if how == "inner" else "full"), marked)
    if how == "override":
        # The struct tells a null value from a missing key.
        return joined.select(key, F.coalesce(*[f"s{n}" for n in range(len(frames), 0, -1)])["value"].alias("value"))
    return joined.select(key, *[F.col(f"s{n}")["value"].alias(f"value_{n}") for n in range(1, len(frames) + 1)])


def sort_partitions(df: DataFrame, *keys: str, partitions: int | None = None) -> DataFrame:
    """Rows dealt by hash of the keys and sorted inside each partition."""
    dealt = df.repartition(partitions, *keys) if partitions else df.repartition(*keys)
    return dealt.sortWithinPartitions(*keys)


def sort_total(df: DataFrame, *keys: str, partitions: int | None = None) -> DataFrame:
    """Rows in one order over all partitions, by sampled ranges."""
    if partitions:
        return df.repartitionByRange(partitions, *keys).sortWithinPartitions(*keys)
    return df.orderBy(*keys)


def with_ordinal(df: DataFrame, *keys: str) -> DataFrame:
    """Adds ``ordinal``, the 1-based place in the order of the keys, without a one-task sort.

    Ranges are sorted apart; each adds the sizes of the ranges before it, of which
    there is one row a partition.
    """
    ranges = sort_total(df, *keys, partitions=df.sparkSession.sparkContext.defaultParallelism).withColumn("pid", F.spark_partition_id())
    ranges = ranges.withColumn("n", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    ranges = stage(ranges, "ordinal")
    sizes = ranges.groupBy("pid").agg(F.count(F.lit(1)).alias("size"))
    before = Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("pid", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base"))
    return ranges.join(bases, "pid").withColumn("ordinal", F.col("base") + F.col("n") + 1).drop("pid", "n", "base")


def row_counts(frames: dict[str, DataFrame], least: dict[str, int]) -> DataFrame:
    """``name, rows, least, ok`` for every named frame."""
    parts = [f.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("name"), "rows", F.lit(least.get(n, 0)).cast("bigint").alias("least")) for n, f in frames.items()]
    return reduce(DataFrame.unionByName, parts).withColumn("ok", F.col("rows") >= F.col("least"))


def require_rows(frames: dict[str, DataFrame], least: dict[str, int]) -> None:
    """Raises if a frame has fewer rows than asked for."""
    if bad := row_counts(frames, least).filter("not ok").collect():
        raise ValueError("too few rows: " + ", ".join(f"{r['name']} has {r['rows']} of {r['least']}" for r in bad))
