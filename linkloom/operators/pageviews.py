"""Daily page-view roll-ups, their accumulation over days, and upkeep of day partitions."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def allowed(views: DataFrame, pids: DataFrame | list[int], column: str = "pid") -> DataFrame:
    """Views of the allowed ids: a list for a few, a frame of one column for many."""
    if isinstance(pids, DataFrame):
        return views.join(pids.select(F.col(pids.columns[0]).alias(column)), column, "left_semi").select(*views.columns)
    return views.filter(F.col(column).isin(list(pids)))


def roll_up(views: DataFrame, keys: list[str], sets: dict[str, list[str]], count: str | None = None) -> DataFrame:
    """``kind, *keys, pv``: counts for each named combination of keys; other keys are null.

    One pass over the views; rows expand to one a combination before the partial
    aggregation. ``count`` sums a column instead of counting rows.
    """
    unknown = {k for s in sets.values() for k in s} - set(keys)
    if unknown:
        raise ValueError(f"unknown keys: {sorted(unknown)}")
    kind = [F.struct(F.lit(name).alias("kind"), *[(F.col(k) if k in chosen else F.lit(None).cast(dict(views.dtypes)[k])).alias(k) for k in keys]) for name, chosen in sets.items()]
    amount = (F.col(count) if count else F.lit(1)).cast("bigint").alias("x")
    return views.select(F.explode(F.array(*kind)).alias("g"), amount).groupBy(*[F.col(f"g.{c}").alias(c) for c in ("kind", *keys)]).agg(F.sum("x").alias("pv"))


def accumulate(daily: DataFrame, keys: list[str], last: date, days: int, min_pv: int = 1) -> DataFrame:
    """``*keys, pv`` summed over the ``days`` days up to ``last``, dropping sums below ``min_pv``.

    The filter on ``day`` prunes partitions of a table that is partitioned by it.
    """
    first = last - timedelta(days=days - 1)
    window = daily.filter((F.col("day") >= F.lit(first)) & (F.col("day") <= F.lit(last)))
    return window.groupBy(*keys).agg(F.sum("pv").alias("pv")).filter(F.col("pv") >= min_pv)


def _folders(spark: SparkSession, path: str) -> dict[str, object]:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return {x.getPath().getName(): x.getPath() for x in fs.listStatus(where)} if fs.exists(where) else {}


def missing_days(spark: SparkSession, path: str, last: date, days: int) -> list[date]:
    """Days up to ``last`` that have no partition under ``path``; the last one is always redone."""
    have = _folders(spark, path)
    every = [last - timedelta(days=n) for n in range(days)]
    return [d for d in every if d == last or f"day={d.isoformat()}" not in have]


def write_days(daily: DataFrame, path: str) -> None:
    """Replaces the partitions of the days in ``daily`` and leaves the others."""
    daily.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def build_days(spark: SparkSession, path: str, last: date, days: int, make) -> list[tuple[date, str]]:
    """Builds what is missing with ``make(day) -> DataFrame``; a failed day is reported, not fatal.

    Returns ``(day, message)`` for the days that failed. ``make``'s frames have a ``day`` column.
    """
    failed = []
    for day in missing_days(spark, path, last, days):
        try:
            write_days(make(day), path)
        except Exception as error:  # a day may be rebuilt the next time
            failed.append((day, f"{type(error).__name__}: {error}".splitlines()[0]))
    return failed


def delete_expired(spark: SparkSession, path: str, today: date, keep_days: int, reach: int = 3) -> list[date]:
    """Deletes the partitions of ``reach`` days from ``keep_days`` days ago back; returns those found."""
    have, gone = _folders(spark, path), []
    for n in range(keep_days, keep_days + reach):
        day = today - timedelta(days=n)
        if found := have.get(f"day={day.isoformat()}"):
            found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(found, True)
            gone.append(day)
    return gone
