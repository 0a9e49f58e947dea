"""File scans with capped splits, and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def _capped(spark: SparkSession, split_bytes: int | None) -> SparkSession:
    """A session whose scans cut files into splits of at most ``split_bytes``.

    A scan keeps the settings of the session that made it, also inside the plans
    of other sessions of the same application.
    """
    if split_bytes is None:
        return spark
    session = spark.newSession()
    session.conf.set("spark.sql.files.maxPartitionBytes", str(split_bytes))
    session.conf.set("spark.sql.files.openCostInBytes", "0")
    return session


def scan_text(spark: SparkSession, *paths: str, split_bytes: int | None = None) -> DataFrame:
    """Lines of text files (globs allowed) as ``value``; splits of at most ``split_bytes``.

    Compressed files that cannot be split are one split each; empty files give no rows.
    """
    return _capped(spark, split_bytes).read.text(list(paths))


def scan_columns(spark: SparkSession, schema: StructType | str, *paths: str, split_bytes: int | None = None) -> DataFrame:
    """Parquet files (globs allowed) under a declared schema."""
    return _capped(spark, split_bytes).read.schema(schema).parquet(*paths)


def scan_tagged(spark: SparkSession, schema: StructType | str, paths: dict[str, str]) -> DataFrame:
    """Several inputs as one frame with the name of each in ``tag``."""
    parts = [spark.read.schema(schema).parquet(p).withColumn("tag", F.lit(t)) for t, p in paths.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def write_columns(df: DataFrame, path: str, compression: str = "zstd") -> None:
    """Parquet sink; replaces what is there."""
    df.write.mode("overwrite").option("compression", compression).parquet(path)


def write_text(df: DataFrame, path: str, compression: str = "none") -> None:
    """Text sink of the only string column; replaces what is there."""
    df.write.mode("overwrite").option("compression", compression).text(path)


def write_named(frames: dict[str, DataFrame], path: str) -> None:
    """Several results under one folder, each in a sub-folder of its name."""
    for name, df in frames.items():
        write_columns(df, f"{path}/{name}")


def write_single(df: DataFrame, path: str) -> None:
    """All lines in one file, in the frame's order: the download format of small results.

    Everything passes through one task; meant for reports, not for tables.
    """
    df.coalesce(1).write.mode("overwrite").text(path)
