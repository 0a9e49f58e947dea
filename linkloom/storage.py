"""Barriers between stages: tables written to the folder that all executors share."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Setting by which Spark deletes the shuffle files of a query when it ends.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only where the session names none and its executors are threads of this process a
    temporary one is set; on a cluster that is an error.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="linkloom-")
        spark.conf.set("spark.checkpoint.dir", base)
        atexit.register(remove, spark, base)
    return base.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder; a stopped session or a missing folder is no error."""
    jsc = spark.sparkContext._jsc
    if jsc is None:
        return
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(jsc.hadoopConfiguration()).delete(where, True)


_FOLDERS: set[str] = set()


def staged_path(spark: SparkSession, name: str) -> str:
    """A new path in the application's folder, which goes when the driver's JVM ends."""
    folder = f"{shared_dir(spark)}/linkloom/{spark.sparkContext.applicationId}"
    if folder not in _FOLDERS:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        files.mkdirs(where)
        files.deleteOnExit(where)
        _FOLDERS.add(folder)
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str, path: str | None = None, **options: str) -> DataFrame:
    """Write ``df`` to the shared folder, or to ``path``, and read it back.

    Cuts lineage: what follows survives lost executors without recomputing
    what went before, and sees one fixed version of the rows.
    """
    spark = df.sparkSession
    path = path or staged_path(spark, name)
    # What the rows were shuffled through is of no use once they are written.
    before = spark.conf.get(CLEAN_UP, "false")
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.mode("overwrite").options(**options).parquet(path)
    finally:
        spark.conf.set(CLEAN_UP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


def unstage(*frames: DataFrame) -> None:
    """Delete staged tables that nothing reads any more."""
    for df in frames:
        if path := getattr(df, "_staged_path", None):
            remove(df.sparkSession, path)
