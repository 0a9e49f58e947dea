"""Shared pieces of the training-data operators: tables, word rules, staging."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import zipfile
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.storage import shared_dir, stage, staged_path, unstage

__all__ = ["GAP", "WORD", "frugal", "give_back", "keyed_texts", "shared_dir", "ship", "stage", "staged_path", "table", "text_of", "unstage"]

#: A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


_SHIPPED: set[str] = set()


#: Most rows and bytes of a batch between the JVM and Python, where the session has Spark's
#: defaults: documents are long, and a batch lies in memory on both sides.
BATCHES = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "8192"),
    "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "1048576b"),
}


def ship(spark: SparkSession) -> None:
    """Make this package importable in the executors' Python, once a Spark application, and bound the session's batches."""
    context = spark.sparkContext
    for setting, (default, ours) in BATCHES.items():
        if spark.conf.get(setting) == default:
            spark.conf.set(setting, ours)
    if context.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="linkloom-ship-")) / "linkloom_package.zip"
    with zipfile.ZipFile(target, "w") as archive:
        for path in sorted(root.rglob("*.py")):
            archive.write(path, path.relative_to(root.parent))
    context.addPyFile(str(target))
    _SHIPPED.add(context.applicationId)


@functools.lru_cache(maxsize=1)
def _libc():
    try:
        return ctypes.CDLL("libc.so.6")
    except OSError:  # another C library, which gives back by itself or not at all
        return None


def give_back() -> None:
    """Return freed memory of this Python worker to the system; workers live on after their task."""
    pa.default_memory_pool().release_unused()
    if (libc := _libc()) is not None:
        libc.malloc_trim(0)


def frugal(run):
    """``run``, a function of a task's batches, which gives back memory when the task ends."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the tables as given; also ships the package for what runs on it."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The whole text, with null as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))


def keyed_texts(docs: DataFrame) -> DataFrame:
    """``doc, text, document``: a key that differs for all rows and ascends as ids do, the bytes of the
    text, and all columns of ``docs``.

    The key is the id where ids differ. Else rows are numbered, those without id first, rows that
    share an id by the first 64 bytes of their text and by its hash; a hot id is dealt over tasks.
    """
    doc_id = F.col("doc_id").cast("long")
    texts = docs.select(doc_id.alias("doc"), text_of().cast("binary").alias("text"), F.struct(*[F.col(c) for c in docs.columns]).alias("document"))
    if docs.groupBy(doc_id.alias("id")).count().filter("count > 1 or id is null").isEmpty():
        return texts
    order = ["doc", "head", "hash", "salt"]
    ranged = texts.withColumns({"head": F.substring("text", 1, 64), "hash": F.xxhash64("text"), "salt": F.monotonically_increasing_id()})
    ranged = ranged.repartitionByRange(*order).sortWithinPartitions(*order)
    return stage(ranged.select(F.monotonically_increasing_id().alias("doc"), "text", "document"), "texts")
