"""Daily page views over a stream of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read_events(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    """Event files as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def daily_views(events: DataFrame, keys: list[str], late: str = "1 day") -> DataFrame:
    """``day, *keys, pv`` per day of ``ts``; events later than ``late`` are dropped.

    State is one row for each day and key within the watermark.
    """
    day = F.window("ts", "1 day").alias("w")
    counts = events.withWatermark("ts", late).groupBy(day, *keys).agg(F.count(F.lit(1)).alias("pv"))
    return counts.select(F.to_date("w.start").alias("day"), *keys, "pv")


def write_daily(views: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Appends finished days to a table partitioned by day."""
    writer = views.writeStream.outputMode("append").format("parquet").partitionBy("day").option("path", path).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
