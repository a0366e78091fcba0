"""Windows, sessions and deduplication of events with watermarks; a batch frame and a stream go the same way."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, folder: str, schema) -> DataFrame:
    """A stream of Parquet files that land in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(folder)


def _timed(events: DataFrame, late: str) -> DataFrame:
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, event_type, n, total) of each window; rows later than the watermark are left out of a stream."""
    rows = _timed(events, late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return rows.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """(user_id, start, end, n) of runs of a user's events without a gap."""
    rows = _timed(events, late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return rows.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def first_seen(events: DataFrame, keys: list[str], late: str = "2 hours") -> DataFrame:
    """One event of each key within the watermark; state is dropped behind it."""
    rows = _timed(events, late)
    return rows.dropDuplicatesWithinWatermark(keys) if events.isStreaming else rows.dropDuplicates(keys)


def to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """Runs the stream over what is there, exactly once into Parquet, and stops."""
    return stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
