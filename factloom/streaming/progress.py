"""Incremental work as Structured Streaming: resumable counts of arriving records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def arriving(spark: SparkSession, folder: str, schema: str, *, files: int = 100) -> DataFrame:
    """New Parquet files of a folder as a stream, so many files at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def windowed(events: DataFrame, *, late: str = "1 hour", width: str = "1 hour") -> DataFrame:
    """Counts and sums by window and type; records later than `late` are dropped, windows close behind the watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def unseen(events: DataFrame, *, late: str = "1 hour") -> DataFrame:
    """Each record once, by id, within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def append_to(stream: DataFrame, folder: str, checkpoint: str, *, mode: str = "append"):
    """Runs over all that has arrived and stops; a later call goes on where this one ended."""
    return stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
