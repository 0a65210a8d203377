"""Event windows and latest states on streams; the same expressions as the batch queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, folder: str, files_per_trigger: int = 1, late: str = "1 day") -> DataFrame:
    """Events of the Parquet files that appear in a folder, up to ``late`` out of order; the schema is that of the batch table."""
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder).withColumn("t", F.col("ts").cast("timestamp")).withWatermark("t", late)


def windowed(events: DataFrame, width: str = "6 hours") -> DataFrame:
    """Counts and sums per window and type; events later than the watermark are left out, state is bounded by it."""
    return events.groupBy(F.window("t", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.unix_seconds("w.start").alias("start_s"), "event_type", "n", "total")


def once_each(events: DataFrame) -> DataFrame:
    """Every event once, by its number, within the watermark."""
    return events.dropDuplicatesWithinWatermark(["event_id"])
