"""Structured Streaming over event tables: windowed counts and running balances with bounded state.

An extension: windows in event time are the streaming form of binning dates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def timed(events: DataFrame, late: str) -> DataFrame:
    """Event time as a timestamp with a watermark."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def binned(events: DataFrame, every: str = "1 day", late: str = "2 days") -> DataFrame:
    """Counts and sums per bin and type; bins close when the watermark passes them."""
    return timed(events, late).groupBy(F.window("ts", every), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def deduplicated(events: DataFrame, late: str = "2 days") -> DataFrame:
    """Each event_id once, with state only as old as the watermark."""
    return timed(events, late).dropDuplicatesWithinWatermark(["event_id"])


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 days") -> DataFrame:
    return timed(events, late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "user_id", "n")
