"""Structured Streaming forms; an addition to the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """start, event_type, n of each window; state goes once the watermark has passed a window."""
    stream = events.withColumn("_at", F.col("ts").cast("timestamp"))
    stream = stream.withWatermark("_at", late) if events.isStreaming else stream
    grouped = stream.groupBy(F.window("_at", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return grouped.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """user_id, start, finish, n of each session."""
    stream = events.withColumn("_at", F.col("ts").cast("timestamp"))
    stream = stream.withWatermark("_at", late) if events.isStreaming else stream
    grouped = stream.groupBy("user_id", F.session_window("_at", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return grouped.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), F.col("w.end").cast("timestamp_ntz").alias("finish"), "n")
