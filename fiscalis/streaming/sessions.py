"""Sessions by gaps in event time, in batch and as a stream (an extension of the gap clusters of table words)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Events of a user that follow each other within the gap, as sessions. On a stream, a session is given out once the watermark has passed it."""
    d = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        d = d.withWatermark("ts", late)
    found = d.groupBy("user_id", F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("n_events"))
    return found.select("user_id", F.col("s.start").alias("start"), "n_events")
