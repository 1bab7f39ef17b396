"""An extra beside the batch engine: worker heartbeats as a stream, counted by event-time window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_beats(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """window start, worker_id, beats, mean value of a stream (ts, user_id, value); later than `late` is dropped."""
    agg = events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), F.col("user_id").alias("worker_id"))
    return agg.agg(F.count("*").alias("beats"), F.max("ts").alias("last_ts")).select(F.col("w.start").alias("start"), "worker_id", "beats", "last_ts")
