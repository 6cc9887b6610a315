"""The same rules over streams: idle sessions by event time, retention as a sweep over what is there.

The tables' `ts` has no zone; it is cast before it can carry a watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def idle_sessions(events: DataFrame, late: str = "1 hour", idle: str = "30 minutes") -> DataFrame:
    """Sessions of a user, closed once nothing came for `idle`; events later than `late` are left out."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    window = F.session_window("at", idle)
    return timed.groupBy("user_id", window.alias("s")).agg(F.count("*").alias("events")).select("user_id", F.col("s.start").alias("started"), F.col("s.end").alias("closes"), "events")


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Everything that is there now, written to Parquet; the checkpoint makes a second run carry on after it."""
    stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
