"""Signals that arrive over time: events to hourly demodulated samples, late ones within a bound."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import signals


def demodulated(events: DataFrame, delay: str = "1 hour", width: str = "1 hour") -> DataFrame:
    """Stream or table (ts, n, phase, y) to (n, window, re, im). On a stream a window is final once the watermark has passed it."""
    timed = events.withWatermark("ts", delay).withColumn("window", F.window("ts", width))
    return signals.demodulate(timed, ["n", "window"])


def run_available(stream: DataFrame, target: str, checkpoint: str) -> None:
    """Process what is there, append the final windows to Parquet, stop; the next call goes on from the checkpoint."""
    query = stream.select("n", F.col("window.start").alias("start"), "re", "im").writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(target)
    query.awaitTermination()
