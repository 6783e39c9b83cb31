"""Monitoring over event time, for streams and tables alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sessions(events: DataFrame, key: str, time: str, gap: str, late: str = "1 hour") -> DataFrame:
    """Runs of a key's events that are less than ``gap`` apart: key, start, stop (last event plus gap), n.

    On a stream, events later than ``late`` behind the watermark are dropped and a session is given out once closed.
    """
    s = events.withWatermark(time, late).groupBy(key, F.session_window(time, gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return s.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")


def first_updates(stream: DataFrame, keys: list[str], time: str, late: str = "1 day") -> DataFrame:
    """Element sets once each: repeats of ``keys`` within the watermark are dropped (streams; on a table, all repeats)."""
    if stream.isStreaming:
        return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)
    return stream.dropDuplicates(keys)
