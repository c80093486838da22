"""Event-time operators of the ingest stream. Watermarks are an addition of the streaming form; the default is 1 hour."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dedupe_stream(items: DataFrame, key: list[str], time: str, delay: str = "1 hour") -> DataFrame:
    """Each key once while its watermark lasts: a crawl meets a listing again when recency order shifts its pages."""
    return items.withWatermark(time, delay).dropDuplicatesWithinWatermark(key)


def stream_counts(items: DataFrame, keys: list[str], time: str, window: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Items by status per key and tumbling window. Rows later than the watermark are dropped."""
    counted = (
        items.withWatermark(time, delay)
        .groupBy(F.window(time, window).alias("w"), *keys)
        .agg(
            F.count("*").alias("items"),
            F.count_if(F.col("metric_status") == "new").alias("new_items"),
            F.count_if(F.col("metric_status") == "updated").alias("updated_items"),
        )
    )
    return counted.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "items", "new_items", "updated_items")


def open_windows(items: DataFrame, keys: list[str], time: str, window: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """The windows that ``stream_counts`` still holds back when it has read ``items`` (a table) to its end: those the watermark, the
    latest time less ``delay``, has not passed. Together with what the stream gave they are all windows."""
    # Spark keeps event times of the watermark in milliseconds.
    passed = items.agg((F.date_trunc("millisecond", F.max(time)) - F.expr(f"INTERVAL {delay}")).alias("t")).scalar()
    counted = items.groupBy(F.window(time, window).alias("w"), *keys).agg(
        F.count("*").alias("items"),
        F.count_if(F.col("metric_status") == "new").alias("new_items"),
        F.count_if(F.col("metric_status") == "updated").alias("updated_items"),
    )
    return counted.where(F.col("w.end") > passed).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "items", "new_items", "updated_items")
