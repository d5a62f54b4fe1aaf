"""Streaming bars: event-time windows with a watermark, and upserts of late corrections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.sinks import upsert_partitions


def tumbling_bars(events: DataFrame, size: str = "1 hour", late: str = "1 hour", time: str = "ts", symbol: str = "event_type", value: str = "value", order: str = "event_id") -> DataFrame:
    """Open, high, low, close and count of a value per symbol and window; works on streams and tables."""
    at = F.struct(time, order)
    rows = events.withWatermark(time, late) if events.isStreaming else events
    bars = rows.groupBy(F.window(time, size), F.col(symbol).alias("symbol")).agg(F.min_by(value, at).alias("open"), F.max(value).alias("high"), F.min(value).alias("low"), F.max_by(value, at).alias("close"), F.count(F.lit(1)).alias("volume"))
    return bars.select(F.col("window.start").alias("dt"), "symbol", "open", "high", "low", "close", "volume")


def upsert_stream(bars: DataFrame, path: str, checkpoint: str):
    """A query that merges each batch of bars into a folder partitioned by day, later rows winning."""

    def merge(batch: DataFrame, _: int) -> None:
        upsert_partitions(batch.withColumn("day", F.to_date("dt")), path, ["dt", "symbol"], "day")

    return bars.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(merge)
