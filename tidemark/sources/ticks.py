"""Candles from a table of events: one flat candle per event with a positive value."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol (event type), timestamp (ms), open = high = low = close (value), volume ($.k of props), seq (event id)."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").where("value > 0")
    price = F.col("value")
    return events.select(
        F.col("event_type").alias("symbol"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("timestamp"),
        *(price.alias(c) for c in ("open", "high", "low", "close")),
        F.get_json_object("props", "$.k").cast("double").alias("volume"),
        F.col("event_id").alias("seq"),
    )
