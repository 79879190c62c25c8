"""Bars from a stream of candles, each emitted once when it has closed."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.timeframes import anchor_ms, timeframe_ms
from ..operators import candles


def closed_bars(stream: DataFrame, timeframe: str, delay: str = "0 seconds") -> DataFrame:
    """Append-mode bars of a candle stream: late copies of a candle (same symbol and time) are dropped within the watermark,
    and a bar comes out when the watermark has passed its end."""
    tf = timeframe_ms(timeframe)
    timed = stream.withColumn("_ts", F.timestamp_millis("timestamp")).withWatermark("_ts", delay)
    once = timed.dropDuplicatesWithinWatermark(["symbol", "timestamp"])
    window = F.window("_ts", f"{tf} milliseconds", startTime=f"{anchor_ms(timeframe)} milliseconds")
    bars = once.groupBy("symbol", window).agg(
        F.min_by("open", "timestamp").alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", "timestamp").alias("close"),
        F.sum("volume").alias("volume"),
        F.count("*").alias("n_candles"),
    )
    return bars.select("symbol", F.unix_millis(F.col("window.start")).alias("timestamp"), "open", "high", "low", "close", "volume", "n_candles")


def insert_batches(stream: DataFrame, path: str, checkpoint: str):
    """Append candles that the table at path doesn't hold yet, batch by batch; returns the streaming query."""

    def insert(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        try:
            present = spark.read.parquet(path)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            present = spark.createDataFrame([], batch.schema)
        candles.insert_if_absent(batch, present).write.mode("append").parquet(path)

    return stream.writeStream.foreachBatch(insert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _shared(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; on a local master that names none, one of our own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and re.match(r"local(\[|$)", spark.sparkContext.master) is None:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return named.rstrip("/") if named else "file://" + tempfile.mkdtemp(prefix="tidemark-")


def replay_closed_bars(spark: SparkSession, sf_dir: str, timeframe: str) -> DataFrame:
    """The events of a folder as a stream, run to its end: bars that had closed by the last event."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir).where("value > 0")
    price = F.col("value")
    stream = raw.select(
        F.col("event_type").alias("symbol"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("timestamp"),
        *(price.alias(c) for c in ("open", "high", "low", "close")),
        F.get_json_object("props", "$.k").cast("double").alias("volume"),
    )
    bars, root = closed_bars(stream, timeframe), f"{_shared(spark)}/tidemark/{uuid.uuid4().hex}"
    bars.writeStream.format("parquet").option("path", f"{root}/bars").option("checkpointLocation", f"{root}/checkpoint").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(bars.schema).parquet(f"{root}/bars")
