"""Candles over a stream of event files: late rows are bounded by a watermark, repeated ones dropped within it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bookloom.sources.mbo import from_events


def event_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def candles(events: DataFrame, step: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """symbol, bucket, open, high, low, close, volume of fills; works on a stream and on a table alike."""
    rows = from_events(events).withColumn("ts", F.timestamp_micros("ts_us")).where(F.col("action").isin("F", "T") & (F.col("price") > 0))
    if events.isStreaming:
        rows = rows.withWatermark("ts", late).dropDuplicatesWithinWatermark(["symbol", "seq"])
    order = F.struct("ts_us", "seq")
    out = rows.groupBy("symbol", F.window("ts", step).alias("w")).agg(F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.sum("size").alias("volume"))
    return out.select("symbol", F.col("w.start").alias("bucket"), "open", "high", "low", "close", "volume")
