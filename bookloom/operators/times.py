"""Times as text, and seeks on candles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookloom.operators.frames import last_until
from bookloom.operators.rolling import DAY, with_place


def time_ns(text: Column, end_of_day: bool = False) -> Column:
    """Nanoseconds since 1970 of an ISO time; a bare date is its first second, or its last; without a zone it is UTC.  What is no time is null."""
    text = F.trim(text)
    whole = F.when(F.length(text) == 10, F.concat(text, F.lit("T23:59:59" if end_of_day else "T00:00:00"))).otherwise(text)
    zoned = F.when(whole.rlike(r"(Z|[+-]\d{2}:?\d{2})$"), whole).otherwise(F.concat(whole, F.lit("Z")))
    stamp = F.try_to_timestamp(F.when(zoned.rlike(r"^\d{4}-\d{2}-\d{2}[T ]"), zoned))
    return F.unix_micros(stamp) * 1000


def between(rows: DataFrame, start: str | None, end: str | None) -> DataFrame:
    """Rows from the begin of `start` to the end of `end`, both included (null: open); the bounds are literals, so they reach the scan of a table by ts_us."""
    for text, late in ((start, False), (end, True)):
        if text is not None:
            ns = rows.sparkSession.range(1).select(time_ns(F.lit(text), late)).first()[0]
            if ns is None:
                raise ValueError(f"not a time: {text!r}")
            rows = rows.where(F.col("ts_us") <= ns // 1000) if late else rows.where(F.col("ts_us") >= -(-ns // 1000))
    return rows


def candles(rows: DataFrame, step_us: int) -> DataFrame:
    """symbol, bucket_us, open, high, low, close, volume, index (from 0, by time) of rows with ts_us, seq, price, size."""
    order = F.struct("ts_us", "seq")
    made = rows.groupBy("symbol", (F.col("ts_us") - F.pmod("ts_us", F.lit(step_us))).alias("bucket_us")).agg(F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.sum("size").alias("volume"))
    placed = with_place(made.withColumns({"ts_us": F.col("bucket_us"), "seq": F.lit(0)}), 64 * max(step_us, DAY))
    return placed.drop("ts_us", "seq").withColumnRenamed("place", "index")


def seek(made: DataFrame, times: DataFrame, step_us: int) -> DataFrame:
    """times (symbol, seq, ts_us) with index and bucket_us of the last candle that begins by then, or of the first one before all; symbols without candles are left out."""
    facts = made.select("symbol", F.col("bucket_us").alias("at_us"), "index", "bucket_us")
    met = last_until(times.select("symbol", "ts_us", "seq"), facts, ["index", "bucket_us"], 64 * max(step_us, DAY))
    first = made.where(F.col("index") == 0).select("symbol", F.col("bucket_us").alias("first_us"))
    return met.join(first, "symbol").select("symbol", "seq", F.coalesce("index", F.lit(0)).alias("index"), F.coalesce("bucket_us", "first_us").alias("bucket_us"))


def step(made: DataFrame, places: DataFrame, by: int) -> DataFrame:
    """places (symbol, seq, index) moved by so many candles, kept within those that there are, with the candle they stand on."""
    last = made.groupBy("symbol").agg(F.max("index").alias("last"))
    moved = places.join(last, "symbol").withColumn("index", F.greatest(F.lit(0), F.least("last", F.col("index") + by))).select("symbol", "seq", "index")
    return moved.join(made, ["symbol", "index"])


def switch(old: DataFrame, new: DataFrame, places: DataFrame, step_us: int) -> DataFrame:
    """places (symbol, seq, index) on the candles of one timeframe, on those of another: where the old candle begins."""
    at = places.join(old.select("symbol", "index", F.col("bucket_us").alias("ts_us")), ["symbol", "index"]).select("symbol", "seq", "ts_us")
    return seek(new, at, step_us)
