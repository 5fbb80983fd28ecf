"""Replay of book snapshots from files of levels (Parquet or CSV): whole snapshots with a position, seeks and steps, and the same rows as a stream.

Files hold timestamp, side, price, volume and maybe order_count (1 where there is none) and symbol ('REPLAY').  Rows of one time are one snapshot; its bids
go down in price, its asks up.  Playing is reading a range of positions; the position survives as a number, not as state.

Edge cases: sides BID, B and BUY in any case are bids, all else is an ask; times may be written as decimals and are cut to whole
ones; levels of one price stay apart, ordered by volume and count; rows without a time or a price are left out; a seek
outside the positions goes to the nearest end; missing columns are refused.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from bookloom.operators.rolling import with_place

REQUIRED = ("timestamp", "side", "price", "volume")


def _levels(rows: DataFrame) -> DataFrame:
    if missing := [c for c in REQUIRED if c not in rows.columns]:
        raise ValueError(f"missing columns: {missing}")
    bid = F.upper(F.col("side")).isin("BID", "B", "BUY")
    count = F.coalesce(F.col("order_count").cast("long"), F.lit(1)) if "order_count" in rows.columns else F.lit(1).cast("long")
    symbol = F.coalesce(F.col("symbol"), F.lit("REPLAY")) if "symbol" in rows.columns else F.lit("REPLAY")
    made = rows.select(symbol.alias("symbol"), F.col("timestamp").cast("double").cast("long").alias("timestamp"), F.when(bid, "B").otherwise("A").alias("side"), F.col("price").cast("double").alias("price"), F.col("volume").cast("double").alias("volume"), count.alias("order_count"))
    return made.where("timestamp is not null and price is not null")


def read_levels(spark: SparkSession, path: str) -> DataFrame:
    """The levels of files, read by what their names end in."""
    if path.lower().rstrip("/").endswith(".csv"):
        return _levels(spark.read.option("header", True).csv(path))
    return _levels(spark.read.parquet(path))


def stream_levels(spark: SparkSession, path: str, schema: StructType | str, fmt: str = "parquet", files_per_trigger: int = 16) -> DataFrame:
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    return _levels(stream.option("header", True).csv(path) if fmt == "csv" else stream.parquet(path))


def snapshots(levels: DataFrame, late: str = "1 minute") -> DataFrame:
    """symbol, timestamp, bids, asks (arrays of price, volume, order_count, the best first); on a stream a snapshot comes when the watermark is past it."""
    rows = levels.withColumn("at", F.timestamp_millis("timestamp"))
    if levels.isStreaming:
        rows = rows.withWatermark("at", late)
    level = F.struct("price", "volume", "order_count")
    out = rows.groupBy("symbol", "at").agg(F.collect_list(F.when(F.col("side") == "B", level)).alias("bids"), F.collect_list(F.when(F.col("side") == "A", level)).alias("asks"))
    down = lambda x, y: F.when(x["price"] > y["price"], -1).when(x["price"] < y["price"], 1).when(F.struct(x["volume"], x["order_count"]) < F.struct(y["volume"], y["order_count"]), -1).when(F.struct(x["volume"], x["order_count"]) > F.struct(y["volume"], y["order_count"]), 1).otherwise(0)
    return out.select("symbol", F.unix_millis("at").alias("timestamp"), F.array_sort("bids", down).alias("bids"), F.array_sort("asks").alias("asks"))


def positions(made: DataFrame, block: int = 86_400_000) -> DataFrame:
    """Snapshots with `position`, from 0 on, by time within the symbol."""
    placed = with_place(made.withColumns({"ts_us": F.col("timestamp"), "seq": F.lit(0)}), block)
    return placed.drop("ts_us", "seq").withColumnRenamed("place", "position")


def play(placed: DataFrame, start: int = 0, count: int | None = None) -> DataFrame:
    """The snapshots from a position on, `count` of them; a start outside is moved to the nearest position."""
    last = placed.groupBy("symbol").agg(F.max("position").alias("last"))
    at = F.greatest(F.lit(0), F.least(F.lit(start), F.col("last")))
    met = placed.join(last, "symbol").where((F.col("position") >= at) & (F.lit(count is None) | (F.col("position") < at + F.lit(count or 0))))
    return met.drop("last")


def seek(placed: DataFrame, timestamp: int) -> DataFrame:
    """The last snapshot of each symbol at a time or before it."""
    found = placed.where(F.col("timestamp") <= timestamp).groupBy("symbol").agg(F.max("position").alias("position"))
    return placed.join(found, ["symbol", "position"], "left_semi")
