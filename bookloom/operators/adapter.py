"""Level-one events from book snapshots: passive adds at the best price and the sides of trades.

snapshots: symbol, snap, bid, ask (null: an empty side, 0).  events, trades: symbol, snap, seq (order within a snapshot),
order_id, ts_us, side (B A, of the resting order), price; events also action and aggressive (null: false), trades size.
Snapshots repeat what they have shown before: of rows with one key the first by (snap, seq) counts, within a symbol.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_previous(snapshots: DataFrame, block: int) -> DataFrame:
    """symbol, snap, bid, ask and those of the symbol's snapshot before (its own for the first one).

    Snapshots are ordered within blocks of `block` (in units of snap); one row a block tells what the next begins with.
    """
    rows = snapshots.select("symbol", "snap", F.coalesce("bid", F.lit(0.0)).alias("bid"), F.coalesce("ask", F.lit(0.0)).alias("ask"), F.floor(F.col("snap") / block).alias("block"))
    now = F.struct("bid", "ask")
    inside = Window.partitionBy("symbol", "block").orderBy("snap")
    last = rows.groupBy("symbol", "block").agg(F.max_by(now, "snap").alias("last"))
    carried = last.select("symbol", "block", F.lag("last").over(Window.partitionBy("symbol").orderBy("block")).alias("carried"))
    before = F.coalesce(F.lag(now).over(inside), "carried", now)
    return rows.join(carried, ["symbol", "block"]).withColumn("before", before).select("symbol", "snap", "bid", "ask", F.col("before.bid").alias("bid_before"), F.col("before.ask").alias("ask_before"))


def _first(rows: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """The first row of each key; partial minima are made before the shuffle."""
    best = rows.groupBy("symbol", *keys).agg(F.min(F.struct("snap", "seq", *values)).alias("x"))
    return best.select("symbol", *keys, "x.*")


def passive_adds(snapshots: DataFrame, events: DataFrame, tick: float = 0.25, block: int = 3_600_000_000) -> DataFrame:
    """symbol, seq, ts_us, side of the adds that rest at the best price of their snapshot or the one before, the better one."""
    adds = _first(events.where((F.col("action") == "A") & ~F.coalesce("aggressive", F.lit(False))), ["order_id", "ts_us"], ["side", "price"])
    best = F.when(F.col("side") == "B", F.greatest("bid", "bid_before")).when(F.col("side") == "A", F.least("ask", "ask_before"))
    return adds.join(with_previous(snapshots, block), ["symbol", "snap"]).where(F.abs(F.col("price") - best) < tick / 2).select("symbol", "seq", "ts_us", "side")


def side_of(price: Column, side: Column, mid: Column) -> Column:
    """'ask' above the mid, 'bid' under it; at the mid the side of the resting order."""
    return F.when(price > mid, "ask").when(price < mid, "bid").when(side == "B", "bid").otherwise("ask")


def trade_sides(snapshots: DataFrame, trades: DataFrame) -> DataFrame:
    """symbol, seq, ts_us, side ('bid': the seller came to the bid), size; without a bid or an ask the mid is 0."""
    first = _first(trades, ["order_id", "ts_us"], ["side", "price", "size"])
    whole = (F.coalesce("bid", F.lit(0.0)) != 0) & (F.coalesce("ask", F.lit(0.0)) != 0)
    mids = snapshots.select("symbol", "snap", F.when(whole, (F.col("bid") + F.col("ask")) / 2).otherwise(0.0).alias("mid"))
    side = side_of(F.col("price"), F.col("side"), F.col("mid")).alias("side")
    return first.join(mids, ["symbol", "snap"]).select("symbol", "seq", "ts_us", side, F.coalesce(F.abs("size"), F.lit(0)).alias("size"))
