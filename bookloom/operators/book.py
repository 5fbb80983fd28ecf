"""The order book at any time: lifetimes of orders with their remaining size, and levels on a grid of times.

An add sets an order (and replaces one of the same number), a modify replaces it if it rests, a cancel removes it, a
fill takes from its size and removes it at 0 or below; what names an unknown order is ignored.  A lifetime is the time from one
event of a resting order to the next.  None of this needs a walk: between adds, modifies and cancels the remaining size is
a running sum of fills, and a modify counts if every segment since the last add has ended with something left.

The grid never explodes orders over times.  Each change of a level is binned to the first grid time that sees it and
summed there; levels are summed up within blocks of grid times, with one row a level and block for what it begins with;
only levels that rest are then laid out, one row a grid time: the size of the result.

Edge cases: null sizes are 0; orders still resting stay to the last grid time of their symbol, which is the first at or after
its last event; two events of a grid cell that cancel out leave no trace; an empty table has no book.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lifetimes(mbo: DataFrame) -> DataFrame:
    """symbol, order_id, side, price, size, from_us, from_seq, to_us, to_seq (null: rests on) of every state of every order."""
    order = Window.partitionBy("symbol", "order_id").orderBy("ts_us", "seq")
    running = order.rowsBetween(Window.unboundedPreceding, 0)
    sets, fills = F.col("action").isin("A", "M", "C"), F.col("action").isin("F", "T")
    e = mbo.select("symbol", "order_id", "ts_us", "seq", "action", "side", "price", F.coalesce("size", F.lit(0)).alias("size")).where(sets | fills)
    e = e.withColumns({"segment": F.count_if(sets).over(running), "epoch": F.count_if(F.col("action") == "A").over(running), "to_us": F.lead("ts_us").over(order), "to_seq": F.lead("seq").over(order)})
    inside = Window.partitionBy("symbol", "order_id", "segment").orderBy("ts_us", "seq").rowsBetween(Window.unboundedPreceding, 0)
    e = e.withColumns({"begin": F.first(F.struct("action", "side", "price", "size")).over(inside), "filled": F.sum(F.when(fills, F.col("size")).otherwise(0)).over(inside)})
    e = e.withColumn("left", F.col("begin.size") - F.col("filled"))
    e = e.withColumn("holds", F.col("begin.action").isin("A", "M") & F.coalesce(F.min(F.when(fills, F.col("left"))).over(inside) > 0, F.lit(True)))
    unknown = (F.col("action") == "M") & ~F.coalesce(F.lag("holds").over(order), F.lit(False))
    since_add = Window.partitionBy("symbol", "order_id", "epoch").orderBy("ts_us", "seq").rowsBetween(Window.unboundedPreceding, 0)
    e = e.withColumn("unknown", unknown).withColumn("broken", F.max("unknown").over(since_add))
    rests = e.where((F.col("epoch") > 0) & F.col("holds") & ~F.col("broken"))
    return rests.select("symbol", "order_id", F.col("begin.side").alias("side"), F.col("begin.price").alias("price"), F.col("left").alias("size"), F.col("ts_us").alias("from_us"), F.col("seq").alias("from_seq"), "to_us", "to_seq")


def _cell(us: str, step_us: int) -> Column:
    return F.ceil(F.col(us) / F.lit(step_us)).cast("long")


def level_changes(orders: DataFrame, step_us: int) -> DataFrame:
    """symbol, side, price, cell, volume, n: what orders bring to and take from each level up to a grid time (cell x step_us) since the one before."""
    ends = F.array(F.struct(_cell("from_us", step_us).alias("cell"), F.lit(1).alias("sign")), F.struct(_cell("to_us", step_us).alias("cell"), F.lit(-1).alias("sign")))
    each = orders.select("symbol", "side", "price", "size", F.explode(ends).alias("x")).select("symbol", "side", "price", "size", "x.*").where("cell is not null")
    return each.groupBy("symbol", "side", "price", "cell").agg(F.sum(F.col("sign") * F.col("size")).alias("volume"), F.sum("sign").alias("n")).where("volume <> 0 or n <> 0")


def book(mbo: DataFrame, step_us: int, block: int = 1024) -> DataFrame:
    """symbol, snap, side, price, volume, n_orders of the levels that rest at each grid time (all events up to it are seen); blocks of `block` times."""
    level = ["symbol", "side", "price"]
    last = mbo.groupBy("symbol").agg(F.max(_cell("ts_us", step_us)).alias("last"))
    changes = level_changes(lifetimes(mbo), step_us).withColumn("block", F.floor(F.col("cell") / block))
    over = Window.partitionBy(*level).orderBy("block")
    ends = changes.groupBy(*level, "block").agg(F.sum("volume").alias("volume"), F.sum("n").alias("n"))
    so_far = over.rowsBetween(Window.unboundedPreceding, 0)
    ends = ends.select(*level, F.col("block").alias("was"), F.lead("block").over(over).alias("next"), *[F.sum(c).over(so_far).alias(c) for c in ("volume", "n")]).where("n > 0").join(last, "symbol")
    until = F.coalesce("next", F.floor(F.col("last") / block))
    begins = ends.where(until > F.col("was")).select(*level, F.explode(F.sequence(F.col("was") + 1, until)).alias("block"), "volume", "n").withColumn("cell", F.col("block") * block)
    steps = changes.unionByName(begins).groupBy(*level, "block", "cell").agg(F.sum("volume").alias("volume"), F.sum("n").alias("n"))
    inside = Window.partitionBy(*level, "block").orderBy("cell")
    up_to = inside.rowsBetween(Window.unboundedPreceding, 0)
    held = steps.select(*level, "cell", F.coalesce(F.lead("cell").over(inside), (F.col("block") + 1) * block).alias("to"), F.sum("volume").over(up_to).alias("volume"), F.sum("n").over(up_to).alias("n_orders")).where("n_orders > 0")
    end = F.least(F.col("to") - 1, F.col("last"))
    laid = held.join(last, "symbol").where(end >= F.col("cell")).withColumn("at", F.explode(F.sequence("cell", end)))
    return laid.select("symbol", (F.col("at") * step_us).alias("snap"), "side", "price", "volume", "n_orders")


def best_quotes(levels: DataFrame) -> DataFrame:
    """symbol, snap, bid, ask, bid_size, ask_size of a book; an empty side is null."""
    bid, ask = (F.when(F.col("side") == s, F.col("price")) for s in "BA")
    return levels.groupBy("symbol", "snap").agg(F.max(bid).alias("bid"), F.min(ask).alias("ask"), F.max_by(F.when(F.col("side") == "B", F.col("volume")), bid).alias("bid_size"), F.min_by(F.when(F.col("side") == "A", F.col("volume")), ask).alias("ask_size"))


#: A book by replaying each order's events up to every grid time: a fold over the list of its events, for the oracle.
FOLD = """list_reduce(list_prepend({'ts_us': 0::BIGINT, 'seq': 0::BIGINT, 'action': 'C', 'side': '', 'price': 0e0, 'size': 0::BIGINT}, list_filter(ev, lambda e: e.ts_us <= snap)), lambda s, e: CASE
 WHEN e.action = 'A' THEN e WHEN e.action = 'C' OR s.action = 'C' THEN {'ts_us': e.ts_us, 'seq': e.seq, 'action': 'C', 'side': '', 'price': 0e0, 'size': 0::BIGINT}
 WHEN e.action = 'M' THEN {'ts_us': e.ts_us, 'seq': e.seq, 'action': 'A', 'side': e.side, 'price': e.price, 'size': e.size}
 WHEN s.size > e.size THEN {'ts_us': e.ts_us, 'seq': e.seq, 'action': 'A', 'side': s.side, 'price': s.price, 'size': s.size - e.size}
 ELSE {'ts_us': e.ts_us, 'seq': e.seq, 'action': 'C', 'side': '', 'price': 0e0, 'size': 0::BIGINT} END)"""


def sql(step_us: int) -> str:
    """The book as DuckDB states it over the view `mbo`."""
    return f"""SELECT symbol, snap, st.side AS side, st.price AS price, CAST(sum(st.size) AS BIGINT) AS volume, count(*) AS n_orders FROM (SELECT o.symbol, snap, {FOLD} AS st
 FROM (SELECT symbol, order_id, list({{'ts_us': ts_us, 'seq': seq, 'action': CASE action WHEN 'T' THEN 'F' ELSE action END, 'side': side, 'price': price, 'size': size}} ORDER BY ts_us, seq) AS ev FROM mbo GROUP BY 1, 2) o
 JOIN (SELECT symbol, unnest(range(CAST(ceil(min(ts_us) / {step_us}) AS BIGINT), CAST(ceil(max(ts_us) / {step_us}) AS BIGINT) + 1)) * {step_us} AS snap FROM mbo GROUP BY symbol) g ON o.symbol = g.symbol) f WHERE st.action = 'A' GROUP BY 1, 2, 3, 4"""
