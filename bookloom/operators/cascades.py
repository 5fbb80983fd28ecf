"""Cascades on a caller's table of states: thinning by a cooldown, ignitions, withdrawals, and contagion between symbols.

A walk that keeps a row and then passes over all that come before the cooldown ends is a graph: each row points to the first one
after its cooldown, and what is kept is what the pointers reach from rows that no walk can pass over, those a cooldown
or more after the row before.  Pointers are doubled, so the rounds grow with the logarithm of the longest chain, every
round is a join by row, and no symbol, day or run is a task of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bookloom.operators.frames import first_from, last_until, with_previous
from bookloom.tables import written

# Names of states, and the default thresholds.
STREAKS = ("BULL_STREAK", "BEAR_STREAK")
STALLS = ("BULL_STALL", "BEAR_STALL")
SECOND = 1_000_000


def thinned(rows: DataFrame, gap_us: int) -> DataFrame:
    """The rows that the walk keeps for each symbol: the first by (ts_us, seq), then each first one at `gap_us` or more after the last kept.

    rows: symbol, ts_us, seq (together with the symbol unique), and whatever else.  gap_us <= 0 keeps all rows.
    """
    if gap_us <= 0:
        return rows
    block = 64 * gap_us
    nodes = with_previous(rows.select("symbol", "ts_us", "seq"), ["ts_us"], block)
    nodes = nodes.select("symbol", "ts_us", "seq", (F.col("prev_ts_us").isNull() | (F.col("ts_us") - F.col("prev_ts_us") >= gap_us)).alias("kept"))
    ahead = first_from(nodes, ["seq", "kept"], gap_us, block)
    # A pointer to a row that is kept anyway ends the chain.
    state = written(ahead.select("symbol", "seq", "kept", F.when(~F.col("next_kept"), F.col("next_seq")).alias("to")), "pointers")
    while not state.where("to is not null").isEmpty():
        hit = state.where("kept and to is not null").select("symbol", F.col("to").alias("seq")).distinct().withColumn("hit", F.lit(True))
        hop = state.select("symbol", F.col("seq").alias("to"), F.col("to").alias("then"))
        state = state.join(hit, ["symbol", "seq"], "left").join(hop, ["symbol", "to"], "left")
        state = written(state.select("symbol", "seq", (F.col("kept") | F.coalesce("hit", F.lit(False))).alias("kept"), F.col("then").alias("to")), "pointers")
    return rows.join(state.where("kept").select("symbol", "seq"), ["symbol", "seq"], "left_semi")


def since(states: DataFrame, inside: Column, block_us: int) -> DataFrame:
    """The rows that are inside, with `start_us`: when their run of inside rows began, in the order of (ts_us, seq)."""
    order = F.struct("ts_us", "seq")
    rows = with_previous(states.withColumn("inside", F.coalesce(inside, F.lit(False))), ["inside"], block_us).where("inside")
    rows = rows.withColumn("block", F.floor(F.col("ts_us") / block_us)).withColumn("begin", F.when(F.coalesce(~F.col("prev_inside"), F.lit(True)), order))
    within = Window.partitionBy("symbol", "block").orderBy("ts_us", "seq").rowsBetween(Window.unboundedPreceding, 0)
    over = Window.partitionBy("symbol").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = rows.groupBy("symbol", "block").agg(F.max("begin").alias("begin")).select("symbol", "block", F.max("begin").over(over).alias("carried"))
    met = rows.withColumn("own", F.max("begin").over(within)).join(carried, ["symbol", "block"])
    return met.select(*states.columns, F.coalesce("own", "carried")["ts_us"].alias("start_us"))


def ignitions(states: DataFrame, least_length: int = 3, least_velocity: float = 2.0, least_acceleration: float = 1.0, gap_us: int = 5 * SECOND, block_us: int = 3600 * SECOND) -> DataFrame:
    """symbol, seq, anchor_us, end_us, confidence of fast streaks under accelerating pressure, thinned by the cooldown.

    states: symbol, ts_us, seq, state, streak_length, streak_velocity, pressure_acceleration; nulls never fire.
    """
    length, speed, push = (F.col(c) for c in ("streak_length", "streak_velocity", "pressure_acceleration"))
    fast = since(states, F.col("state").isin(*STREAKS), block_us).where((length >= least_length) & (speed >= least_velocity) & (push >= least_acceleration))
    confidence = F.least(F.lit(1.0), 0.5 * speed / max(least_velocity, 1) + 0.5 * push / max(least_acceleration, 1))
    return thinned(fast, gap_us).select("symbol", "seq", F.col("start_us").alias("anchor_us"), F.col("ts_us").alias("end_us"), confidence.alias("confidence"))


def withdrawals(states: DataFrame, least_us: int = 60 * SECOND, least_count: int = 3, most_acceleration: float = 0.9, least_exhaustion: float = 0.5, gap_us: int = 30 * SECOND, block_us: int = 3600 * SECOND) -> DataFrame:
    """symbol, seq, anchor_us, end_us, confidence of stalls that last while the flow does not accelerate, thinned by the cooldown.

    states: symbol, ts_us, seq, state, stall_count, pressure_acceleration, streak_exhaustion; nulls never fire.
    """
    count, tired = F.col("stall_count"), F.col("streak_exhaustion")
    long = since(states, F.col("state").isin(*STALLS), block_us).where((F.col("ts_us") - F.col("start_us") >= least_us) & (count >= least_count) & (F.col("pressure_acceleration") < most_acceleration) & (tired >= least_exhaustion))
    confidence = F.least(F.lit(1.0), 0.5 * count / max(least_count, 1) + 0.5 * tired)
    return thinned(long, gap_us).select("symbol", "seq", F.col("start_us").alias("anchor_us"), F.col("ts_us").alias("end_us"), confidence.alias("confidence"))


def gated_pairs(events: DataFrame, coherence: DataFrame | None, adjacency: DataFrame | None, least_coherence: float = 0.55, least_adjacency: float = 0.45) -> DataFrame:
    """symbol, peer, both ways: pairs whose coherence or adjacency (a, b, value; either order) reaches its threshold; all pairs if there is neither table.

    One row for each two symbols at most, not for events.
    """
    if coherence is None and adjacency is None:
        symbols = events.select("symbol").distinct()
        return symbols.join(symbols.select(F.col("symbol").alias("peer")), F.col("symbol") != F.col("peer"))
    passing = [t.where(F.col("value") >= least).select("a", "b") for t, least in ((coherence, least_coherence), (adjacency, least_adjacency)) if t is not None]
    pairs = passing[0] if len(passing) == 1 else passing[0].unionByName(passing[1])
    return pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct().select(F.col("a").alias("symbol"), F.col("b").alias("peer"))


def contagion(events: DataFrame, coherence: DataFrame | None = None, adjacency: DataFrame | None = None, window_us: int = SECOND, gap_us: int = 15 * SECOND, **least: float) -> DataFrame:
    """symbol, seq, anchor_us, end_us, symbols, confidence: an event and the gated peers that fire within `window_us` after it, thinned over all symbols.

    events: symbol, ts_us, seq (unique over all symbols); they come by (ts_us, seq).  Each event asks, for each of its peers,
    for that peer's last event up to the window's end: pairs of events are never made.
    """
    asked = events.select("symbol", "seq", "ts_us").join(gated_pairs(events, coherence, adjacency, **least), "symbol")
    asked = asked.select(F.col("peer").alias("symbol"), (F.col("ts_us") + window_us).alias("ts_us"), F.struct("ts_us", "seq", "symbol").alias("anchor"))
    facts = events.groupBy("symbol", F.col("ts_us").alias("at_us")).agg(F.max(F.struct("ts_us", "seq")).alias("fired"))
    last = last_until(asked, facts, ["fired"], 64 * window_us)
    met = last.where(F.col("fired") > F.struct("anchor.ts_us", "anchor.seq")).groupBy("anchor").agg(F.max("fired.ts_us").alias("end_us"), F.collect_set("symbol").alias("peers"))
    symbols = F.array_sort(F.array_union("peers", F.array("anchor.symbol")))
    found = met.select(F.lit("").alias("symbol"), "anchor.ts_us", "anchor.seq", F.col("anchor.symbol").alias("of"), "end_us", symbols.alias("symbols"))
    confidence = F.least(F.lit(1.0), 0.5 + 0.15 * (F.size("symbols") - 2))
    return thinned(found, gap_us).select(F.col("of").alias("symbol"), "seq", F.col("ts_us").alias("anchor_us"), "end_us", "symbols", confidence.alias("confidence"))
