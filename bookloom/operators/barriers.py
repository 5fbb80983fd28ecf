"""Barrier labels and excursions without pairs: what is hit first is found by doubling over maxima of runs of rows.

A part is a block of time with the horizon after it, and a task holds its times and prices.  For rows sorted by time,
maxima of 1, 2, 4, ... rows are made; the first row at or above a barrier is where steps over runs that stay below it, the
longest first, come to a halt.  That is n log n steps a part, however many rows a horizon holds.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bookloom.operators.frames import LEAST_BLOCK_US


def _tables(x: np.ndarray) -> list[np.ndarray]:
    """Maxima of runs of 2^k rows from each row on."""
    out = [x]
    while 2 ** len(out) <= len(x):
        half = 2 ** (len(out) - 1)
        out.append(np.maximum(out[-1][:-half], out[-1][half:]))
    return out


def _first_at_least(tables: list[np.ndarray], start: np.ndarray, goal: np.ndarray) -> np.ndarray:
    """The first row from `start` on with a value of the goal or more; the number of rows if there is none."""
    at, n = start.copy(), len(tables[0])
    for k in reversed(range(len(tables))):
        inside = np.flatnonzero(at + 2**k <= n)
        at[inside[tables[k][at[inside]] < goal[inside]]] += 2**k
    return at


def _most(tables: list[np.ndarray], start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The maximum of the rows from start to before end, which must be more."""
    k = np.floor(np.log2(end - start)).astype(np.int64)
    out = np.empty(len(start))
    for level in np.unique(k):
        i = np.flatnonzero(k == level)
        out[i] = np.maximum(tables[level][start[i]], tables[level][end[i] - 2**level])
    return out


def walk(ts: np.ndarray, mid: np.ndarray, horizon: int, up: float, down: float) -> dict[str, np.ndarray]:
    """up_us, down_us (-1: not hit), mfe, mae, seen for rows in order of time: of the rows later than a row, up to `horizon` after it."""
    start, end = np.searchsorted(ts, ts, side="right"), np.searchsorted(ts, ts + horizon, side="right")
    highs, lows = _tables(mid), _tables(-mid)
    out = {"seen": end - start}
    for name, tables, goal in (("up_us", highs, mid + up), ("down_us", lows, down - mid)):
        at = _first_at_least(tables, start, goal)
        out[name] = np.where(at < end, ts[np.minimum(at, len(ts) - 1)], -1)
    full = end > start
    for name, tables, sign in (("mfe", highs, -1), ("mae", lows, 1)):
        out[name] = np.full(len(ts), np.nan)
        out[name][full] = _most(tables, start[full], end[full]) + sign * mid[full]
    return out


def first_hits(quotes: DataFrame, horizon: int, up: float, down: float) -> DataFrame:
    """symbol, seq, up_us, down_us, mfe, mae, seen, label of each quote with a mid over 0.

    label: 1 or -1 by the barrier that is hit first (the lower one if both are at one time), 0 if neither is within the horizon,
    null if the horizon ends after the symbol's last quote and neither was hit.
    """
    m = quotes.where("mid > 0").select("symbol", "seq", "ts_us", "mid")
    size = max(16 * horizon, LEAST_BLOCK_US)
    own = F.floor(F.col("ts_us") / size)
    parts = F.array_compact(F.array(own, F.when(F.col("ts_us") <= own * size + horizon, own - 1)))
    each = m.withColumn("part", F.explode(parts))

    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("ts_us", kind="stable")
        ts = g["ts_us"].to_numpy(np.int64)
        found = walk(ts, g["mid"].to_numpy(float), horizon, up, down)
        table = pd.DataFrame({"symbol": key[0], "seq": g["seq"].to_numpy(), "ts_us": ts, **found})
        return table[ts < (key[1] + 1) * size]

    hits = each.groupBy("symbol", "part").applyInPandas(run, "symbol string, seq long, ts_us long, up_us long, down_us long, mfe double, mae double, seen long")
    hits = hits.join(m.groupBy("symbol").agg(F.max("ts_us").alias("end_us")), "symbol")
    rose, fell = F.col("up_us") >= 0, F.col("down_us") >= 0
    label = F.when(rose & (~fell | (F.col("up_us") < F.col("down_us"))), 1).when(fell, -1).when(F.col("ts_us") + horizon <= F.col("end_us"), 0)
    return hits.select("symbol", "seq", "up_us", "down_us", *[F.when(F.col("seen") > 0, F.col(c)).alias(c) for c in ("mfe", "mae")], "seen", label.alias("label"))


def triple_barrier(mbo: DataFrame, quotes: DataFrame, up: float, down: float, horizon: int) -> DataFrame:
    return first_hits(quotes, horizon, up, down).select("symbol", "seq", "label")


def excursions(mbo: DataFrame, quotes: DataFrame, up: float, down: float, horizon: int, stop: float) -> DataFrame:
    """mfe, mae and the class: 2 or -2 where the barrier was hit without an excursion over `stop` the other way."""
    hits = first_hits(quotes, horizon, up, down).where("seen > 0")
    rose = F.when(F.col("mae") <= stop, 2).otherwise(1)
    fell = F.when(F.col("mfe") <= stop, -2).otherwise(-1)
    return hits.select("symbol", "seq", "mfe", "mae", F.when(F.col("label") == 1, rose).when(F.col("label") == -1, fell).when(F.col("label") == 0, 0).alias("class"))
