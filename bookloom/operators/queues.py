"""Queues, simulated fills, position limits, level lifecycles and gap-suppressed triggers: folds over a session's events.

As in `stateful`, state starts anew with each (symbol, session); limits over all symbols fold one session's trades.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bookloom.operators.stateful import by_session

SECOND = 1_000_000


class Queues:
    """Resting sizes by (side, price in ticks), in order of priority."""

    def __init__(self, tick: float, pro_rata: bool):
        self.tick, self.pro_rata = tick, pro_rata
        self.levels: dict[tuple, dict] = defaultdict(dict)
        self.at: dict[tuple, tuple] = {}

    def key(self, side: str, price: float) -> tuple:
        return side, round(price / self.tick)

    def drop(self, side: str, order) -> None:
        if (key := self.at.pop((side, order), None)) is not None:
            self.levels[key].pop(order, None)

    def join(self, key: tuple, order, size: float) -> float:
        """Put an order at the back; the volume ahead of it."""
        self.drop(key[0], order)
        ahead = sum(self.levels[key].values())
        self.levels[key][order], self.at[key[0], order] = size, key
        return ahead

    def ahead(self, side: str, order) -> tuple[float, float]:
        """Volume in front of an order, volume of its whole level."""
        level = self.levels[self.at[side, order]]
        names = list(level)
        return sum(level[o] for o in names[: names.index(order)]), sum(level.values())

    def fill(self, key: tuple, size: float) -> list:
        """Take size from the front (or from all, by share); the orders that are used up."""
        level, gone = self.levels[key], []
        total = sum(level.values())
        share = min(size, total) / total if total > 0 else 0.0
        for order, rest in list(level.items()):
            taken = rest * share if self.pro_rata else min(rest, size)
            size -= 0 if self.pro_rata else taken
            level[order] = rest - taken
            if level[order] <= 0:
                gone.append(order)
                self.drop(key[0], order)
        return gone

    def apply(self, action: str, side: str, order, price: float, size: float) -> list:
        key = self.key(side, price)
        if action == "C" or (action == "M" and size <= 0):
            self.drop(side, order)
        elif action == "M" and self.at.get((side, order)) == key and size <= self.levels[key].get(order, 0):
            self.levels[key][order] = size  # a smaller size keeps its place
        elif action in "AM" and size > 0:
            self.join(key, order, size)
        elif action in "FT":
            return self.fill(key, size)
        return []


def queue_positions(mbo: DataFrame, tick: float = 0.25, pro_rata: bool = False) -> DataFrame:
    """Volume ahead and in all at the level of every order that joins a queue, and 1 - ahead / total."""

    def fold(g: pd.DataFrame) -> Iterator[tuple]:
        q = Queues(tick, pro_rata)
        for seq, action, side, order, price, size in zip(g["seq"], g["action"], g["side"], g["order_id"], g["price"], g["size"]):
            q.apply(action, side, order, price, size)
            if action in "AM" and size > 0:
                ahead, total = q.ahead(side, order)
                yield seq, float(ahead), float(total), 1 - ahead / total

    return by_session(mbo, fold, "seq long, ahead double, total double, p_fill double")


def simulate_fills(mbo: DataFrame, quotes: DataFrame, every: int = 10, lots: float = 1.0, horizon_us: int = 60 * SECOND, adverse_ticks: int = 4, sweep_us: int = SECOND, tick: float = 0.25) -> DataFrame:
    """A virtual order joins the queue of each add whose number `every` divides, until it fills, its time ends or the mid has moved adverse_ticks against it."""

    def fold(g: pd.DataFrame) -> Iterator[tuple]:
        q, open_, swept = Queues(tick, False), {}, 0

        def done(v: tuple, t: int, mid: float, why: str) -> tuple:
            t0, side, price, ahead = open_.pop(v)
            q.drop(side, v)
            return v[1], t0, t, side, price, float(ahead), why == "filled", (price - mid if side == "B" else mid - price) / tick, why

        for seq, t, action, side, order, price, size, mid in zip(g["seq"], g["ts_us"], g["action"], g["side"], g["order_id"], g["price"], g["size"], g["mid"]):
            for gone in q.apply(action, side, order, price, size):
                if gone in open_:
                    yield done(gone, t, mid, "filled")
            if t - swept >= sweep_us:
                swept = t
                for v, (t0, s, p, _) in list(open_.items()):
                    if (p - mid if s == "B" else mid - p) / tick >= adverse_ticks:
                        yield done(v, t, mid, "adverse")
                    elif t - t0 >= horizon_us:
                        yield done(v, t, mid, "timeout")
            if action == "A" and seq % every == 0:
                v = ("virtual", seq)
                open_[v] = (t, side, price, q.join(q.key(side, price), v, lots))
        for v in list(open_):
            yield done(v, t, mid, "session_end")

    rows = mbo.join(quotes.select("symbol", "seq", "mid"), ["symbol", "seq"])
    return by_session(rows, fold, "seq long, entry_us long, exit_us long, side string, price double, ahead double, filled boolean, adverse double, reason string")


def position_limits(trades: DataFrame, per_key: int = 1, per_symbol: int = 5, total: int = 10, daily_loss: float = 500.0) -> DataFrame:
    """Whether each wanted trade may open: at most so many open by (symbol, side), symbol and in all; none after a day's loss."""

    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        out, open_, pnl = [], [], 0.0
        for r in g.sort_values(["entry_us", "symbol", "side"]).itertuples():
            while open_ and open_[0][0] <= r.entry_us:
                pnl += heapq.heappop(open_)[3]
            symbols = [s for _, s, _, _ in open_]
            sides = [(s, d) for _, s, d, _ in open_]
            why = "halt" if pnl <= -daily_loss else "total" if len(open_) >= total else "symbol" if symbols.count(r.symbol) >= per_symbol else "pattern" if sides.count((r.symbol, r.side)) >= per_key else "open"
            if why == "open":
                heapq.heappush(open_, (r.exit_us, r.symbol, r.side, r.pnl))
            out.append((key[0], r.symbol, r.side, r.entry_us, why))
        return pd.DataFrame(out, columns=["session", "symbol", "side", "entry_us", "decision"])

    return trades.groupBy("session").applyInPandas(run, "session long, symbol string, side int, entry_us long, decision string")


def track_levels(mbo: DataFrame, step_us: int = 100_000, age_us: int = 5 * SECOND, fade_us: int = 15 * SECOND, volume: float = 100.0, orders: int = 10, round_step: float = 10.0, tick: float = 0.25) -> DataFrame:
    """Lifecycle and significance of every price level over snapshots of added volume; rows with significance over 0.3.

    forming, resting (after age_us), tested (touched and filled), defended (60 % of its peak after two fills) or broken
    (25 %); a level that vanishes is broken if it was filled, else pulled, and is forgotten after fade_us.
    """
    lv = mbo.withColumn("snap", F.col("ts_us") - F.pmod("ts_us", F.lit(step_us))).groupBy("symbol", "snap", "side", (F.round(F.col("price") / tick) * tick).alias("price")).agg(
        F.coalesce(F.sum(F.when(F.col("action") == "A", F.col("size"))), F.lit(0)).alias("v"), F.count(F.when(F.col("action") == "A", 1)).alias("n"), F.coalesce(F.sum(F.when(F.col("action").isin("F", "T"), F.col("size"))), F.lit(0)).alias("fill"))

    def significance(price: float, v: float, age: int, n: int, old: bool) -> float:
        rest = price % round_step
        if min(rest, round_step - rest) < tick:
            bonus = 1.0
        else:
            bonus = 0.4 if abs(rest - round_step / 2) < tick else 0.0
        return 0.30 * min(1.0, v / volume) + 0.25 * min(1.0, age / age_us) + 0.20 * min(1.0, n / orders) + 0.15 * bonus + 0.10 * old

    def after(level: dict, v: float, fill: float, touched: bool, age: int) -> str:
        match level["state"]:
            case "forming" if age >= age_us:
                return "resting"
            case "resting" if touched and fill > 0:
                return "tested"
            case "tested" if level["fills"] >= 2 and v >= 0.6 * level["peak"]:
                return "defended"
            case "tested" if level["fills"] >= 2 and v <= 0.25 * level["peak"]:
                return "broken"
            case "defended" if touched and v <= 0.25 * level["peak"]:
                return "broken"
        return level["state"]

    def fold(g: pd.DataFrame) -> Iterator[tuple]:
        levels: dict[tuple, dict] = {}
        history: set[tuple] = set()
        for snap, rows in g.groupby("snap", sort=True):
            fills = {(s, p): f for s, p, f in zip(rows["side"], rows["price"], rows["fill"])}
            now = {(s, p): (v, n) for s, p, v, n in zip(rows["side"], rows["price"], rows["v"], rows["n"]) if v > 0}
            far = {"A": max((p for s, p in now if s == "B"), default=None), "B": min((p for s, p in now if s == "A"), default=None)}
            for key in list(levels):
                level, (side, price) = levels[key], key
                fill = fills.get(key, 0)
                if key in now:
                    v, n = now[key]
                    age = snap - level["first"]
                    state = after(level, v, fill, far[side] is not None and abs(far[side] - price) <= tick, age)
                    refills = level["refills"] + (fill > 0 and v >= 0.7 * level["v"])
                    levels[key] = {**level, "v": v, "peak": max(level["peak"], v), "state": state, "last": snap, "refills": refills, "fills": level["fills"] + (fill > 0), "weight": significance(price, v, age, n, key in history)}
                elif level["state"] in ("broken", "pulled"):
                    if snap - level["last"] >= fade_us:
                        del levels[key]
                elif level["state"] == "forming":
                    del levels[key]
                else:
                    history.add(key)
                    levels[key] = {**level, "state": "broken" if fill > 0 else "pulled", "last": snap}
            for key, (v, _) in now.items():
                levels.setdefault(key, {"v": v, "peak": v, "state": "forming", "first": snap, "last": snap, "fills": 0, "refills": 0, "weight": 0.0})
            for (side, price), level in levels.items():
                if level["weight"] > 0.3:
                    yield snap, side, price, level["state"], float(level["v"]), float(level["weight"]), level["refills"] >= 2

    return by_session(lv.withColumn("ts_us", F.col("snap")).withColumn("seq", F.lit(0)), fold, "snap long, side string, price double, state string, volume double, significance double, iceberg boolean")


def bursts(mbo: DataFrame, least: int = 5, span_us: int = 100_000, gap_us: int = SECOND, before_us: int = 500_000, after_us: int = 2 * SECOND) -> DataFrame:
    """Windows around events with `least` events in the trailing span, `gap_us` or more after the last burst."""

    def fold(g: pd.DataFrame) -> Iterator[tuple]:
        times, lo, last = g["ts_us"].tolist(), 0, None
        for i, (seq, t) in enumerate(zip(g["seq"], times)):
            while times[lo] < t - span_us:
                lo += 1
            if i - lo + 1 >= least and (last is None or t - last >= gap_us):
                last = t
                yield seq, t - before_us, t + after_us, i - lo + 1

    return by_session(mbo, fold, "seq long, from_us long, to_us long, events int")


def anchors(quotes: DataFrame, move: float = 2.0, gap_us: int = 30 * SECOND) -> DataFrame:
    """Rows where the mid moves by `move` or more at once, gap_us or more after the last such row kept (also a match throttle)."""

    def fold(g: pd.DataFrame) -> Iterator[tuple]:
        last = None
        for seq, t, d in zip(g["seq"], g["ts_us"], g["mid"].diff().fillna(0.0)):
            if abs(d) >= move and (last is None or t - last >= gap_us):
                last = t
                yield seq, t, d

    return by_session(quotes, fold, "seq long, at_us long, move double")


def imbalance_ema(quotes: DataFrame, alpha: float = 0.1) -> DataFrame:
    """Exponential mean of (bid_size - ask_size) / (bid_size + ask_size), from 0."""

    def fold(g: pd.DataFrame) -> Iterator[tuple]:
        x = 0.0
        for seq, b, a in zip(g["seq"], g["bid_size"], g["ask_size"]):
            x += alpha * ((b - a) / (b + a) - x)
            yield seq, x

    return by_session(quotes, fold, "seq long, ema double")


def stop_runs(streaks: DataFrame, depth: int = 5, velocity: float = 2.0) -> DataFrame:
    """Streaks that clear `depth` prices at `velocity` prices a second or more."""
    conf = F.least(F.lit(1.0), F.col("depth") / (2 * depth)) * 0.6 + F.least(F.lit(1.0), F.col("velocity") / (2 * velocity)) * 0.4
    return streaks.where((F.col("depth") >= depth) & (F.col("velocity") >= velocity)).withColumn("aggressor", F.when(F.col("side") == "A", "B").otherwise("A")).withColumn("confidence", conf)

