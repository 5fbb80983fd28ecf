"""Order-dependent operators: one pure step over the sorted events of a key.

The key is (symbol, session day): state starts anew each session, so a group has the size of one day of one symbol and
tasks grow in number, not in length, with the input.  An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DAY = 86_400_000_000


def by_session(rows: DataFrame, fold: Callable[[pd.DataFrame], Iterator[tuple]], schema: str) -> DataFrame:
    """fold over the events of each (symbol, session) in order; its tuples follow `symbol, session`."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["ts_us", "seq"])
        return pd.DataFrame([(*key, *r) for r in fold(g)], columns=["symbol", "session", *names])

    keyed = rows.withColumn("session", (F.col("ts_us") - F.pmod(F.col("ts_us"), F.lit(DAY))))
    return keyed.groupBy("symbol", "session").applyInPandas(run, f"symbol string, session long, {schema}")


def cusum(quotes: DataFrame, h: float = 1.0) -> DataFrame:
    """Events where the sum of rises or of falls since the last event reaches h; both sums start anew then."""

    def fold(g: pd.DataFrame) -> Iterator[tuple]:
        up = down = 0.0
        for seq, d in zip(g["seq"], g["mid"].diff().fillna(0.0)):
            up, down = max(0.0, up + d), min(0.0, down + d)
            if up >= h or down <= -h:
                yield seq, 1 if up >= h else -1
                up = down = 0.0

    return by_session(quotes, fold, "seq long, direction int")


def streaks(mbo: DataFrame, least: int = 3, absorb: int = 1) -> DataFrame:
    """Runs of fills on one side, with up to `absorb` opposing fills; depth counts distinct prices of the run's side."""

    def fold(g: pd.DataFrame) -> Iterator[tuple]:
        side, start, end, n, against, prices = None, 0, 0, 0, 0, set()

        def done() -> Iterator[tuple]:
            if side is not None and n - against >= least:
                seconds = (end - start) / 1e6
                yield side, start, end, n, len(prices), len(prices) / seconds if seconds > 0 else 999.0

        for s, t, p in zip(g["side"], g["ts_us"], g["price"]):
            if s == side:
                n, end = n + 1, t
                prices.add(p)
            elif side is not None and against < absorb:
                n, against = n + 1, against + 1
            else:
                yield from done()
                side, start, end, n, against, prices = s, t, t, 1, 0, {p}
        yield from done()

    return by_session(mbo.where(F.col("action").isin("F", "T")), fold, "side string, start_us long, end_us long, fills int, depth int, velocity double")


def kalman(quotes: DataFrame, q: float = 0.01, r: float = 1.0) -> DataFrame:
    """Level and velocity of the mid under a constant-velocity model, first variance 100."""

    def fold(g: pd.DataFrame) -> Iterator[tuple]:
        x, v, p00, p01, p11 = float(g["mid"].iloc[0]), 0.0, 100.0, 0.0, 100.0
        for seq, z in zip(g["seq"], g["mid"]):
            x, p00, p01, p11 = x + v, p00 + 2 * p01 + p11 + q, p01 + p11, p11 + q
            k0, k1 = p00 / (p00 + r), p01 / (p00 + r)
            e = z - x
            x, v = x + k0 * e, v + k1 * e
            p00, p01, p11 = (1 - k0) * p00, (1 - k0) * p01, p11 - k1 * p01
            yield seq, x, v

    return by_session(quotes, fold, "seq long, level double, velocity double")


def vpin_reset(mbo: DataFrame, bucket: float = 500.0, last: int = 10) -> DataFrame:
    """Buckets that close at or over `bucket` and start anew at 0; the mean imbalance of the last ones."""

    def fold(g: pd.DataFrame) -> Iterator[tuple]:
        buy = sell = 0.0
        seen: list[float] = []
        for seq, s, v in zip(g["seq"], g["side"], g["size"]):
            buy, sell = buy + v * (s == "A"), sell + v * (s == "B")
            if buy + sell >= bucket:
                seen = [*seen[1 - last :], abs(buy - sell) / (buy + sell)]
                yield seq, sum(seen) / len(seen)
                buy = sell = 0.0

    return by_session(mbo.where(F.col("action").isin("F", "T")), fold, "seq long, vpin double")


def spectral(mbo: DataFrame, step_us: int = 200_000, bands: int = 4) -> DataFrame:
    """Energy of the signed volume of equal time steps in quarters of the spectrum (the mean is in the lowest)."""

    def fold(g: pd.DataFrame) -> Iterator[tuple]:
        at = (g["ts_us"] - g["ts_us"].iloc[0]) // step_us
        series = np.bincount(at, np.where(g["side"] == "A", g["size"], -g["size"]))
        power = np.abs(np.fft.rfft(series)) ** 2
        band = np.minimum(np.arange(len(power)) * bands // max(1, len(power) - 1), bands - 1)
        for b, e in enumerate(np.bincount(band, power, bands)):
            yield b, float(e)

    return by_session(mbo.where(F.col("action").isin("F", "T")), fold, "band int, energy double")


def backtest(quotes: DataFrame, enter: float = 0.3, leave: float = 0.1, stop: float = 0.02) -> DataFrame:
    """Trades on the signal (bid_size - ask_size) / (bid_size + ask_size): in at |signal| >= enter, out when it turns past leave or at the stop."""

    def fold(g: pd.DataFrame) -> Iterator[tuple]:
        held, entry, t0 = 0, math.nan, 0
        for t, m, b, a in zip(g["ts_us"], g["mid"], g["bid_size"], g["ask_size"]):
            signal = (b - a) / (b + a)
            if held and (held * signal <= -leave or held * (m - entry) <= -stop * abs(entry)):
                yield t0, t, held, entry, m, held * (m - entry)
                held = 0
            elif not held and abs(signal) >= enter:
                held, entry, t0 = (1 if signal > 0 else -1), m, t

    return by_session(quotes, fold, "entry_us long, exit_us long, side int, entry double, leave double, pnl double")
