"""The fragility index with its six parts, on a caller's quotes, passive adds, toxicity and stress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookloom.operators.frames import LEAST_BLOCK_US, frame_sums, last_until

SECOND = 1_000_000
# Weights of the parts (depth, cancels, refresh, spread, toxicity, stress), scales and thresholds.
FAST = {"RF": 0.35, "SF": 0.35, "FT": 0.30}
FULL = {"DF": 0.20, "CF": 0.15, "RF": 0.20, "SF": 0.15, "FT": 0.15, "CIS": 0.15}
FALL_PER_S, CHURN_PER_S, REFRESH_PER_S, SPREAD_TICKS = 200.0, 100.0, 50.0, 4.0
ELEVATED, REDUCE = 0.60, 0.70


def _clip(c: Column) -> Column:
    known = c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))
    return F.when(known, F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))).otherwise(0.0)


def depth_rate(quotes: DataFrame, before_us: int) -> DataFrame:
    """symbol, seq, rate: change of depth a second since the last quote `before_us` ago or earlier (0 without one); by blocks of time."""
    depth = (F.col("bid_size") + F.col("ask_size")).cast("double")
    rows = quotes.select("symbol", "ts_us", "seq", depth.alias("depth"))
    facts = rows.groupBy("symbol", F.col("ts_us").alias("at_us")).agg(F.max_by("depth", "seq").alias("was"))
    asked = rows.withColumn("ts_us", F.col("ts_us") - before_us)
    met = last_until(asked, facts, ["was"], max(before_us, LEAST_BLOCK_US))
    return met.select("symbol", "seq", F.coalesce((F.col("depth") - F.col("was")) / (before_us / SECOND), F.lit(0.0)).alias("rate"))


def refresh_rates(quotes: DataFrame, adds: DataFrame, window_us: int) -> DataFrame:
    """symbol, seq, bid_rate, ask_rate: passive adds at the best a second over the window up to each quote; adds: symbol, ts_us, side."""
    both = quotes.select("symbol", "ts_us", "seq", F.lit(None).cast("string").alias("side")).unionByName(adds.select("symbol", "ts_us", F.lit(None).cast("long").alias("seq"), "side"))
    counts = {f"{k}_rate": F.when(F.col("side") == s, 1) for k, s in (("bid", "B"), ("ask", "A"))}
    sums = frame_sums(both, counts, window_us).where("seq is not null")
    return sums.select("symbol", "seq", *[(F.col(c) / (window_us / SECOND)).alias(c) for c in counts])


def fragility(quotes: DataFrame, adds: DataFrame, vpin: DataFrame, stress: DataFrame | None = None, tick: float = 0.25, fast_us: int = 5 * SECOND, slow_us: int = 30 * SECOND, window_us: int = SECOND, fall: float = FALL_PER_S, churn: float = CHURN_PER_S, refresh: float = REFRESH_PER_S, wide: float = SPREAD_TICKS) -> DataFrame:
    """symbol, seq, DF, CF, RF, SF, FT, CIS, fi_fast, fi_full, signal_threshold, size_multiplier of each quote.

    quotes: symbol, ts_us, seq (unique in the symbol), bid, ask, bid_size, ask_size; adds: symbol, ts_us, side of passive adds at
    the best; vpin: symbol, at_us, vpin; stress: symbol, at_us, stress.  What is not known yet is 0; every part is cut to 0..1.
    fall, churn, refresh, wide: what a part is divided by (changes of depth and adds a second, ticks over one).
    """
    block = max(slow_us, LEAST_BLOCK_US)
    base = quotes.select("symbol", "ts_us", "seq", ((F.col("ask") - F.col("bid")) / tick).alias("ticks"))
    base = last_until(base, vpin.select("symbol", "at_us", "vpin"), ["vpin"], block)
    base = base.withColumn("stress", F.lit(0.0)) if stress is None else last_until(base, stress.select("symbol", "at_us", "stress"), ["stress"], block)
    fast, slow = (depth_rate(quotes, w).withColumnRenamed("rate", c) for w, c in ((fast_us, "fast"), (slow_us, "slow")))
    met = base.join(fast, ["symbol", "seq"]).join(slow, ["symbol", "seq"]).join(refresh_rates(quotes, adds, window_us), ["symbol", "seq"])
    parts = {
        "DF": _clip(-F.col("fast") / fall), "CF": _clip(F.abs("slow") / churn), "RF": _clip((F.col("bid_rate") + F.col("ask_rate")) / refresh),
        "SF": _clip((F.col("ticks") - 1) / wide), "FT": _clip(F.col("vpin")), "CIS": _clip(F.col("stress")),
    }
    out = met.select("symbol", "seq", *[v.alias(k) for k, v in parts.items()])
    fi_fast, fi_full = (sum((F.col(k) * w for k, w in weights.items()), F.lit(0.0)) for weights in (FAST, FULL))
    out = out.withColumns({"fi_fast": F.round(fi_fast, 9), "fi_full": F.round(fi_full, 9)})
    return out.withColumns({"signal_threshold": F.when(F.col("fi_fast") > ELEVATED, 0.40).otherwise(0.55), "size_multiplier": F.when(F.col("fi_full") > REDUCE, 0.5).otherwise(1.0)})
