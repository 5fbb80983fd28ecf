"""Places of rows, rolling quantile tiers and path signatures, by blocks: no symbol and no session is one task.

A row's place is its number within a block of time and what the blocks before hold.  A frame of the last H rows lies
in two neighbouring chunks of H places, so a chunk and the one before it are all that a task needs.  A signature is a product:
blocks have signatures of their own, and that of the whole follows from those of its parts in order.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bookloom.operators.frames import with_previous

DAY = 86_400_000_000
# Names and shares of the tiers, the strictest first.
TIERS = (("A_strict", 0.995), ("A_relaxed", 0.99), ("B", 0.975))


def with_place(rows: DataFrame, block_us: int = DAY, key: str = "symbol") -> DataFrame:
    """Adds `place`, from 0 on, in the order of (ts_us, seq) within the key; the windows over blocks see one row a block."""
    cut = rows.withColumn("block", F.floor(F.col("ts_us") / block_us))
    inside, over = Window.partitionBy(key, "block").orderBy("ts_us", "seq"), Window.partitionBy(key).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = cut.groupBy(key, "block").agg(F.count(F.lit(1)).alias("n")).select(key, "block", F.coalesce(F.sum("n").over(over), F.lit(0)).alias("before"))
    placed = cut.withColumn("inside", F.row_number().over(inside) - 1).join(before, [key, "block"])
    return placed.select(*rows.columns, (F.col("before") + F.col("inside")).alias("place"))


def _quantile(ordered: list[float], q: float) -> float:
    at = q * (len(ordered) - 1)
    low = int(at)
    high = min(low + 1, len(ordered) - 1)
    return ordered[low] + (ordered[high] - ordered[low]) * (at - low)


def rolling_tiers(scores: DataFrame, history: int = 10_000, warmup: int = 1_000, tiers: tuple[tuple[str, float], ...] = TIERS, block_us: int = DAY) -> DataFrame:
    """symbol, seq, tier: the strictest tier whose quantile of the last `history` scores, this one included, the score reaches.

    scores: symbol, ts_us, seq, p (null: no observation, left out).  Fewer than `warmup` scores or no tier reached: null.
    Quantiles are exact, interpolated linearly; a task holds two chunks of `history` rows.
    """
    placed = with_place(scores.where("p is not null").select("symbol", "ts_us", "seq", F.col("p").cast("double").alias("p")), block_us)
    chunk = F.floor(F.col("place") / history)
    both = placed.withColumn("chunk", F.explode(F.array(chunk, chunk + 1)))  # its own, and the one that looks back on it

    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("place")
        p, place = g["p"].tolist(), g["place"].tolist()
        ordered: list[float] = []
        names: list[str | None] = []
        for i, x in enumerate(p):
            insort(ordered, x)
            if len(ordered) > history:
                del ordered[bisect_left(ordered, p[i - history])]
            names.append(next((t for t, q in tiers if x >= _quantile(ordered, q)), None) if len(ordered) >= warmup else None)
        own = [x >= key[1] * history for x in place]
        return pd.DataFrame({"symbol": key[0], "seq": g["seq"], "tier": pd.Series(names, index=g.index, dtype=object)})[own]

    return both.groupBy("symbol", "chunk").applyInPandas(run, "symbol string, seq long, tier string")


def _product(a: list[np.ndarray], b: list[np.ndarray]) -> list[np.ndarray]:
    """Signature of a path from those of its two parts."""
    out = [a[0] + b[0]]
    if len(a) > 1:
        out.append(a[1] + b[1] + np.multiply.outer(a[0], b[0]))
    if len(a) > 2:
        out.append(a[2] + b[2] + np.multiply.outer(a[1], b[0]) + np.multiply.outer(a[0], b[1]))
    return out


def _block_sums(steps: DataFrame, keys: list[str], moves: list[Column], depth: int) -> DataFrame:
    """keys, block, n and the iterated sums of the moves (their products over rows in strict order) within each block, one array a level."""
    d = range(len(moves))
    inside = Window.partitionBy(*keys, "block").orderBy("ts_us", "seq").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(inside), F.lit(0.0))
    rows = steps.select(*keys, "block", "ts_us", "seq", *[m.cast("double").alias(f"d{i}") for i, m in enumerate(moves)])
    rows = rows.withColumns({f"x{i}": before(f"d{i}") for i in d})
    levels = [[f"d{i}" for i in d]]
    if depth > 1:
        rows = rows.withColumns({f"x{i}_{j}": F.col(f"x{i}") * F.col(f"d{j}") for i in d for j in d})
        levels.append([f"x{i}_{j}" for i in d for j in d])
    if depth > 2:
        rows = rows.withColumns({f"y{i}_{j}": before(f"x{i}_{j}") for i in d for j in d})
        rows = rows.withColumns({f"z{i}_{j}_{k}": F.col(f"y{i}_{j}") * F.col(f"d{k}") for i in d for j in d for k in d})
        levels.append([f"z{i}_{j}_{k}" for i in d for j in d for k in d])
    sums = rows.groupBy(*keys, "block").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for names in levels for c in names])
    return sums.select(*keys, "block", "n", *[F.array(*names).alias(f"level{k}") for k, names in enumerate(levels, 1)])


def signatures(rows: DataFrame, values: list[str], depth: int = 2, augmentation: str = "time", normalize: bool = True, slots: int | None = None, block_us: int = 3_600_000_000) -> DataFrame:
    """symbol, session, n, signature of the path of `values` over each session of each symbol, in the order of (ts_us, seq).

    Level two is symmetrised, level three is not; with `slots` the first so many coefficients, padded by zeros.
    augmentation: "time" (an axis from 0 to 1 comes first), "lead_lag" (each value beside the one before it; one value)
    or "none".  Sessions of fewer than 3 rows have zeros; rows with a null value are left out.  A session's blocks, a row
    each, meet in one task.
    """
    kept = rows.where(" and ".join(f"{v} is not null" for v in values)).withColumn("session", F.col("ts_us") - F.pmod(F.col("ts_us"), F.lit(DAY)))
    counts = kept.groupBy("symbol", "session").agg(F.count(F.lit(1)).alias("points"))
    steps = with_previous(kept.select("symbol", "ts_us", "seq", "session", *values), ["session", *values], block_us).where("session = prev_session")
    moves = [F.col(v) - F.col(f"prev_{v}") for v in values]
    if augmentation == "time":
        moves = [F.lit(1.0), *moves]  # scaled to the length of the path at the end
    elif augmentation == "lead_lag":
        steps = _again(steps, moves[0], block_us)
        moves = [F.col("move"), F.col("prev_move")]
    dims = len(moves)
    size = sum(dims**k for k in range(1, depth + 1))
    blocks = _block_sums(steps.withColumn("block", F.floor(F.col("ts_us") / block_us)), ["symbol", "session"], moves, depth)
    names = [f"level{k}" for k in range(1, depth + 1)]

    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        whole = None
        for r in g.sort_values("block").itertuples(index=False):
            part = [np.array(getattr(r, c), float).reshape((dims,) * k) for k, c in enumerate(names, 1)]
            whole = part if whole is None else _product(whole, part)
        points = int(g["points"].iloc[0])
        if augmentation == "time":
            scale = np.ones(dims)
            scale[0] = 1 / (points - 1)
            whole = [x * _powers(scale, k) for k, x in enumerate(whole, 1)]
        if depth > 1:
            whole[1] = (whole[1] + whole[1].T) / 2
        flat = np.concatenate([x.ravel() for x in whole])
        norm = np.linalg.norm(flat)
        flat = flat / norm if normalize and norm > 0 else flat
        return pd.DataFrame({"symbol": [key[0]], "session": [key[1]], "signature": [_cut(flat, slots)]})

    made = blocks.join(counts.where("points >= 3"), ["symbol", "session"]).groupBy("symbol", "session").applyInPandas(run, "symbol string, session long, signature array<double>")
    zeros = F.array_repeat(F.lit(0.0), slots or size)
    return counts.join(made, ["symbol", "session"], "left").select("symbol", "session", F.col("points").alias("n"), F.coalesce("signature", zeros).alias("signature"))


def _again(steps: DataFrame, move: Column, block_us: int) -> DataFrame:
    """The moves with the move before each, from the second on."""
    first = steps.select("symbol", "ts_us", "seq", "session", move.alias("move"))
    return with_previous(first, ["session", "move"], block_us).where("session = prev_session")


def _powers(scale: np.ndarray, k: int) -> np.ndarray:
    out = scale
    for _ in range(k - 1):
        out = np.multiply.outer(out, scale)
    return out


def _cut(flat: np.ndarray, slots: int | None) -> list[float]:
    if slots is None:
        return flat.tolist()
    return [*flat[:slots].tolist(), *[0.0] * (slots - len(flat))]
