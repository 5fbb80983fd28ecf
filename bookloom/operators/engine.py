"""Matching of windows against a library of templates: gates, a cheap first stage, and the full score for what passes.

Templates come in blocks of a bounded number, one after another: a block is sent to all tasks as matrices, and every batch
of windows is held against it at once.  Gates (instrument, regime, fragility, cost) and the cosine of the first stage are
matrices of windows by templates; only the pairs that pass are gathered for the full score.  Of a window's matches the
best of each block meet at the end.  Nothing is dropped by the first stage that the definition keeps: it is a part of it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Weights of the score's parts, thresholds, tiers, and bounds of volatility regimes.
WEIGHTS = (0.40, 0.35, 0.25)
SCREEN, LEAST, MOST = 0.40, 0.60, 20
TIERS = (("A", 0.85), ("B", 0.72), ("C", 0.0))
REGIMES = (("low", 15.0), ("normal", 25.0), ("elevated", 35.0), ("high", np.inf))
COST_MULTIPLIER, TICK, MOST_CONDITION = 2.0, 0.25, 1000.0

WINDOWS = "window_id long, instrument string, series array<double>, features array<double>, l1 array<double>, vix double, minutes int, volume double, fragility string, atr double, slippage_bps double"
TEMPLATES = "pattern_id string, series array<double>, features array<double>, instruments array<string>, regimes array<string>, vix_regime string, minutes int, fragility string, best_atr double, mean_atr double"
_MATCHES = "window_id long, pattern_id string, score double, cosine double, distance double, context double, stage1 double, regime string, expected_atr double"


def shrunk_covariance(rows: DataFrame, column: str) -> np.ndarray | None:
    """The inverse of the Ledoit-Wolf covariance of a column of vectors of one length; None where there are fewer than two or it is ill-conditioned.

    Sums of a task are one matrix; at most 16 of these reach the driver, twice.
    """

    def sums(mean: np.ndarray | None) -> tuple[int, np.ndarray, np.ndarray, float] | None:
        def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            n, first, second, fourth = 0, 0.0, 0.0, 0.0
            for f in frames:
                if len(f):
                    x = np.stack(f[column].to_numpy()).astype(float)
                    x = x if mean is None else x - mean
                    n, first, second, fourth = n + len(x), first + x.sum(0), second + x.T @ x, fourth + float((x * x).sum(1) @ (x * x).sum(1))
            if n:
                yield pd.DataFrame({"n": [n], "first": [first.tolist()], "second": [second.ravel().tolist()], "fourth": [fourth]})

        found = rows.where(F.col(column).isNotNull()).select(column).coalesce(16).mapInPandas(add, "n long, first array<double>, second array<double>, fourth double").collect()
        if not found:
            return None
        return sum(r["n"] for r in found), sum(np.array(r["first"]) for r in found), sum(np.array(r["second"]) for r in found), sum(r["fourth"] for r in found)

    one = sums(None)
    if one is None or one[0] < 2:
        return None
    n, p = one[0], len(one[1])
    _, _, second, fourth = sums(one[1] / n)
    s = second.reshape(p, p) / n
    level = np.trace(s) / p
    spread = ((s - level * np.eye(p)) ** 2).sum() / p
    noise = min((fourth / n - (s**2).sum()) / n / p, spread)
    share = noise / spread if spread > 0 else 1.0
    cov = (1 - share) * s + share * level * np.eye(p)
    condition = np.linalg.cond(cov)
    return np.linalg.pinv(cov) if np.isfinite(condition) and condition <= MOST_CONDITION else None


def _cosines(a: list[np.ndarray], b: list[np.ndarray], pairs: tuple[np.ndarray, np.ndarray], of_ends: bool, empty: float) -> np.ndarray:
    """Cosines of pairs, over the last (or first) values that both have; `empty` where one has none or is zero."""
    out = np.full(len(pairs[0]), empty)
    size_a, size_b = np.array([len(x) for x in a], np.int64), np.array([len(x) for x in b], np.int64)
    kinds = size_a[pairs[0]] * (1 << 32) + size_b[pairs[1]]
    for kind in np.unique(kinds):
        n = int(min(kind >> 32, kind & 0xFFFFFFFF))
        if not n:
            continue
        at = np.flatnonzero(kinds == kind)
        i, j = pairs[0][at], pairs[1][at]
        cut = (lambda x: x[-n:]) if of_ends else (lambda x: x[:n])
        left, right = ({k: cut(s[k]) for k in np.unique(x)} for s, x in ((a, i), (b, j)))
        for lo in range(0, len(at), 4096):
            x, y = np.stack([left[k] for k in i[lo : lo + 4096]]), np.stack([right[k] for k in j[lo : lo + 4096]])
            norms = np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1)
            dots = np.einsum("ij,ij->i", x, y)
            out[at[lo : lo + 4096]] = np.where(norms > 0, dots / np.where(norms > 0, norms, 1), empty)
    return out


def regime_of(vix: float) -> str:
    return next(name for name, end in REGIMES if vix < end or end == np.inf)


def _gates(w: pd.DataFrame, t: pd.DataFrame) -> np.ndarray:
    """windows x templates: which templates are held against a window at all."""
    listed = lambda values, names: np.array([[v is None or len(v) == 0 or x in v for v in values] for x in names], bool).reshape(len(names), len(values))
    instruments, inverse = np.unique(w["instrument"].fillna("").to_numpy(str), return_inverse=True)
    regimes, of = np.unique(w["regime"].to_numpy(str), return_inverse=True)
    open_ = listed(t["instruments"].tolist(), instruments)[inverse] & listed(t["regimes"].tolist(), regimes)[of]
    tags, known = t["fragility"].to_numpy(object), {"calm", "elevated", "fragile"}
    open_ &= np.array([[x not in known or g is None or g == x for g in tags] for x in w["fragility"]], bool).reshape(open_.shape)
    atr, bps = w["atr"].fillna(0).to_numpy(float), w["slippage_bps"].fillna(0).to_numpy(float)
    least = bps / 10_000 * np.maximum(atr * 100, 100) / TICK * COST_MULTIPLIER
    edge = np.abs(t["best_atr"].to_numpy(float))[None, :] * atr[:, None] / TICK
    return open_ & (np.isnan(edge) | ((atr <= 0) | (bps <= 0))[:, None] | (edge >= least[:, None]))


def _context(w: pd.DataFrame, t: pd.DataFrame, pairs: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    i, j = pairs
    wanted = t["vix_regime"].to_numpy(object)[j]
    regime = np.where(np.array([x is None for x in wanted], bool) | (wanted == w["regime"].to_numpy(object)[i]), 1.0, 0.5)
    away = (t["minutes"].to_numpy(float)[j] - w["minutes"].fillna(0).to_numpy(float)[i]) / 90
    time = np.where(np.isnan(away), 1.0, np.exp(-(np.nan_to_num(away) ** 2)))
    volume = np.clip(w["volume"].fillna(1).to_numpy(float)[i], 0, 3)
    return (regime + time + np.maximum(0, 1 - np.abs(volume - 1) / 2)) / 3


def _held(w: pd.DataFrame, t: pd.DataFrame, inverse: np.ndarray | None, screen: bool) -> tuple[pd.DataFrame, pd.DataFrame]:
    """The matches of a batch of windows, and how many templates each step left."""
    arrays = lambda c: [np.zeros(0) if x is None else np.asarray(x, float) for x in c]
    w = w.assign(regime=[regime_of(0.0 if pd.isna(v) else v) for v in w["vix"]])
    pairs = np.nonzero(_gates(w, t))
    gated = np.bincount(pairs[0], minlength=len(w))
    stage = np.ones(len(pairs[0]))
    if screen:
        stage = np.clip((_cosines(arrays(w["l1"]), arrays(t["features"]), pairs, False, 1.0) + 1) / 2, 0, 1)
        on = stage >= SCREEN
        pairs, stage = (pairs[0][on], pairs[1][on]), stage[on]
    screened = np.bincount(pairs[0], minlength=len(w))
    cosine = _cosines(arrays(w["series"]), arrays(t["series"]), pairs, True, 0.0)
    x, y = arrays(w["features"]), arrays(t["features"])
    distance = np.empty(len(cosine))
    for lo in range(0, len(cosine), 4096):
        d = np.stack([x[i] - y[j] for i, j in zip(pairs[0][lo : lo + 4096], pairs[1][lo : lo + 4096])])
        distance[lo : lo + 4096] = np.sqrt(np.maximum(0, np.einsum("ij,jk,ik->i", d, inverse, d))) if inverse is not None else np.linalg.norm(d, axis=1)
    context = _context(w, t, pairs)
    near = np.where(np.isfinite(distance), 1 / (1 + distance), 0.0)
    score = WEIGHTS[0] * (cosine + 1) / 2 + WEIGHTS[1] * near + WEIGHTS[2] * context
    on = score >= LEAST
    i, j = pairs[0][on], pairs[1][on]
    found = pd.DataFrame({"window_id": w["window_id"].to_numpy()[i], "pattern_id": t["pattern_id"].to_numpy()[j], "score": score[on], "cosine": cosine[on], "distance": distance[on], "context": context[on], "stage1": stage[on], "regime": w["regime"].to_numpy()[i], "expected_atr": t["mean_atr"].fillna(0).to_numpy(float)[j]})
    return found, pd.DataFrame({"window_id": w["window_id"], "templates": len(t), "gated": gated, "screened": screened, "matched": np.bincount(i, minlength=len(w))})


def _blocks(templates: DataFrame, block: int) -> Iterator[pd.DataFrame]:
    parts = 1 + (templates.count() - 1) // block
    for k in range(max(parts, 0)):
        yield templates.where(F.pmod(F.xxhash64("pattern_id"), F.lit(parts)) == k).orderBy("pattern_id").toPandas().replace({np.nan: None}).astype({"best_atr": float, "mean_atr": float, "minutes": float})


def _over(windows: DataFrame, templates: DataFrame, inverse: np.ndarray | None, screen: bool, block: int, which: int, schema: str) -> list[DataFrame]:
    made = []
    for t in _blocks(templates, block):
        shared = windows.sparkSession.sparkContext.broadcast(t)

        def run(frames: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            for f in frames:
                for lo in range(0, len(f), 256):
                    found = _held(f.iloc[lo : lo + 256], shared.value, inverse, screen)[which]
                    if which == 0:  # what cannot be among a window's best goes here
                        found = found.sort_values(["score", "pattern_id"], ascending=[False, True]).groupby("window_id", sort=False).head(MOST)
                    yield found

        made.append(windows.mapInPandas(run, schema))
    return made


def match(windows: DataFrame, templates: DataFrame, inverse: np.ndarray | None = None, screen: bool = True, block: int = 2048) -> DataFrame:
    """The best matches (20 at the most, of a score of 0.60 or more) of every window, with tier and direction.

    windows, templates: the schemas WINDOWS and TEMPLATES; null l1: no first stage; null lists, tags and times of a
    template: any; best_atr (null: no cost gate) is the greatest and mean_atr the first mean outcome of a pattern.  inverse: of the covariance of
    features; None: Euclidean.  Some `block` templates are on the driver and in every task at a time.
    """
    made = _over(windows, templates, inverse, screen, block, 0, _MATCHES)
    if not made:
        made = [windows.sparkSession.createDataFrame([], _MATCHES)]
    every = reduce(DataFrame.unionByName, made)
    best = Window.partitionBy("window_id").orderBy(F.desc("score"), "pattern_id")
    kept = every.withColumn("place", F.row_number().over(best)).where(F.col("place") <= MOST)
    tier = reduce(lambda c, x: c.when(F.col("score") >= x[1], x[0]), TIERS[1:], F.when(F.col("score") >= TIERS[0][1], TIERS[0][0]))
    direction = F.when(F.col("expected_atr") > 0.1, "bull").when(F.col("expected_atr") < -0.1, "bear").otherwise("neutral")
    return kept.withColumns({"tier": tier, "direction": direction})


def funnel(windows: DataFrame, templates: DataFrame, block: int = 2048) -> DataFrame:
    """window_id, templates, gated, screened, matched: how many templates each step leaves, which tells what the first stage saves."""
    made = _over(windows, templates, None, True, block, 1, "window_id long, templates long, gated long, screened long, matched long")
    every = reduce(DataFrame.unionByName, made) if made else windows.sparkSession.createDataFrame([], "window_id long, templates long, gated long, screened long, matched long")
    return every.groupBy("window_id").agg(*[F.sum(c).alias(c) for c in ("templates", "gated", "screened", "matched")])
