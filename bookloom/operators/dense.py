"""Numeric features of a session's series of mid prices: numpy over one (symbol, session) at a time.

A series is the session's mids in order.  One too short for a feature gives no row; constant ones give zeros.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from bookloom.operators.stateful import by_session


def wasserstein(a: np.ndarray, b: np.ndarray) -> float:
    """Area between the two empirical distribution functions."""
    a, b = np.sort(a), np.sort(b)
    at = np.sort(np.concatenate([a, b]))
    fa, fb = (np.searchsorted(x, at[:-1], side="right") / len(x) for x in (a, b))
    return float(np.sum(np.abs(fa - fb) * np.diff(at)))


def analytic(x: np.ndarray) -> np.ndarray:
    """The analytic signal: negative frequencies removed, positive ones doubled."""
    n = len(x)
    gain = np.zeros(n)
    gain[0] = 1
    gain[1 : (n + 1) // 2] = 2
    if n % 2 == 0:
        gain[n // 2] = 1
    return np.fft.ifft(np.fft.fft(x) * gain)


def coherence(x: np.ndarray, y: np.ndarray, segment: int) -> np.ndarray:
    """Welch's magnitude-squared coherence: Hann windows, half overlapped, means removed."""
    window = np.hanning(segment)
    starts = range(0, len(x) - segment + 1, segment // 2)
    fx, fy = (np.array([np.fft.rfft(window * (z[s : s + segment] - z[s : s + segment].mean())) for s in starts]) for z in (x, y))
    cross, px, py = (fx * fy.conj()).mean(0), (abs(fx) ** 2).mean(0), (abs(fy) ** 2).mean(0)
    power = px * py
    return np.divide(abs(cross) ** 2, power, out=np.zeros(len(power)), where=power > 1e-24)


def morlet_energies(x: np.ndarray, scales: tuple[float, ...], w0: float = 6.0) -> np.ndarray:
    """Mean energy of the series' convolution with Morlet wavelets of some scales."""
    x = x - x.mean()
    out = []
    for s in scales:
        t = np.arange(-int(4 * s), int(4 * s) + 1) / s
        wavelet = np.pi**-0.25 * np.exp(1j * w0 * t - t * t / 2) / np.sqrt(s)
        full = np.convolve(x, wavelet)
        start = (len(full) - len(x)) // 2
        out.append(float(np.mean(abs(full[start : start + len(x)]) ** 2)))
    return np.array(out)


def sift(x: np.ndarray, most: int = 8, rounds: int = 10) -> tuple[list[np.ndarray], np.ndarray]:
    """Intrinsic modes and the rest: means of linear envelopes through the extrema are taken off; modes and rest sum to the series."""
    modes, rest, at = [], x.astype(float), np.arange(len(x))
    for _ in range(most):
        h, found = rest.copy(), False
        for _ in range(rounds):
            d = np.diff(h)
            top = np.flatnonzero((d[:-1] > 0) & (d[1:] <= 0)) + 1
            low = np.flatnonzero((d[:-1] < 0) & (d[1:] >= 0)) + 1
            if len(top) < 2 or len(low) < 2:
                break
            found = True
            h = h - (np.interp(at, top, h[top]) + np.interp(at, low, h[low])) / 2
        if not found:
            break
        modes.append(h)
        rest = rest - h
    return modes, rest


def signature(path: np.ndarray, size: int = 20) -> np.ndarray:
    """Level 1 and the symmetric part of level 2 of a path's signature, of length 1, in `size` places."""
    steps = np.diff(path, axis=0)
    before = path[:-1] - path[0]
    two = before.T @ steps + 0.5 * steps.T @ steps
    one = path[-1] - path[0]
    flat = np.concatenate([one, ((two + two.T) / 2)[np.triu_indices(len(one))]])[:size]
    norm = np.linalg.norm(flat)
    return np.pad(flat / norm if norm > 0 else flat, (0, size - len(flat)))


def hawkes(times: np.ndarray, lo: float = 1e-3, hi: float = 10.0, rounds: int = 60, close: float = 1e-3) -> tuple[float, float, float]:
    """mu, alpha, beta of an exponential Hawkes process.

    mu = n / 2T; for each beta, alpha matches the expected number of events to n, alpha = beta (n - mu T) / sum(1 - exp(-beta (T - t))),
    and stays under beta; beta by golden section on the likelihood, in which an event's own jump counts at its time.
    """
    t = times - times[0]
    span, n = t[-1], len(t)
    mu, steps = n / (2 * span), np.diff(t)

    def fitted(beta: float) -> tuple[float, float]:
        reach = float(np.sum(1 - np.exp(-beta * (span - t))))
        alpha = min(max(0.0, beta * (n - mu * span) / reach), 0.999 * beta) if reach > 1e-12 else 0.0
        seen = [1.0]
        for d in np.exp(-beta * steps).tolist():
            seen.append(seen[-1] * d + 1.0)
        return -(float(np.sum(np.log(mu + alpha * np.array(seen)))) - mu * span - alpha / beta * reach), alpha

    ratio = (np.sqrt(5) - 1) / 2
    c, d = hi - ratio * (hi - lo), lo + ratio * (hi - lo)
    at_c, at_d = fitted(c)[0], fitted(d)[0]
    for _ in range(rounds):
        if at_c < at_d:
            hi, d, at_d = d, c, at_c
            c = hi - ratio * (hi - lo)
            at_c = fitted(c)[0]
        else:
            lo, c, at_c = c, d, at_d
            d = lo + ratio * (hi - lo)
            at_d = fitted(d)[0]
        if hi - lo < close:
            break
    beta = (lo + hi) / 2
    return mu, fitted(beta)[1], beta


def _of_session(quotes: DataFrame, least: int, schema: str, f: Callable[[pd.DataFrame], Iterator[tuple]]) -> DataFrame:
    return by_session(quotes, lambda g: f(g) if len(g) >= least else iter(()), schema)


def flux_stark(quotes: DataFrame, window: int = 150, recent: int = 30, tail: int = 5) -> DataFrame:
    """flux: distance of the last `recent` log returns of a window from its others; stark: mean of its last changes; exhaustion from both."""

    def f(g: pd.DataFrame) -> Iterator[tuple]:
        g = g[g["mid"] > 0]
        r, seqs, flux = np.diff(np.log(g["mid"].to_numpy())), g["seq"].tolist()[1:], []
        for i in range(window, len(r) + 1):
            part = r[i - window : i]
            flux.append(wasserstein(part[-recent:], part[:-recent]))
            stark = float(np.mean(np.diff(flux[-tail - 1 :]))) if len(flux) > 1 else 0.0
            yield seqs[i - 1], flux[-1], stark, min(1.0, flux[-1]) * min(1.0, 5 * abs(stark)) if flux[-1] > 0.3 and stark < 0 else 0.0

    return _of_session(quotes, window + 1, "seq long, flux double, stark double, exhaustion double", f)


def wavelets(quotes: DataFrame, step_us: int = 1_000_000, scales: tuple[float, ...] = (2, 4, 8, 16, 32, 64)) -> DataFrame:
    def f(g: pd.DataFrame) -> Iterator[tuple]:
        t = g["ts_us"].to_numpy()
        grid = np.arange(t[0], t[-1] + 1, step_us)
        for s, e in zip(scales, morlet_energies(np.interp(grid, t, g["mid"].to_numpy()), scales)):
            yield float(s), float(e)

    return _of_session(quotes, 4, "scale double, energy double", f)


def modes(quotes: DataFrame, kept: int = 3) -> DataFrame:
    """Energies and rates of sign changes of the first modes; the slope of the rest is the trend."""

    def f(g: pd.DataFrame) -> Iterator[tuple]:
        found, rest = sift(g["mid"].to_numpy())
        slope = float(np.polyfit(np.arange(len(rest)), rest, 1)[0])
        for i, m in enumerate(found[:kept]):
            yield i, float(np.mean(m * m)), float(np.mean(np.diff(np.sign(m)) != 0)), slope

    return _of_session(quotes, 6, "mode int, energy double, crossings double, trend double", f)


def hilbert(quotes: DataFrame) -> DataFrame:
    def f(g: pd.DataFrame) -> Iterator[tuple]:
        x = g["mid"].to_numpy()
        z = analytic(x - x.mean())
        phase = np.unwrap(np.angle(z))
        yield from zip(g["seq"].tolist(), abs(z).tolist(), phase.tolist(), np.gradient(phase / (2 * np.pi)).tolist())

    return _of_session(quotes, 4, "seq long, amplitude double, phase double, frequency double", f)


def depth_coherence(quotes: DataFrame, segment: int = 64) -> DataFrame:
    """Coherence of the mid with the imbalance of sizes: means of the lower and upper half of the spectrum, and the peak."""

    def f(g: pd.DataFrame) -> Iterator[tuple]:
        b, a = g["bid_size"].to_numpy(float), g["ask_size"].to_numpy(float)
        c = coherence(g["mid"].to_numpy(), (b - a) / (b + a), segment)[1:]
        yield float(c[: len(c) // 2].mean()), float(c[len(c) // 2 :].mean()), float(c.max())

    return _of_session(quotes, segment * 2, "low double, high double, peak double", f)


def signatures(quotes: DataFrame) -> DataFrame:
    def f(g: pd.DataFrame) -> Iterator[tuple]:
        t = np.linspace(0, 1, len(g))
        path = np.column_stack([t, g["mid"], g["bid_size"] - g["ask_size"]]).astype(float)
        yield (signature(path).tolist(),)

    return _of_session(quotes, 2, "signature array<double>", f)


def hawkes_fit(quotes: DataFrame) -> DataFrame:
    def f(g: pd.DataFrame) -> Iterator[tuple]:
        t = g["ts_us"].to_numpy() / 1e6
        if t[-1] > t[0]:
            yield tuple(map(float, hawkes(t)))

    return _of_session(quotes, 10, "mu double, alpha double, beta double", f)


def bootstrap_gain(scores: DataFrame, rounds: int = 1000, seed: int = 7, least: float = 0.02) -> DataFrame:
    """Gain of `model` over `base` (squared error against y) with a paired bootstrap's 95 % interval, by symbol and session; passes if the gain is at least `least` and the interval is above 0."""

    def f(g: pd.DataFrame) -> Iterator[tuple]:
        d = ((g["base"] - g["y"]) ** 2 - (g["model"] - g["y"]) ** 2).to_numpy()
        rng, some = np.random.default_rng(seed), max(1, 1_000_000 // len(d))  # rounds at once: the draws are those of one call, a few MB at a time
        means = np.concatenate([d[rng.integers(0, len(d), (min(some, rounds - i), len(d)))].mean(1) for i in range(0, rounds, some)])
        lo, hi = np.percentile(means, [2.5, 97.5])
        yield float(d.mean()), float(lo), float(hi), bool(d.mean() >= least and lo > 0)

    return by_session(scores, f, "gain double, low double, high double, passes boolean")


def augment(quotes: DataFrame, seed: int = 7, noise: float = 0.01, scale: float = 0.1) -> DataFrame:
    """A scaled and noisy copy of every session's mids, the same for the same session."""

    def f(g: pd.DataFrame) -> Iterator[tuple]:
        rng = np.random.default_rng([seed, int(g["ts_us"].iloc[0]) % (1 << 32), *g["symbol"].iloc[0].encode()])
        x = g["mid"].to_numpy()
        made = x.mean() + (x - x.mean()) * (1 + scale * rng.uniform(-1, 1)) + noise * x.std() * rng.standard_normal(len(x))
        yield from zip(g["seq"].tolist(), x.tolist(), made.tolist())

    return by_session(quotes, f, "seq long, mid double, made double")
