"""The bootstrap of a session: the figures of one call that draws all rounds, without holding them."""

import tracemalloc

import numpy as np
import pandas as pd

from bookloom.operators import dense


def test_gain_in_slices(monkeypatch):
    monkeypatch.setattr(dense, "by_session", lambda scores, f, schema: f)
    r = np.random.default_rng(3)
    for n in (1, 777, 30_001):
        g = pd.DataFrame({"y": r.integers(0, 2, n) * 1.0, "base": 0.5, "model": r.random(n)})
        d = ((g["base"] - g["y"]) ** 2 - (g["model"] - g["y"]) ** 2).to_numpy()
        means = d[np.random.default_rng(7).integers(0, n, (1000, n))].mean(1)
        f = dense.bootstrap_gain(None)
        tracemalloc.start()
        gain, low, high, passes = next(iter(f(g)))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        lo, hi = np.percentile(means, [2.5, 97.5])
        assert (gain, low, high) == (d.mean(), lo, hi) and passes == (gain >= 0.02 and lo > 0)
        assert peak < 60_000_000  # all rounds at once: 480 MB for the last
