"""Queues, fills, limits, levels, dense features and learned parts against plain computations."""

import numpy as np
import pandas as pd
import pytest

from bookloom import catalog
from bookloom.operators import dense, models, queues
from bookloom.sources import mbo as source

DATA = "/root/testdata/sf0.001"
T0 = 1_700_000_000_000_000


def events(spark, rows):
    """(seconds, action, side, order, price, size) of one symbol."""
    return spark.createDataFrame([("ES", i, o, T0 + int(t * 1e6), a, s, float(p), int(v)) for i, (t, a, s, o, p, v) in enumerate(rows)], "symbol string, seq long, order_id long, ts_us long, action string, side string, price double, size long")


def test_queue_rules(spark):
    rows = [(0, "A", "B", 1, 100, 10), (1, "A", "B", 2, 100, 5), (2, "F", "B", 9, 100, 4), (3, "A", "B", 3, 100, 1), (4, "M", "B", 1, 100, 2), (5, "M", "B", 1, 100, 7), (6, "M", "B", 8, 100, 3), (7, "C", "B", 2, 100, 0), (8, "A", "B", 4, 100, 1), (9, "C", "B", 77, 100, 1)]
    got = {r["seq"]: (r["ahead"], r["total"]) for r in queues.queue_positions(events(spark, rows)).collect()}
    # a fill takes 4 from the front; a smaller size keeps its place, a larger one goes to the back; an unknown change is an add
    assert got == {0: (0, 10), 1: (10, 15), 3: (11, 12), 4: (0, 8), 5: (6, 13), 6: (13, 16), 8: (11, 12)}
    half = events(spark, [(0, "A", "B", 1, 100, 10), (1, "A", "B", 2, 100, 10), (2, "F", "B", 9, 100, 10), (3, "A", "B", 3, 100, 1)])
    assert [r["ahead"] for r in queues.queue_positions(half, pro_rata=True).orderBy("seq").collect()][-1] == 10.0


def test_fills_end_in_one_of_four_ways(spark):
    rows = [(0, "A", "B", 1, 100, 5), (1, "F", "B", 9, 100, 6), (10, "A", "B", 2, 100, 5), (100, "T", "A", 3, 101, 1), (101, "A", "B", 4, 100, 5), (102, "T", "A", 3, 90, 1)]
    mbo = events(spark, rows)
    quotes = mbo.selectExpr("symbol", "seq", "price AS mid")
    got = {r["seq"]: (r["reason"], r["ahead"]) for r in queues.simulate_fills(mbo, quotes, every=1).collect()}
    assert got == {0: ("filled", 5.0), 2: ("timeout", 5.0), 4: ("adverse", 10.0)}


def test_limits(spark):
    trades = spark.createDataFrame([("ES", 0, 0, 100, 1, -600.0), ("ES", 0, 10, 50, 1, 1.0), ("NQ", 0, 20, 60, 1, 1.0), ("NQ", 0, 200, 300, 1, 1.0)], "symbol string, session long, entry_us long, exit_us long, side int, pnl double")
    assert [r["decision"] for r in queues.position_limits(trades).orderBy("entry_us").collect()] == ["open", "pattern", "open", "halt"]


def test_levels_and_gaps(spark):
    rows = [(t, "A", "B", t, 100, 100) for t in range(0, 9)] + [(t + 0.5, "F", "B", 50, 100, 5) for t in range(5, 9)] + [(t, "A", "A", 60 + t, 100, 10) for t in range(0, 9)] + [(9, "A", "A", 99, 101, 10)]
    got = [r["state"] for r in queues.track_levels(events(spark, sorted(rows)), step_us=1_000_000, age_us=3_000_000).where("side = 'B' and price = 100").orderBy("snap").collect()]
    assert got == ["forming"] * 2 + ["resting"] * 2 + ["tested"] * 2 + ["defended"] * 2 + ["pulled"]
    found = queues.bursts(events(spark, [(t / 100, "A", "B", t, 100, 1) for t in range(300)]), least=5)
    at = sorted(r["seq"] for r in found.collect())
    assert at == [4, 104, 204]


def test_dense_features():
    rng = np.random.default_rng(1)
    assert dense.wasserstein(np.array([0.0, 1, 3]), np.array([5.0, 6, 8])) == pytest.approx(5)
    t = np.arange(256)
    x = np.cos(2 * np.pi * 8 * t / 256)
    assert np.allclose(abs(dense.analytic(x)), 1) and np.allclose(dense.analytic(x).real, x)
    y = rng.standard_normal(512)
    assert np.allclose(dense.coherence(y, 3 * y, 64), 1) and dense.coherence(y, rng.standard_normal(512), 32).mean() < 0.3
    modes, rest = dense.sift(x + 0.01 * t + 0.3 * np.sin(t))
    assert modes and np.allclose(sum(modes) + rest, x + 0.01 * t + 0.3 * np.sin(t))
    e = dense.morlet_energies(np.cos(2 * np.pi * t / 16), (4, 16, 64))
    assert int(np.argmax(e)) == 1  # a period of 16 answers at scale 16 * 6 / 2 pi
    path = np.array([[0.0, 0], [1, 0], [1, 1]])
    s = dense.signature(path)
    assert np.linalg.norm(s) == pytest.approx(1) and s[:5] / s[0] == pytest.approx([1, 1, 0.5, 0.5, 0.5])
    times = np.sort(rng.uniform(0, 100, 200))
    mu, alpha, beta = dense.hawkes(times)
    assert mu == pytest.approx(200 / (2 * (times[-1] - times[0]))) and alpha == pytest.approx(_alpha(times - times[0], mu, beta)) and 1e-3 <= beta <= 10


def _alpha(t, mu, beta):
    reach = sum(1 - np.exp(-beta * (t[-1] - x)) for x in t)
    return min(max(0.0, beta * (len(t) - mu * t[-1]) / reach), 0.999 * beta)


def test_hawkes_against_a_grid():
    """The likelihood by its formula, each intensity summed anew, over a grid of beta."""
    r = np.random.default_rng(2)
    times = np.sort(np.concatenate([x + r.exponential(2.0, 10).cumsum() for x in r.uniform(0, 900, 12)]))
    t = times - times[0]
    mu = len(t) / (2 * t[-1])

    def loss(beta):
        alpha = _alpha(t, mu, beta)
        intensity = [mu + alpha * sum(np.exp(-beta * (x - y)) for y in t[: i + 1]) for i, x in enumerate(t)]
        return -(sum(np.log(intensity)) - mu * t[-1] - alpha / beta * sum(1 - np.exp(-beta * (t[-1] - x)) for x in t))

    found, alpha, beta = dense.hawkes(times)
    assert found == pytest.approx(mu) and alpha == pytest.approx(_alpha(t, mu, beta)) and 0 < alpha / beta < 1
    assert loss(beta) <= min(loss(x) for x in np.linspace(1e-3, 10, 25)) + 1e-2


def test_ema_and_anchors_follow_a_loop(spark):
    quotes = source.quotes(spark, source.read(spark, DATA))
    rows = quotes.toPandas().sort_values(["symbol", "ts_us", "seq"])
    x, key, want = 0.0, None, {}
    for r in rows.itertuples():
        if key != (r.symbol, r.ts_us // 86_400_000_000):
            key, x = (r.symbol, r.ts_us // 86_400_000_000), 0.0
        x = 0.1 * (r.bid_size - r.ask_size) / (r.bid_size + r.ask_size) + 0.9 * x
        want[r.symbol, r.seq] = x
    got = {(r["symbol"], r["seq"]): r["ema"] for r in queues.imbalance_ema(quotes).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    kept = queues.anchors(quotes, move=20.0, gap_us=3_600_000_000).toPandas().sort_values(["symbol", "session", "at_us"])
    gaps = kept.groupby(["symbol", "session"])["at_us"].diff().dropna()
    assert len(kept) and (gaps >= 3_600_000_000).all() and (kept["move"].abs() >= 20).all()


def test_learned(spark):
    auc = models._auc(spark.createDataFrame([(1, 0.1, 0.0), (1, 0.4, 1.0), (1, 0.4, 0.0), (1, 0.9, 1.0)], "fold int, p double, y double"), ["fold"]).first()["auc"]
    assert auc == pytest.approx(3.5 / 4)
    quotes = source.quotes(spark, source.read(spark, DATA))
    got = models.learned_regime(quotes).toPandas()
    p, share = np.array(got["p"].tolist()), got["regime"].value_counts(normalize=True)
    assert set(share.index) == {0, 1, 2, 3} and np.allclose(p.sum(1), 1) and (p.argmax(1) == got["predicted"]).all()
    assert -np.log(p[np.arange(len(p)), got["regime"]]).mean() <= -(share * np.log(share)).sum() + 1e-6  # no worse than the classes' shares
    z = models.latent(spark.read.parquet(f"{DATA}/embeddings.parquet"), 2).toPandas()
    x = np.array(spark.read.parquet(f"{DATA}/embeddings.parquet").orderBy("vec_id").toPandas()["embedding"].tolist())
    values = np.linalg.eigvalsh(np.cov(x.T))[::-1]
    assert np.var(np.array(z["z"].tolist()), axis=0, ddof=1) == pytest.approx(values[:2], rel=1e-4)


def test_gain_and_augmentation_repeat(spark):
    quotes = source.quotes(spark, source.read(spark, DATA))
    a, b = (dense.augment(quotes).orderBy("symbol", "seq").toPandas() for _ in range(2))
    pd.testing.assert_frame_equal(a, b)
    for r in catalog.queries()["cv04_gain"](spark, DATA).collect():
        assert r["low"] <= r["gain"] + 1e-9 and r["gain"] <= r["high"] + 1e-9 and (not r["passes"] or r["low"] > 0)
