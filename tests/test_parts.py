"""Statements by parts against the same statements over whole symbols, and barriers against a scan of what comes."""

import numpy as np
import pytest

from bookloom.catalog import OPERATORS
from bookloom.operators import barriers, frames, halo
from bookloom.sources import mbo as source

S = 1_000_000


@pytest.fixture(scope="module")
def tables(spark):
    """Bursts of ties, long pauses, a symbol with a bar and a minus in its name, times before 0."""
    r = np.random.default_rng(2)
    rows = []
    for symbol, n in (("A|-3", 1200), ("B", 700), ("C", 3)):
        ts = np.cumsum(np.where(r.random(n) < 0.3, 0, r.integers(1, 40, n)) + (r.random(n) < 0.01) * 5000) * S - 10_000 * S
        rows += [(len(rows) + i, int(ts[i]), int(r.integers(1, 100)), i % 7, "ACMFT"[r.integers(5)], "BA"[r.integers(2)], float(r.integers(40)) / 4 + 0.25, symbol) for i in range(n)]
    mbo = spark.createDataFrame(rows, "seq long, ts_us long, size long, order_id long, action string, side string, price double, symbol string")
    return {"mbo": mbo, "quotes": source.quotes(spark, mbo)}


@pytest.mark.parametrize("name", sorted(halo.HALOS))
def test_parts_equal_the_whole(spark, tables, name):
    op, scale = OPERATORS[name], {"w": 60 * S, "h": 90 * S, "h1": 30 * S, "h2": 60 * S, "h3": 200 * S}
    params = {k: scale[k] for k in op.defaults if k in scale and not halo.HALOS[name].rows}
    whole = op.apply(spark, {t: tables[t] for t in op.tables()}, **params)
    parts = halo.by_parts(op, halo.HALOS[name], spark, {t: tables[t] for t in op.tables()}, **params)
    key = lambda r: tuple((x is None, x) for x in r)
    got, exp = (sorted(map(tuple, x.select(whole.columns).collect()), key=key) for x in (parts, whole))
    assert got == exp and len(got) > 500


@pytest.mark.parametrize("name", ["l1_velocities", "l1_micro_velocity", "l2_depth_change", "jn07_asof_backward"])
def test_blocks_equal_the_whole(spark, tables, name):
    op = OPERATORS[name]
    params = {**op.defaults, **{k: 60 * S for k in ("w", "ahead") if k in op.defaults}}
    whole = op.apply(spark, {t: tables[t] for t in op.tables()}, **params)
    got, exp = (sorted(map(tuple, x.select(whole.columns).collect()), key=str) for x in (frames.OPERATORS[name](tables["mbo"], tables["quotes"], **params), whole))
    assert got == exp and len(got) > 1000


@pytest.mark.parametrize("horizon", [7, 100, 3000])
def test_barriers(spark, tables, horizon):
    quotes = tables["quotes"].where("mid > 0")
    rows = sorted(quotes.select("symbol", "ts_us", "seq", "mid").collect(), key=lambda r: r[:3])
    got = {(r.symbol, r.seq): r for r in barriers.first_hits(tables["quotes"], horizon * S, 2.0, 1.5).collect()}
    assert len(got) == len(rows)
    for symbol in {r.symbol for r in rows}:
        own = [r for r in rows if r.symbol == symbol]
        ts, mid = np.array([r.ts_us for r in own]), np.array([r.mid for r in own])
        for i, r in enumerate(own):
            ahead = np.flatnonzero((ts > ts[i]) & (ts <= ts[i] + horizon * S))
            up, down = (next((int(ts[j]) for j in ahead if hit(mid[j])), -1) for hit in (lambda m: m >= mid[i] + 2.0, lambda m: m <= mid[i] - 1.5))
            label = 1 if up >= 0 and (down < 0 or up < down) else -1 if down >= 0 else 0 if ts[i] + horizon * S <= ts[-1] else None
            g = got[symbol, r.seq]
            assert (g.up_us, g.down_us, g.seen, g.label) == (up, down, len(ahead), label)
            assert (g.mfe, g.mae) == ((mid[ahead].max() - mid[i], mid[i] - mid[ahead].min()) if len(ahead) else (None, None))
