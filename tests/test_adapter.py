"""Level-one events of snapshots against a walk through them."""

import numpy as np

from bookloom.operators import adapter

SNAPS = "symbol string, snap long, bid double, ask double"
EVENTS = "symbol string, snap long, seq long, order_id long, ts_us long, action string, side string, price double, size long, aggressive boolean"


def _walk(snaps, events):
    seen, adds, before = set(), [], {}
    for symbol, snap, bid, ask in snaps:
        bid, ask = bid or 0.0, ask or 0.0
        bid0, ask0 = before.get(symbol, (bid, ask))
        for s, at, seq, order, ts, action, side, price, _, aggressive in events:
            if (s, at) != (symbol, snap) or action != "A" or aggressive or (s, order, ts) in seen:
                continue
            seen.add((s, order, ts))
            if abs(price - (max(bid, bid0) if side == "B" else min(ask, ask0))) < 0.125:
                adds.append((s, seq, ts, side))
        before[symbol] = bid, ask
    return sorted(adds)


def _tables():
    r = np.random.default_rng(3)
    snaps = [(s, int(10 * i), None if r.integers(12) == 0 else 99 + float(r.integers(3)) / 4, 101 - float(r.integers(3)) / 4) for s in "ab" for i in range(60)]
    events = [("ab"[int(r.integers(2))], int(10 * r.integers(60)), i, int(r.integers(600)), int(r.integers(4)), "AAAC"[int(r.integers(4))], "BA"[i % 2], 99 + float(r.integers(9)) / 4, 1, bool(r.integers(5) == 0)) for i in range(4000)]
    return snaps, sorted(events, key=lambda e: (e[1], e[2]))


def test_passive_adds(spark):
    snaps, events = _tables()
    for block in (10, 70, 10_000):
        got = adapter.passive_adds(spark.createDataFrame(snaps, SNAPS), spark.createDataFrame(events, EVENTS), block=block)
        assert sorted(map(tuple, got.collect())) == _walk(snaps, events)
    assert len(_walk(snaps, events)) > 100


def test_trade_sides(spark):
    snaps = [("a", 0, 99.0, 101.0), ("a", 1, None, 101.0)]
    rows = [("a", 0, 1, 1, 0, "T", "B", 100.5, 2), ("a", 0, 2, 2, 0, "T", "B", 99.5, 2), ("a", 0, 3, 3, 0, "T", "B", 100.0, -2), ("a", 0, 4, 4, 0, "T", "A", 100.0, None), ("a", 1, 5, 4, 0, "T", "A", 90.0, 9), ("a", 1, 6, 6, 0, "T", "B", 90.0, 9)]
    trades = spark.createDataFrame([(*x, None) for x in rows], EVENTS)
    got = sorted((r.seq, r.side, r["size"]) for r in adapter.trade_sides(spark.createDataFrame(snaps, SNAPS), trades).collect())
    assert got == [(1, "ask", 2), (2, "bid", 2), (3, "bid", 2), (4, "ask", 0), (6, "ask", 9)]


def test_empty(spark):
    snaps, events = spark.createDataFrame([], SNAPS), spark.createDataFrame([], EVENTS)
    assert adapter.passive_adds(snaps, events).collect() == [] and adapter.trade_sides(snaps, events).collect() == []
