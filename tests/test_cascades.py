"""Thinning, ignitions, withdrawals and contagion against plain walks, with ties and across borders of blocks."""

from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from bookloom.operators import cascades

S = cascades.SECOND


def _walk(rows, gap):
    """rows: (symbol, ts, seq, ...) -> those that a walk by symbol keeps."""
    last, kept = {}, []
    for r in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        if r[0] not in last or r[1] - last[r[0]] >= gap:
            last[r[0]] = r[1]
            kept.append(r)
    return kept


@pytest.mark.parametrize(("seed", "gap", "spread"), [(1, 5, 4), (2, 50, 3), (3, 1, 2), (4, 1000, 40), (5, 0, 3)])
def test_thinning(spark, seed, gap, spread):
    r = np.random.default_rng(seed)
    rows = []
    for symbol, n in (("A", 700), ("B", 60), ("C", 1)):
        ts = np.cumsum(r.integers(0, spread, n)) - 200  # some before time 0, many ties
        ts[n // 2 :] += 10 * gap * (symbol == "B")
        rows += [(symbol, int(t), int(i)) for i, t in enumerate(ts)]
    table = spark.createDataFrame(rows, "symbol string, ts_us long, seq long")
    assert sorted(map(tuple, cascades.thinned(table, gap).select("symbol", "ts_us", "seq").collect())) == sorted(_walk(rows, gap))
    assert cascades.thinned(table.where("false"), gap).count() == 0


def _states(spark, seed):
    r = np.random.default_rng(seed)
    names = ["BULL_STREAK", "BEAR_STREAK", "BULL_STALL", "BEAR_STALL", "BALANCED", None]
    rows, t = [], 0
    for i in range(1200):
        t += int(r.integers(0, 4)) * S
        state = rows[-1][3] if rows and r.random() < 0.8 else names[r.integers(len(names))]
        rows.append(("XY"[int(i % 7 == 0)], t, i, state, int(r.integers(1, 8)), float(r.integers(1, 9)) / 2, None if r.random() < 0.02 else float(r.integers(0, 6)) / 2, int(r.integers(1, 6)), float(r.random())))
    return rows, spark.createDataFrame(rows, "symbol string, ts_us long, seq long, state string, streak_length int, streak_velocity double, pressure_acceleration double, stall_count int, streak_exhaustion double")


@pytest.mark.parametrize("block", [7 * S, 3600 * S])
def test_ignitions_and_withdrawals(spark, block):
    rows, table = _states(spark, 9)
    fired, long = [], []
    for symbol in "XY":
        start, last, stall, last_stall = None, None, None, None
        for _, t, i, state, length, speed, push, count, tired in sorted(r for r in rows if r[0] == symbol):
            start = (t if start is None else start) if state in cascades.STREAKS else None
            stall = (t if stall is None else stall) if state in cascades.STALLS else None
            if start is not None and push is not None and length >= 3 and speed >= 2 and push >= 1 and (last is None or t - last >= 5 * S):
                fired.append((symbol, i, start, t, min(1.0, 0.5 * speed / 2 + 0.5 * push)))
                last = t
            if stall is not None and t - stall >= 6 * S and count >= 3 and push is not None and push < 0.9 and tired >= 0.5 and (last_stall is None or t - last_stall >= 30 * S):
                long.append((symbol, i, stall, t, min(1.0, 0.5 * count / 3 + 0.5 * tired)))
                last_stall = t
    for got, exp in ((cascades.ignitions(table, block_us=block), fired), (cascades.withdrawals(table, least_us=6 * S, block_us=block), long)):
        got = sorted(map(tuple, got.collect()))
        assert [x[:4] for x in got] == [x[:4] for x in sorted(exp)] and len(exp) > 5
        assert [x[4] for x in got] == pytest.approx([x[4] for x in sorted(exp)])


def _contagion(events, gate, window, gap):
    events, out, last = sorted(events, key=lambda e: (e[1], e[2])), [], None
    for i, (symbol, t, seq) in enumerate(events):
        found, end = {symbol}, t
        for other, u, _ in events[i + 1 :]:
            if u - t > window:
                break
            if other != symbol and gate(symbol, other):
                found.add(other)
                end = u
        if len(found) > 1 and (last is None or t - last >= gap):
            out.append((symbol, seq, t, end, sorted(found), min(1.0, 0.5 + 0.15 * (len(found) - 2))))
            last = t
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_contagion(spark, seed):
    r = np.random.default_rng(seed)
    ts = np.cumsum(r.integers(0, 5, 500)) * (S // 4)
    events = [("ABCDE"[r.integers(5)], int(t), i) for i, t in enumerate(ts)]
    table = spark.createDataFrame(events, "symbol string, ts_us long, seq long")
    coherent = {("A", "B"): 0.6, ("C", "D"): 0.54, ("B", "E"): 0.9}
    adjacent = {("C", "D"): 0.45, ("E", "A"): 0.44, ("D", "A"): 0.8}
    frames = [spark.createDataFrame([(*k, v) for k, v in m.items()], "a string, b string, value double") for m in (coherent, adjacent)]
    value = lambda m, a, b: max(m.get((a, b), 0), m.get((b, a), 0))
    gates = [((None, None), lambda a, b: True), ((frames[0], None), lambda a, b: value(coherent, a, b) >= 0.55), (frames, lambda a, b: value(coherent, a, b) >= 0.55 or value(adjacent, a, b) >= 0.45)]
    for (coherence, adjacency), gate in gates:
        got = sorted(tuple(x) for x in cascades.contagion(table, coherence, adjacency).collect())
        exp = sorted(_contagion(events, gate, S, 15 * S))
        assert [x[:5] for x in got] == [x[:5] for x in exp] and len(exp) > 5
        assert [x[5] for x in got] == pytest.approx([x[5] for x in exp])
    assert cascades.contagion(table.where("false")).count() == 0
    assert cascades.contagion(table.where(F.col("symbol") == "A")).count() == 0
