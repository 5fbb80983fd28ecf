"""The fragility index against a walk over quotes, times against Python's parser, seeks against a scan of the candles."""

from datetime import UTC, datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from bookloom.operators import fragility, times

S = 1_000_000


def test_fragility(spark):
    r = np.random.default_rng(4)
    ts = np.cumsum(r.integers(0, 3, 400)) * (S // 2)
    quotes = [("AB"[int(i % 5 == 0)], int(ts[i]), i, 100.0, 100.0 + 0.25 * int(r.integers(1, 8)), int(r.integers(0, 900)), int(r.integers(0, 900))) for i in range(400)]
    adds = [("AB"[int(r.random() < 0.2)], int(t), "BA"[r.integers(2)]) for t in np.sort(r.integers(0, ts[-1], 3000))]
    vpin = [("A", int(t), float(x)) for t, x in zip(ts[50::40], r.random(20) * 1.3)]
    stress = [("A", int(ts[100]), 0.4), ("A", int(ts[200]), float("nan")), ("A", int(ts[300]), 2.0)]
    tables = [spark.createDataFrame(x, s) for x, s in ((quotes, "symbol string, ts_us long, seq long, bid double, ask double, bid_size long, ask_size long"), (adds, "symbol string, ts_us long, side string"), (vpin, "symbol string, at_us long, vpin double"), (stress, "symbol string, at_us long, stress double"))]
    clip = lambda x: 0.0 if not np.isfinite(x) else max(0.0, min(1.0, x))
    known = lambda facts, symbol, t: next((x for s, u, x in reversed(facts) if s == symbol and u <= t), 0.0)
    for given in (tables[3], None):
        got = {(x.symbol, x.seq): x for x in fragility.fragility(*tables[:3], given).collect()}
        assert len(got) == len(quotes)
        seen = set()
        for symbol, t, seq, bid, ask, b, a in quotes:
            was = {w: next((q[5] + q[6] for q in reversed(quotes) if q[0] == symbol and q[1] <= t - w * S), None) for w in (5, 30)}
            rate = {w: 0.0 if was[w] is None else (a + b - was[w]) / w for w in (5, 30)}
            n = sum(s == symbol and t - S <= u <= t for s, u, _ in adds)
            parts = [clip(-rate[5] / 200), clip(abs(rate[30]) / 100), clip(n / 50), clip(((ask - bid) / 0.25 - 1) / 4), clip(known(vpin, symbol, t)), clip(known(stress, symbol, t)) if given is not None else 0.0]
            fast, full = 0.35 * parts[2] + 0.35 * parts[3] + 0.30 * parts[4], np.dot(parts, [0.2, 0.15, 0.2, 0.15, 0.15, 0.15])
            x = got[symbol, seq]
            assert list(x)[2:10] == pytest.approx([*parts, fast, full], abs=1e-8)
            assert (x.signal_threshold, x.size_multiplier) == (0.40 if fast > 0.6 else 0.55, 0.5 if full > 0.7 else 1.0)
            seen.add(x.signal_threshold)
        assert seen == {0.40, 0.55}


def test_times(spark):
    texts = ["2024-01-05", "2024-01-05T10:20:30", "2024-01-05T10:20:30.123456", "2024-01-05T10:20:30+02:00", "2024-01-05 10:20:30-05:30", "2024-01-05T10:20:30Z", " 2024-02-29 ", "nonsense", "10:20", "", None, "2024-13-01"]
    table = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")
    for late in (False, True):
        got = [r.ns for r in table.select("i", times.time_ns(F.col("t"), late).alias("ns")).orderBy("i").collect()]
        for t, ns in zip(texts, got):
            try:
                s = t.strip()
                d = datetime.fromisoformat(s + ("T23:59:59" if late else "T00:00:00") if len(s) == 10 else s)
                d = d if d.tzinfo else d.replace(tzinfo=UTC)
                exp = round(d.timestamp() * 10**6) * 1000 if t not in ("10:20",) else None
            except (ValueError, AttributeError):
                exp = None
            assert ns == exp, t
    rows = spark.createDataFrame([(int(datetime(2024, 1, d, h, tzinfo=UTC).timestamp()) * S, d) for d in range(3, 9) for h in (0, 23)], "ts_us long, d long")
    assert sorted(r.d for r in times.between(rows, "2024-01-05", "2024-01-06").collect()) == [5, 5, 6, 6]
    assert sorted(r.d for r in times.between(rows, None, "2024-01-03T12:00:00+01:00").collect()) == [3]
    with pytest.raises(ValueError):
        times.between(rows, "tomorrow", None)


def test_seek_step_switch(spark):
    r = np.random.default_rng(6)
    rows = [("XY"[int(r.random() < 0.3)], int(t), i, float(r.integers(50)), int(r.integers(1, 9))) for i, t in enumerate(np.sort(r.integers(10**9, 2 * 10**9, 300)) * 1000)]
    table = spark.createDataFrame(rows, "symbol string, ts_us long, seq long, price double, size long")
    asked = [(s, int(t), i) for i, (s, t) in enumerate((s, t) for s in "XYZ" for t in (0, rows[0][1], rows[100][1] + 7, rows[-1][1], 10**13))]
    ask = spark.createDataFrame(asked, "symbol string, ts_us long, seq long")
    begins = {}
    for frame in (1000 * S, 7777 * S):
        made = times.candles(table, frame)
        for s in "XY":
            begins[s, frame] = sorted({t - t % frame for x, t, *_ in rows if x == s})
        got = {(x.symbol, x.seq): (x["index"], x.bucket_us) for x in times.seek(made, ask, frame).collect()}
        exp = {}
        for s, t, i in asked:
            if s != "Z":
                at = max([k for k, b in enumerate(begins[s, frame]) if b <= t], default=0)
                exp[s, i] = (at, begins[s, frame][at])
        assert got == exp
        first = {x.symbol: (x.open, x.volume) for x in made.where("index = 0").collect()}
        for s in "XY":
            own = [x for x in rows if x[0] == s and x[1] - x[1] % frame == begins[s, frame][0]]
            assert first[s] == (own[0][3], sum(x[4] for x in own))
    fine, coarse = times.candles(table, 1000 * S), times.candles(table, 7777 * S)
    places = times.seek(fine, ask, 1000 * S).select("symbol", "seq", "index")
    ahead = {(x.symbol, x.seq): x["index"] for x in times.step(fine, places, 5).collect()}
    over = {(x.symbol, x.seq): x["index"] for x in times.switch(fine, coarse, places, 7777 * S).collect()}
    for p in places.collect():
        own = begins[p.symbol, 1000 * S]
        assert ahead[p.symbol, p.seq] == min(len(own) - 1, p["index"] + 5)
        assert over[p.symbol, p.seq] == max([k for k, b in enumerate(begins[p.symbol, 7777 * S]) if b <= own[p["index"]]], default=0)
