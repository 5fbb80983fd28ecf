"""Replay from Parquet, CSV and a stream against a grouping by hand."""

from collections import defaultdict

import numpy as np
import pytest

from bookloom.sources import replay
from bookloom.streaming import sinks


def _rows(seed):
    r = np.random.default_rng(seed)
    sides = ["BID", "b", "Buy", "ASK", "a", "SELL", "?"]
    return [(float(10_000 + 250 * r.integers(0, 40)) + 0.25, sides[r.integers(7)], float(r.integers(90, 110)), float(r.integers(1, 5)), int(r.integers(1, 4)), "XY"[int(r.random() < 0.3)]) for _ in range(400)]


def _grouped(rows):
    out = defaultdict(lambda: ([], []))
    for t, side, price, volume, count, symbol in rows:
        out[symbol, int(t)][0 if side.upper() in ("BID", "B", "BUY") else 1].append((price, volume, count))
    return {k: (sorted(b, key=lambda x: (-x[0], *x[1:])), sorted(a)) for k, (b, a) in out.items()}


def _seen(df):
    return {(r.symbol, r.timestamp): ([tuple(x) for x in r.bids], [tuple(x) for x in r.asks]) for r in df.collect()}


SCHEMA = "timestamp double, side string, price double, volume double, order_count int, symbol string"


def test_files_positions_and_seeks(spark, tmp_path):
    rows = _rows(1)
    table = spark.createDataFrame(rows, SCHEMA)
    table.write.parquet(str(tmp_path / "x.parquet"))
    table.write.option("header", True).csv(str(tmp_path / "x.csv"))
    exp = _grouped(rows)
    made = [replay.snapshots(replay.read_levels(spark, str(tmp_path / n))) for n in ("x.parquet", "x.csv")]
    assert _seen(made[0]) == _seen(made[1]) == exp
    placed = replay.positions(made[0], block=1000)
    order = {s: sorted(t for x, t in exp if x == s) for s in "XY"}
    assert all(order[r.symbol][r.position] == r.timestamp for r in placed.collect()) and placed.count() == len(exp)
    for start, count in ((0, 3), (-5, 2), (7, None), (10**6, 4)):
        got = {(r.symbol, r.position) for r in replay.play(placed, start, count).collect()}
        at = {s: max(0, min(start, len(o) - 1)) for s, o in order.items()}
        assert got == {(s, p) for s, o in order.items() for p in range(len(o)) if p >= at[s] and (count is None or p < at[s] + count)}
    t = order["X"][5] + 1
    assert {(r.symbol, r.timestamp) for r in replay.seek(placed, t).collect()} == {(s, max(x for x in o if x <= t)) for s, o in order.items()}
    assert replay.snapshots(replay.read_levels(spark, str(tmp_path / "x.parquet")).where("false")).count() == 0


def test_missing_and_default_columns(spark):
    with pytest.raises(ValueError, match="volume"):
        replay._levels(spark.createDataFrame([(1, "B", 2.0)], "timestamp long, side string, price double"))
    got = replay.snapshots(replay._levels(spark.createDataFrame([(1, "B", 2.0, 3.0), (None, "B", 1.0, 1.0)], "timestamp long, side string, price double, volume double"))).collect()
    assert [(r.symbol, r.timestamp, [tuple(x) for x in r.bids], r.asks) for r in got] == [("REPLAY", 1, [(2.0, 3.0, 1)], [])]


def test_a_stream_equals_the_files(spark, tmp_path):
    rows = _rows(2)
    source, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    end = [(10.0**9, "B", 1.0, 1.0, 1, "Z"), (2 * 10.0**9, "B", 1.0, 1.0, 1, "Z")]
    schema = "symbol string, timestamp long, bids array<struct<price: double, volume: double, order_count: long>>, asks array<struct<price: double, volume: double, order_count: long>>"
    for part in (rows[200:], rows[:200], end[:1], end[1:]):  # late files within the watermark, a restart for each
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        sinks.start(replay.snapshots(replay.stream_levels(spark, source, SCHEMA), "1 hour"), out, checkpoint, "parquet").awaitTermination()
    got = {k: v for k, v in _seen(sinks.read(spark, out, schema, "parquet")).items() if k[0] != "Z"}
    assert got == _grouped(rows)
