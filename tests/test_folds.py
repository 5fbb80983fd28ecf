"""Ordered folds: streams fed in several orders, with restarts, against tables and plain loops; sinks that may repeat a batch."""

from collections import defaultdict

import numpy as np
import pytest

from bookloom.operators import frames, stateful
from bookloom.streaming import folds, sinks

S = 1_000_000
SCHEMA = "symbol string, ts_us long, seq long, mid double, match_id long, direction string"


def _rows(seed, n):
    r = np.random.default_rng(seed)
    ts = (10**6 + np.cumsum(r.integers(0, 40, n))) * S  # ties in time; streams begin with their watermark at time 0
    out = []
    for i in range(n):
        match = None if r.random() < 0.6 else i
        out.append(("XY"[int(r.random() < 0.3)], int(ts[i]), i, None if r.random() < 0.05 else 100 + float(np.round(r.normal(), 2)), match, ["bull", "bear", "neutral", None][r.integers(4)]))
    return out


def _outcomes(rows, horizon, tolerance):
    """The walk: prices close what is due, then matches open at the last price."""
    pending, last = defaultdict(list), {}
    for symbol, ts, _, mid, match, direction in sorted(rows, key=lambda r: (r[1], r[2])):
        if mid is not None:
            for p in [p for p in pending[symbol] if ts >= p[1] + horizon]:
                pending[symbol].remove(p)
                realized = (mid - p[2]) * {"bull": 1, "bear": -1}.get(p[3], 0)
                yield symbol, 0, p[0], p[1], ts, p[2], mid, realized, realized > tolerance
            last[symbol] = mid
        if match is not None and symbol in last:
            pending[symbol].append((match, ts, last[symbol], direction))


def test_outcomes_on_a_table(spark):
    rows = _rows(1, 800)
    got = sorted(map(tuple, folds.on_table(spark.createDataFrame([*rows, *rows[:50]], SCHEMA), folds.outcomes(60 * S)).collect()))
    assert got == sorted(_outcomes(rows, 60 * S, 0.125)) and len(got) > 200


def test_cusum_and_throttle_on_a_table(spark):
    rows = [r for r in _rows(2, 900) if r[3] is not None]
    table = spark.createDataFrame(rows, SCHEMA)
    got = sorted(map(tuple, folds.on_table(table, folds.cusum(2.0), stateful.DAY).collect()))
    assert got == sorted((r.symbol, r.session, r.seq, r.direction) for r in stateful.cusum(table, 2.0).collect()) and len(got) > 50
    exp = []
    for symbol in "XY":
        n, last = 0, None
        for _, ts, seq, *_ in [r for r in rows if r[0] == symbol]:
            n += 1
            if n >= 5 and (last is None or ts - last >= 300 * S):
                exp.append((symbol, 0, seq, ts))
                last = ts
    assert sorted(map(tuple, folds.on_table(table, folds.throttle(300 * S)).collect())) == sorted(exp)
    assert folds.on_table(table.where("false"), folds.throttle(S)).count() == 0


def test_outcomes_are_those_of_the_tracker(spark):
    """With a match at every quote, the same as the frames' tracker of outcomes."""
    rows = [(a, t, i, m, i, "bull") for a, t, i, m, _, _ in _rows(3, 400) if m is not None]
    table = spark.createDataFrame(rows, SCHEMA)
    got = {(r.symbol, r.match_id): (r.entry, r.leave, r.hit) for r in folds.on_table(table, folds.outcomes(90 * S)).collect()}
    exp = {(r.symbol, r.seq): (r.entry, r["leave"], r.hit) for r in frames.outcome_tracker(None, table, 90 * S).collect()}
    assert got == exp and len(got) > 300


@pytest.fixture()
def store(spark):
    for k, v in folds.STORE.items():
        spark.conf.set(k, v)
    yield
    for k in folds.STORE:
        spark.conf.unset(k)


@pytest.mark.parametrize("order", ["sorted", "reversed", "shuffled"])
def test_streams_equal_the_table(spark, store, tmp_path, order):
    """Files in three orders within the watermark, a stop after half of them, and a batch that is written again."""
    rows = _rows(4, 240)
    end = [("Z", rows[-1][1] + 10**7 * S, 9_999, 1.0, None, None), ("Z", rows[-1][1] + 2 * 10**7 * S, 10_000, 1.0, None, None)]
    chunks = [rows[i : i + 60] for i in range(0, len(rows), 60)]
    r = np.random.default_rng(5)
    if order == "reversed":
        chunks = chunks[::-1]
    elif order == "shuffled":
        mixed = list(r.permutation(len(rows)))
        chunks = [[rows[i] for i in mixed[k::4]] for k in range(4)]
    chunks[1] = chunks[1] + chunks[0][:10]  # repeated rows
    parts = [chunks[:2], [*chunks[2:], end[:1], end[1:]]]
    fold = folds.outcomes(60 * S)
    source, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    for k, part in enumerate(parts):
        for j, chunk in enumerate(part):
            spark.createDataFrame(chunk, SCHEMA).coalesce(1).write.mode("append").parquet(source)
            stream = spark.readStream.schema(SCHEMA).parquet(source)
            query = sinks.start(folds.on_stream(stream, fold, "2 hours"), out, checkpoint)  # a restart for each file
            query.awaitTermination()
    got = sinks.read(spark, out, f"symbol string, session long, {fold.out}")
    exp = sorted(_outcomes(rows, 60 * S, 0.125))
    assert sorted(map(tuple, got.collect())) == exp and len(exp) > 50


def test_a_batch_written_again(spark, tmp_path):
    path = str(tmp_path / "outcomes")
    first, second = (spark.range(a, b).withColumnRenamed("id", "match_id") for a, b in ((0, 10), (10, 15)))
    for df, batch in ((first, 0), (second, 1), (first, 0), (second.where("false"), 2)):
        sinks.commit(df, batch, path)
    assert sorted(r.match_id for r in sinks.read(spark, path, "match_id long").collect()) == list(range(15))


def test_calibration(spark, tmp_path):
    path = str(tmp_path / "calibration")
    for version, rows in enumerate([[("A", 1, 5.0), ("B", 1, 6.0)], [("A", 2, 7.0)], [("A", 2, 8.0), ("B", 0, 1.0)]]):
        sinks.append_calibration(spark.createDataFrame(rows, "symbol string, day_us long, depth double"), path, version)
    sinks.append_calibration(spark.createDataFrame([("A", 2, 7.5)], "symbol string, day_us long, depth double"), path, 1)
    assert sorted(map(tuple, sinks.latest_calibration(spark, path).collect())) == [("A", 2, 8.0), ("B", 1, 6.0)]
