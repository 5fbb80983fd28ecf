"""Rolling tiers against numpy's quantiles, signatures against iterated sums, purged folds against index arithmetic."""

from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from bookloom.operators import rolling, validation

S, DAY = 1_000_000, rolling.DAY


def _series(seed, n, spread=90):
    r = np.random.default_rng(seed)
    ts = np.cumsum(r.integers(0, spread, n)) * S  # ties in time
    return [("AB"[int(r.random() < 0.2)], int(ts[i]), i, None if r.random() < 0.03 else float(r.integers(0, 60)) / 8) for i in range(n)]


SCHEMA = "symbol string, ts_us long, seq long, p double"


def test_places(spark):
    rows = _series(1, 500)
    got = {(r.symbol, r.seq): r.place for r in rolling.with_place(spark.createDataFrame(rows, SCHEMA), 600 * S).collect()}
    for symbol in "AB":
        assert [got[symbol, r[2]] for r in rows if r[0] == symbol] == list(range(sum(r[0] == symbol for r in rows)))


@pytest.mark.parametrize(("history", "warmup"), [(50, 20), (7, 1), (1000, 100)])
def test_rolling_tiers(spark, history, warmup):
    rows = _series(2, 900)
    tiers = (("top", 0.95), ("high", 0.8), ("upper", 0.5))
    exp = {}
    for symbol in "AB":
        seen = []
        for _, _, seq, p in [r for r in rows if r[0] == symbol and r[3] is not None]:
            seen = [*seen, p][-history:]
            exp[symbol, seq] = next((t for t, q in tiers if p >= np.quantile(seen, q)), None) if len(seen) >= warmup else None
    table = spark.createDataFrame(rows, SCHEMA)
    got = {(r.symbol, r.seq): r.tier for r in rolling.rolling_tiers(table, history, warmup, tiers, 3600 * S).collect()}
    assert got == exp and {"top", "high", "upper", None} <= set(got.values())
    assert rolling.rolling_tiers(table.where("false")).count() == 0


def _signature(path, depth):
    """Iterated sums over strictly rising indices, by definition."""
    dx = np.diff(path, axis=0)
    n, d = dx.shape
    out = [dx.sum(0)]
    if depth > 1:
        two = sum((np.multiply.outer(dx[a], dx[b]) for a, b in combinations(range(n), 2)), np.zeros((d, d)))
        out.append((two + two.T) / 2)
    if depth > 2:
        out.append(sum((np.multiply.outer(np.multiply.outer(dx[a], dx[b]), dx[c]) for a, b, c in combinations(range(n), 3)), np.zeros((d, d, d))))
    flat = np.concatenate([x.ravel() for x in out])
    norm = np.linalg.norm(flat)
    return flat / norm if norm > 0 else flat


@pytest.mark.parametrize(("depth", "augmentation", "block"), [(1, "time", 3600), (2, "time", 900), (3, "time", 1800), (3, "lead_lag", 900), (2, "none", 10**6)])
def test_signatures(spark, depth, augmentation, block):
    r = np.random.default_rng(depth)
    rows = []
    for symbol, session, n in (("A", 0, 40), ("A", 1, 30), ("B", 0, 3), ("B", 1, 2), ("B", 3, 1)):
        ts = session * DAY + np.sort(r.integers(0, 20_000, n)) * S
        rows += [(symbol, int(t), len(rows) + i, float(r.normal()), float(r.normal())) for i, t in enumerate(ts)]
    rows.append(("A", 5, 999, None, 1.0))
    two = augmentation != "lead_lag"
    got = rolling.signatures(spark.createDataFrame(rows, "symbol string, ts_us long, seq long, x double, y double"), ["x", "y"] if two else ["x"], depth, augmentation, slots=20 if depth < 3 else None, block_us=block * S).collect()
    by = defaultdict(list)
    for symbol, ts, seq, x, y in sorted(rows, key=lambda r: r[1:3]):
        if x is not None:
            by[symbol, ts // DAY * DAY].append([x, y] if two else [x])
    assert {(g.symbol, g.session): g.n for g in got} == {k: len(v) for k, v in by.items()}
    for g in got:
        path = np.array(by[g.symbol, g.session])
        if augmentation == "time":
            path = np.column_stack([np.linspace(0, 1, len(path)), path])
        elif augmentation == "lead_lag":
            path = np.column_stack([path[1:], path[:-1]])
        exp = _signature(path, depth) if g.n >= 3 else np.zeros(1)
        assert len(g.signature) == (20 if depth < 3 else sum(path.shape[1] ** k for k in (1, 2, 3)))
        assert np.allclose(g.signature[: len(exp)], exp, atol=1e-12) and not np.any(g.signature[len(exp) :])


def _folds(ts, events, k, m, embargo, day_aware, train_days, test_days):
    """fold -> role by position, from sorted times."""
    ts = np.array(ts)
    day = ts // DAY
    days = np.unique(day)
    if day_aware:
        if len(days) < k:
            return []
        bucket = {d: i for i, part in enumerate(np.array_split(days, k)) for d in part}
        group = np.array([bucket[d] for d in day])
        near = np.zeros(len(ts), bool)
        for e in events:
            at = np.searchsorted(days, e // DAY)
            if at < len(days):
                near |= np.abs(np.searchsorted(days, day) - at) <= embargo
    else:
        group = np.concatenate([np.full(len(p), i) for i, p in enumerate(np.array_split(np.arange(len(ts)), k))])
        near = np.array([any(abs(t - e) <= embargo * DAY for e in events) for t in ts], bool)
    out = []
    for c in combinations(range(k), m):
        test = np.isin(group, c)
        train = ~test & ~near
        if not test.any() or (day_aware and (len(set(day[train])) < train_days or len(set(day[test])) < test_days)):
            continue
        out.append(np.where(test, "test", np.where(near, "embargoed", "train")))
    return out


@pytest.mark.parametrize(("day_aware", "embargo", "train_days"), [(False, 1, 3), (False, 0, 3), (True, 1, 3), (True, 0, 12), (True, 2, 8)])
def test_purged_folds(spark, day_aware, embargo, train_days):
    r = np.random.default_rng(3)
    rows, events = [], []
    for symbol, n, span in (("A", 300, 25), ("B", 41, 9), ("C", 3, 2)):
        ts = np.sort(r.choice(np.setdiff1d(np.arange(span), [3, 4, 11]), n) * DAY + r.integers(0, 86_400, n) * S)
        rows += [(symbol, int(t), i) for i, t in enumerate(ts)]
        events += [(symbol, int(t)) for t in (3 * DAY + 5 * S, 8 * DAY, 90 * DAY, int(ts[0]))]
    table, when = spark.createDataFrame(rows, "symbol string, ts_us long, seq long"), spark.createDataFrame(events, "symbol string, ts_us long")
    for given in (when, None):
        got = defaultdict(dict)
        for x in validation.folds(table, given, embargo_days=embargo, day_aware=day_aware, least_train_days=train_days, block_us=2 * DAY).collect():
            got[x.symbol, x.fold][x.seq] = x.role
        exp = {}
        for symbol in "ABC":
            ts = [t for s, t, _ in rows if s == symbol]
            for i, roles in enumerate(_folds(ts, [t for s, t in events if s == symbol] if given is not None else [], 5, 2, embargo, day_aware, train_days, 1)):
                exp[symbol, i] = dict(enumerate(roles.tolist()))
        assert dict(got) == exp and len(exp) >= 4
    assert validation.folds(table.where(F.lit(False))).count() == 0
