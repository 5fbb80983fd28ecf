"""The book at grid times against a book that is walked order by order."""

from collections import defaultdict

import numpy as np
import pytest

from bookloom.operators import book


def _events(seed, n):
    """Few orders with many events: unknown ones, fills to zero and below, repeated adds, ties, sizes of 0 and null."""
    r = np.random.default_rng(seed)
    rows, t = [], 3
    for i in range(n):
        t += int(r.integers(0, 30))
        rows.append(("XY"[int(r.random() < 0.2)], i, int(r.integers(12)), t, "ACMFTR"[r.choice(6, p=[0.3, 0.12, 0.2, 0.25, 0.1, 0.03])], "BA"[r.integers(2)], float(r.integers(4)) / 4, None if r.random() < 0.02 else int(r.integers(0, 40))))
    return rows


def _apply(orders, action, oid, side, price, size):
    if action == "A" or (action == "M" and oid in orders):
        orders[oid] = [side, price, size]
    elif action == "C":
        orders.pop(oid, None)
    elif action in "FT" and oid in orders:
        orders[oid][2] -= size
        if orders[oid][2] <= 0:
            del orders[oid]


def _levels(orders):
    out = defaultdict(lambda: [0, 0])
    for side, price, size in orders.values():
        out[side, price][0] += size
        out[side, price][1] += 1
    return out


def _loop(rows, step):
    for symbol in "XY":
        own, orders, k = sorted((r for r in rows if r[0] == symbol), key=lambda r: (r[3], r[1])), {}, 0
        for cell in range(-(-own[0][3] // step), -(-own[-1][3] // step) + 1):
            while k < len(own) and own[k][3] <= cell * step:
                _, _, oid, _, action, side, price, size = own[k]
                _apply(orders, action, oid, side, price, size or 0)
                k += 1
            yield from ((symbol, cell * step, *level, *x) for level, x in _levels(orders).items())


SCHEMA = "symbol string, seq long, order_id long, ts_us long, action string, side string, price double, size long"


@pytest.mark.parametrize(("seed", "step", "block"), [(1, 40, 8), (2, 7, 1), (3, 1000, 1024), (4, 3, 64)])
def test_book(spark, seed, step, block):
    rows = _events(seed, 900)
    mbo = spark.createDataFrame(rows, SCHEMA)
    got = sorted(map(tuple, book.book(mbo, step, block).collect()))
    assert got == sorted(_loop(rows, step)) and len(got) > 50


def test_lifetimes(spark):
    """Each state of each order, from event to event."""
    rows = _events(5, 700)
    exp = []
    for symbol, oid in {(r[0], r[2]) for r in rows}:
        own, orders = sorted((r for r in rows if (r[0], r[2]) == (symbol, oid) and r[4] != "R"), key=lambda r: (r[3], r[1])), {}
        for i, (_, seq, _, t, action, side, price, size) in enumerate(own):
            _apply(orders, action, oid, side, price, size or 0)
            if oid in orders:
                exp.append((symbol, oid, *orders[oid], t, seq, own[i + 1][3] if i + 1 < len(own) else -1, own[i + 1][1] if i + 1 < len(own) else -1))
    got = book.lifetimes(spark.createDataFrame(rows, SCHEMA)).fillna(-1).collect()
    assert sorted(map(tuple, got)) == sorted(exp)


def test_best_quotes_and_empty(spark):
    mbo = spark.createDataFrame([("X", i, i, 10, "A", s, p, 5 + i) for i, (s, p) in enumerate([("B", 1.0), ("B", 1.25), ("A", 1.5), ("B", 1.25)])] + [("Y", 9, 9, 10, "A", "B", 2.0, 1)], SCHEMA)
    assert sorted(map(tuple, book.best_quotes(book.book(mbo, 10)).collect())) == [("X", 10, 1.25, 1.5, 14, 7), ("Y", 10, 2.0, None, 1, None)]
    assert book.book(mbo.where("false"), 10).count() == 0
