"""The first layered order without pairs against the statement, and a snapshot whose pairs would be too many."""

import numpy as np
import pytest

from bookloom.catalog import OPERATORS
from bookloom.operators import layering

SCHEMA = "symbol string, seq long, ts_us long, action string, side string, price double, size long"


def _mbo(spark, seed, n, prices, sizes, span):
    r = np.random.default_rng(seed)
    rows = [("XY"[r.integers(2)], i, int(r.integers(-span, span)), "AAAC"[r.integers(4)], "BA"[r.integers(2)], float(r.integers(prices)) / 4 if r.random() > 0.02 else None, int(r.integers(1, sizes))) for i in range(n)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("same,levels,prices,sizes", [(0.2, 2, 40, 100), (0.03, 3, 12, 1000), (0.0, 2, 5, 40), (0.5, 4, 6, 30), (0.2, 1, 3, 10), (0.03, 2, 1, 20)])
def test_layers_equal_the_statement(spark, same, levels, prices, sizes):
    op = OPERATORS["sd02_layering"]
    mbo = _mbo(spark, levels, 900, prices, sizes, 4000)
    params = {"scan": 1000, "same": same, "spread": 300, "levels": levels}
    got, exp = (sorted(map(tuple, x.collect())) for x in (layering.layering(mbo, mbo, **params), op.apply(spark, {"mbo": mbo}, **params)))
    assert got == exp and (len(got) > 3 or prices == 1)


def test_one_large_snapshot(spark):
    """40,000 orders of one snapshot: 800 million pairs, none of which need be made."""
    mbo = spark.range(40_000).selectExpr("'X' AS symbol", "id AS seq", "id AS ts_us", "'A' AS action", "'B' AS side", "CAST(id % 7 AS DOUBLE) AS price", "50 + id % 3 AS size")
    got = layering.layering(mbo, mbo, scan=10**6, same=0.2, spread=10**6, levels=3)
    assert [tuple(r)[:7] for r in got.collect()] == [("X", "B", 0, 0.0, 40_000, 7, 39_999)]
    flat = mbo.withColumn("price", mbo["price"] * 0)  # one price: every order is looked at, and none has others around
    assert layering.layering(flat, flat, scan=10**6, same=0.2, spread=10**6, levels=3).count() == 0
