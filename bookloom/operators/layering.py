"""The first layered order of each snapshot without its pairs: what is sure by cells of time and size, and an exact look at the few rows before that.

Two orders of one cell are always near each other, so an order with enough prices from its own upwards in its cell is layered; the first
of these bounds the answer.  What lies before it at the top prices of its cell is compared with the orders of the cells
around that hold a higher price.  Only the first layered order is then met with its whole snapshot.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession

from bookloom.operators import books
from bookloom.operators.sql import Operator

_CELL = "symbol, side, snap, tc, sc"
_FIRST = """WITH lay AS (SELECT symbol, side, ts_us - ts_us % {scan} AS snap, ts_us, seq, price, size, CAST(ts_us - pmod(ts_us, {spread} + 1) AS BIGINT) DIV ({spread} + 1) AS tc, SC(size) AS sc FROM {mbo} WHERE action = 'A' AND size >= 3 AND price IS NOT NULL),
 ranked AS (SELECT *, dense_rank() OVER (PARTITION BY CELL ORDER BY price DESC) AS top FROM lay),
 sure AS (SELECT symbol, side, snap, min(struct(price, seq, size, ts_us)) AS base FROM ranked WHERE top >= {levels} GROUP BY 1, 2, 3),
 unsure AS (SELECT r.symbol, r.side, r.snap, r.tc, r.price, r.size, r.ts_us, min(r.seq) AS seq FROM ranked r LEFT JOIN sure s ON r.symbol = s.symbol AND r.side = s.side AND r.snap = s.snap
   WHERE r.top < {levels} AND (s.base IS NULL OR r.price < s.base.price OR (r.price = s.base.price AND r.seq < s.base.seq)) GROUP BY 1, 2, 3, 4, 5, 6, 7),
 asked AS (SELECT symbol, side, snap, t AS tc, x AS sc, price, size, ts_us, seq FROM (SELECT *, explode(sequence(tc - 1, tc + 1)) AS t FROM unsure) LATERAL VIEW explode(sequence(SC(greatest(3, size * (1 - {same}))) - 1, SC(size * (1 + {same})) + 1)) AS x),
 tops AS (SELECT CELL, max(price) AS most FROM lay GROUP BY CELL),
 around AS (SELECT a.* FROM asked a JOIN tops t ON a.symbol = t.symbol AND a.side = t.side AND a.snap = t.snap AND a.tc = t.tc AND a.sc = t.sc AND t.most > a.price),
 others AS (SELECT DISTINCT CELL, price, size, ts_us FROM lay),
 found AS (SELECT a.symbol, a.side, a.snap, struct(a.price, a.seq, a.size, a.ts_us) AS base FROM around a JOIN others o ON a.symbol = o.symbol AND a.side = o.side AND a.snap = o.snap AND a.tc = o.tc AND a.sc = o.sc
   AND o.price > a.price AND abs(o.size - a.size) <= {same} * a.size AND abs(o.ts_us - a.ts_us) <= {spread} GROUP BY 1, 2, 3, 4 HAVING count(DISTINCT o.price) + 1 >= {levels}),
 best AS (SELECT symbol, side, snap, min(base) AS base FROM (SELECT * FROM sure UNION ALL SELECT * FROM found) GROUP BY 1, 2, 3),
 heap AS (SELECT b.symbol, b.side, b.snap, b.base.price AS price, count(*) AS n, count(DISTINCT c.price) AS levels, max(c.ts_us) AS last_us, max(c.ts_us) - min(c.ts_us) AS took FROM best b JOIN lay c ON b.symbol = c.symbol AND b.side = c.side AND b.snap = c.snap
   AND (c.price > b.base.price OR (c.price = b.base.price AND c.seq >= b.base.seq)) AND abs(c.size - b.base.size) <= {same} * b.base.size AND abs(c.ts_us - b.base.ts_us) <= {spread} GROUP BY 1, 2, 3, 4)
 SELECT symbol, side, snap, price, n, levels, last_us, 0.6 * least(1.0, n / ({levels} * 2.0)) + 0.4 * greatest(0.0, 1 - took / {spread}) AS confidence FROM heap"""


def first_layers(spark: SparkSession, mbo: DataFrame, scan: int, same: float, spread: int, levels: int) -> DataFrame:
    """The rows of `sd2` of the statement sd02_layering."""
    # Cells a trifle narrower than the ratio 1 + same: rounding of logarithms never puts two sizes into one cell that are further apart.
    width = max(math.log1p(same), 1e-6) * (1 - 1e-9)
    text = _FIRST.replace("CELL", _CELL)
    for size in ("size", "greatest(3, size * (1 - {same}))", "size * (1 + {same})"):
        text = text.replace(f"SC({size})", f"CAST(floor(ln({size}) / {width:.16e}) AS BIGINT)" if same > 0 else f"CAST({size} AS BIGINT)")
    params = {"scan": scan, "same": float(same), "spread": spread, "levels": levels}
    return Operator("first_layers", text, params).apply(spark, {"mbo": mbo})


def _layers(spark: SparkSession, mbo: DataFrame, op: Operator, **params: float) -> DataFrame:
    values = {**op.defaults, **params}
    return first_layers(spark, mbo, **{k: values[k] for k in books._D2})


def layering(mbo: DataFrame, quotes: DataFrame, **params: float) -> DataFrame:
    op = _STATEMENTS["sd02_layering"]
    return _rest(mbo, quotes, op, **params)


def authenticity(mbo: DataFrame, quotes: DataFrame, **params: float) -> DataFrame:
    op = _STATEMENTS["sd05_authenticity"]
    return _rest(mbo, quotes, op, **params)


def _rest(mbo: DataFrame, quotes: DataFrame, op: Operator, **params: float) -> DataFrame:
    """The statement over the layers that are found without pairs."""
    spark = mbo.sparkSession
    rest = Operator(op.name, op.sql.replace(books._SD02, "sd2 AS (SELECT * FROM {layers})"), op.defaults)
    tables = {"mbo": mbo, "quotes": quotes, "layers": _layers(spark, mbo, op, **params)}
    return rest.apply(spark, tables, **params)


_STATEMENTS = {o.name: o for o in books.OPERATORS}
OPERATORS = {"sd02_layering": layering, "sd05_authenticity": authenticity}
