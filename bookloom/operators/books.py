"""Book snapshots and what is read from them: level profiles, order-flow imbalance, spoofing, pressure, signals, sweeps.

A snapshot holds the volume added per (symbol, time step, side, price); level profiles and order-flow imbalance read the
book itself (``book``): what rests at each time.  Every statement groups or windows by symbol
and snapshot; self joins meet by equal snapshots, so a pair list is as long as a snapshot is, not as the table.
"""

from bookloom.operators.sql import Operator

MS, MIN, DAY = 1000, 60_000_000, 86_400_000_000

_LV = "lv AS (SELECT symbol, ts_us - ts_us % {step} AS snap, side, price, CAST(sum(size) AS BIGINT) AS v, count(*) AS n, max(size) AS most FROM {mbo} WHERE action = 'A' AND size > 0 GROUP BY 1, 2, 3, 4)"
_TOT = """tot AS (SELECT symbol, snap, CAST(coalesce(sum(v) FILTER (WHERE side = 'B'), 0) AS BIGINT) AS tb, CAST(coalesce(sum(v) FILTER (WHERE side = 'A'), 0) AS BIGINT) AS ta,
 max(price) FILTER (WHERE side = 'B') AS bb, min(price) FILTER (WHERE side = 'A') AS ba FROM lv GROUP BY 1, 2)"""
_BOOK = f"WITH {_LV}, {_TOT}"
#: Levels of the real book, in the place of added volume.
_RESTING = "lv AS (SELECT symbol, snap, side, price, volume AS v, n_orders AS n FROM {book})"
_REAL = f"WITH {_RESTING}, {_TOT}"
_S, _SS = {"step": 100 * MS}, {"step": 2 * DAY}
_FIRST = "CASE WHEN side = 'B' THEN -price ELSE price END"  # best first

# The latest add of an order before each of its cancels (a second add with the same number replaces the first).
_MATCH = """m AS (SELECT symbol, order_id, seq, ts_us, action, max_by(side, CASE WHEN action = 'A' THEN ORD END) OVER w AS add_side, max_by(price, CASE WHEN action = 'A' THEN ORD END) OVER w AS add_price,
 max_by(size, CASE WHEN action = 'A' THEN ORD END) OVER w AS add_size, max_by(ts_us, CASE WHEN action = 'A' THEN ORD END) OVER w AS add_us
 FROM {mbo} WINDOW w AS (PARTITION BY symbol, order_id ORDER BY ts_us, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
 pulled AS (SELECT m.symbol, m.seq, m.ts_us, add_side AS side, add_price AS price, add_size AS size, m.ts_us - add_us AS dt, q.bid, q.ask, q.mid FROM m JOIN {quotes} q ON m.seq = q.seq AND m.symbol = q.symbol WHERE action = 'C' AND add_us IS NOT NULL)"""
_SD01 = """sd1 AS (SELECT symbol, side, price, count(*) AS n, max(ts_us) AS last_us, 0.5 * greatest(0.0, 1 - avg(dt) / {fast}) + 0.5 * least(1.0, count(*) / ({repeats} * 3.0)) AS confidence
 FROM pulled WHERE size >= 3 AND dt BETWEEN 0 AND {fast} AND abs(price - CASE WHEN side = 'B' THEN bid ELSE ask END) <= {near} GROUP BY 1, 2, 3 HAVING count(*) >= {repeats})"""
_SD03 = """sd3 AS (SELECT f.symbol, f.side, f.price, f.n, f.last_us, 0.5 * least(1.0, f.n / ({fills} * 3.0)) + 0.5 * least(1.0, f.total / a.mean_size / 20.0) AS confidence FROM
 (SELECT symbol, side, round(price / {bucket}) * {bucket} AS price, count(*) AS n, max(ts_us) AS last_us, sum(size) AS total FROM {mbo} WHERE action IN ('F', 'T') GROUP BY 1, 2, 3) f JOIN
 (SELECT symbol, side, round(price / {bucket}) * {bucket} AS price, avg(size) AS mean_size FROM {mbo} WHERE action = 'A' GROUP BY 1, 2, 3) a ON f.symbol = a.symbol AND f.side = a.side AND f.price = a.price
 WHERE f.n >= {fills} AND a.mean_size <= {clip} AND f.total >= 30)"""
_SD04 = """sd4 AS (SELECT symbol, seq, side, price, 0.4 * least(1.0, size / ({large} * 4.0)) + 0.3 * greatest(0.0, 1 - dt / {slow}) + 0.3 * greatest(0.0, 1 - abs(price - mid) / {away}) AS confidence
 FROM pulled WHERE size >= {large} AND dt BETWEEN {from} AND {slow} AND abs(price - mid) <= {away})"""
# A base and the later adds (by price) of its snapshot with nearly its size and time.
_SD02 = """lay AS (SELECT symbol, side, ts_us - ts_us % {scan} AS snap, ts_us, seq, price, size FROM {mbo} WHERE action = 'A' AND size >= 3),
 near AS (SELECT b.symbol, b.side, b.snap, b.seq, b.price AS base, c.price, c.ts_us FROM lay b JOIN lay c ON b.symbol = c.symbol AND b.side = c.side AND b.snap = c.snap
   AND (c.price > b.price OR (c.price = b.price AND c.seq >= b.seq)) AND abs(c.size - b.size) <= {same} * b.size AND abs(c.ts_us - b.ts_us) <= {spread}),
 heap AS (SELECT symbol, side, snap, seq, base, count(*) AS n, count(DISTINCT price) AS levels, max(ts_us) AS last_us, max(ts_us) - min(ts_us) AS took FROM near GROUP BY 1, 2, 3, 4, 5),
 lead1 AS (SELECT *, row_number() OVER (PARTITION BY symbol, side, snap ORDER BY base, seq) AS place FROM heap WHERE n >= {levels} AND levels >= {levels}),
 sd2 AS (SELECT symbol, side, snap, base AS price, n, levels, last_us, 0.6 * least(1.0, n / ({levels} * 2.0)) + 0.4 * greatest(0.0, 1 - took / {spread}) AS confidence FROM lead1 WHERE place = 1)"""
_D1, _D1S = {"fast": 150 * MS, "repeats": 2, "near": 0.000000001}, {"fast": 6 * DAY, "repeats": 1, "near": 60.0}
_D2, _D2S = {"scan": 300 * MS, "same": 0.03, "spread": 300 * MS, "levels": 3}, {"scan": 10 * DAY, "same": 0.2, "spread": 5 * DAY, "levels": 2}
_D3, _D3S = {"bucket": 0.25, "fills": 4, "clip": 8}, {"bucket": 5.0, "fills": 2, "clip": 60}
_D4, _D4S = {"large": 50, "from": 100 * MS, "slow": 500 * MS, "away": 2.0}, {"from": 100 * MIN, "slow": 9 * DAY, "away": 60.0}

# Pressure of a snapshot's events, weighted by size and halved with each {half} of age before the last event.
_PRESS = """ev AS (SELECT m.symbol, m.ts_us - m.ts_us % {step} AS snap, m.ts_us, m.seq, m.action, m.side, m.size, m.action IN ('A', 'M') AND CASE WHEN m.side = 'B' THEN m.price >= q.ask - {tol} ELSE m.price <= q.bid + {tol} END AS takes FROM {mbo} m JOIN {quotes} q ON m.seq = q.seq AND m.symbol = q.symbol),
 wt AS (SELECT *, greatest(1, size) * exp(-ln(2) * (max(ts_us) OVER (PARTITION BY symbol, snap) - ts_us) / {half}) * CASE WHEN action IN ('F', 'T') THEN 1.4 WHEN action = 'C' THEN 0.6 WHEN takes THEN 0.8 ELSE 0.0 END AS w,
   CASE WHEN action IN ('F', 'T', 'C') THEN side = 'A' ELSE side = 'B' END AS buys FROM ev),
 pr AS (SELECT symbol, snap, CASE WHEN sum(w) > 0 THEN sum(CASE WHEN buys THEN w ELSE -w END) / sum(w) ELSE 0.0 END AS pressure, CAST(sum(CASE WHEN action IN ('F', 'T') THEN CASE WHEN side = 'A' THEN size ELSE -size END ELSE 0 END) AS BIGINT) AS delta,
   count(*) FILTER (WHERE takes AND side = 'B') - count(*) FILTER (WHERE action IN ('F', 'T') AND side = 'B') AS fail_b, count(*) FILTER (WHERE takes AND side = 'A') - count(*) FILTER (WHERE action IN ('F', 'T') AND side = 'A') AS fail_a FROM wt GROUP BY symbol, snap)"""
_R, _RS = {"step": 100 * MS, "half": 500 * MS, "tol": 0.0}, {"step": DAY, "half": 500 * MIN, "tol": 0.25}

OPERATORS = [
    Operator("l2_book", _REAL + """ SELECT t.symbol, t.snap, (tb - ta) / (tb + ta + 0.000000001) AS imbalance, CASE WHEN ta > 0 THEN tb / (ta + 0.000000001) WHEN tb > 0 THEN 1000000.0 ELSE 1.0 END AS depth_ratio, round(sum(price * v) / (tb + ta), 9) AS weighted_mid,
 round((ba - bb) / ((ba + bb) / 2) * 10000.0, 6) AS spread_bps, CAST(coalesce(sum(v) FILTER (WHERE abs(price - (ba + bb) / 2) <= 0.005 * (ba + bb) / 2), 0) AS BIGINT) AS near_depth FROM tot t JOIN lv l ON t.symbol = l.symbol AND t.snap = l.snap GROUP BY t.symbol, t.snap, tb, ta, bb, ba""", _S, _SS),
    Operator("l2_level_persistence", f"""WITH {_RESTING}, d AS (SELECT *, dense_rank() OVER (PARTITION BY symbol ORDER BY snap) AS k FROM lv)
 SELECT a.symbol, a.snap, CASE WHEN a.k = 1 THEN 1.0 ELSE count(b.price) / count(*) END AS persistence FROM d a LEFT JOIN d b ON a.symbol = b.symbol AND a.side = b.side AND a.price = b.price AND a.v = b.v AND b.k = a.k - 1 GROUP BY a.symbol, a.snap, a.k""", _S, _SS),
    Operator("l2_shape_norm", f"WITH {_RESTING}, r AS (SELECT *, row_number() OVER (PARTITION BY symbol, snap, side ORDER BY {_FIRST}) AS place FROM lv) SELECT symbol, snap, round(sqrt(sum(v * v)), 6) AS norm FROM r WHERE place <= 20 GROUP BY symbol, snap", _S, _SS),
    Operator("l2_imbalance_velocity", _REAL + """, i AS (SELECT symbol, snap, (tb - ta) / (tb + ta) AS x FROM tot), p AS (SELECT *, last_value(x) OVER (PARTITION BY symbol ORDER BY snap RANGE BETWEEN UNBOUNDED PRECEDING AND {w} PRECEDING) AS was FROM i)
 SELECT symbol, snap, round(coalesce((x - was) / {s}, 0.0), 9) AS velocity FROM p""", {**_S, "w": 5_000_000, "s": 5.0}, {**_SS, "w": 4 * DAY}),
    Operator("l2_withdrawal", _REAL + """, p AS (SELECT *, last_value(tb) OVER (PARTITION BY symbol ORDER BY snap RANGE BETWEEN UNBOUNDED PRECEDING AND {w} PRECEDING) AS b0, last_value(ta) OVER (PARTITION BY symbol ORDER BY snap RANGE BETWEEN UNBOUNDED PRECEDING AND {w} PRECEDING) AS a0 FROM tot),
 d AS (SELECT symbol, snap, greatest(0, coalesce(b0, tb) - tb) AS lost_b, greatest(0, coalesce(a0, ta) - ta) AS lost_a FROM p) SELECT symbol, snap, CASE WHEN lost_b + lost_a = 0 THEN 0.0 ELSE (lost_b - lost_a) / (lost_b + lost_a) END AS asymmetry FROM d""", {**_S, "w": 5_000_000}, {**_SS, "w": 4 * DAY}),
    Operator("fe01_book_ofi", f"""WITH {_RESTING}, d AS (SELECT *, dense_rank() OVER (PARTITION BY symbol ORDER BY snap) AS k, row_number() OVER (PARTITION BY symbol, snap, side ORDER BY {_FIRST}) AS place FROM lv),
 u AS (SELECT symbol, k, side, price, v FROM d WHERE place <= 10 UNION ALL SELECT symbol, k + 1, side, price, -v FROM d WHERE place <= 10), g AS (SELECT symbol, k, side, price, sum(v) AS dv FROM u GROUP BY 1, 2, 3, 4),
 r AS (SELECT *, dv / (row_number() OVER (PARTITION BY symbol, k, side ORDER BY {_FIRST})) AS part FROM g), t AS (SELECT DISTINCT symbol, k, snap FROM d)
 SELECT t.symbol, t.snap, CASE WHEN t.k = 1 THEN 0.0 ELSE round(sum(CASE WHEN side = 'B' THEN part ELSE -part END), 6) END AS ofi FROM t JOIN r ON t.symbol = r.symbol AND t.k = r.k GROUP BY t.symbol, t.snap, t.k""", _S, _SS),
    Operator("fe31_normalizer", _BOOK + """, best AS (SELECT t.symbol, t.snap, bb, ba, sum(v) AS top FROM tot t JOIN lv l ON t.symbol = l.symbol AND t.snap = l.snap AND l.price IN (t.bb, t.ba) GROUP BY 1, 2, 3, 4), md AS (SELECT symbol, MEDIAN(top) AS mid_top FROM best GROUP BY symbol)
 SELECT b.symbol, b.snap, round(top / mid_top, 9) AS depth, round((ba - bb) / 2 / {atr}, 9) AS move FROM best b JOIN md ON b.symbol = md.symbol""", {**_S, "atr": 10.0}, {**_SS, "atr": 50.0}),
    Operator("pr01_staircase", f"""WITH {_LV}, k AS (SELECT *, row_number() OVER (PARTITION BY symbol, snap ORDER BY n) AS place, count(*) OVER (PARTITION BY symbol, snap) AS levels FROM lv),
 md AS (SELECT symbol, snap, max(CASE WHEN place = floor(levels / 2) + 1 THEN n END) AS upper_median FROM k GROUP BY 1, 2), sc AS (SELECT l.symbol, l.snap, l.side, l.price, l.v, l.n, least(1.0, greatest(0.0, 0.4 / (1 + ln(1 + l.n)) + 0.35 * l.most / l.v + 0.25 * greatest(0.0, 1 - l.n / upper_median))) AS score FROM lv l JOIN md ON l.symbol = md.symbol AND l.snap = md.snap)
 SELECT symbol, snap, side, price, v, n, round(score, 9) AS score, CASE WHEN score >= 0.65 THEN 'FRAGILE' WHEN score <= 0.35 THEN 'SOLID' ELSE 'MODERATE' END AS state FROM sc""", _S, _SS),
    Operator("agg15_net_aggression", """WITH o AS (SELECT m.symbol, m.ts_us - m.ts_us % {step} AS snap, m.side, m.price, m.size, CASE WHEN (m.side = 'B' AND m.price >= q.ask - {tol}) OR (m.side = 'A' AND m.price <= q.bid + {tol}) THEN 1.0 ELSE 0.0 END AS takes FROM {mbo} m JOIN {quotes} q ON m.seq = q.seq AND m.symbol = q.symbol WHERE m.action = 'A'),
 l AS (SELECT symbol, snap, side, price, avg(takes) AS ratio, sum(size) AS v FROM o GROUP BY 1, 2, 3, 4) SELECT symbol, snap, round(sum(CASE WHEN side = 'B' THEN ratio * v ELSE -ratio * v END) / sum(v), 9) AS net FROM l GROUP BY 1, 2""", {**_S, "tol": 0.0}, {**_SS, "tol": 0.25}),
    Operator("agg17_top_concentration", f"WITH {_LV} SELECT symbol, snap, side, max(v) / sum(v) AS largest, max_by(v, CASE WHEN side = 'B' THEN price ELSE -price END) / sum(v) AS best FROM lv GROUP BY symbol, snap, side", _S, _SS),
    Operator("tk07_top_levels", f"WITH {_LV}, r AS (SELECT symbol, snap, side, price, v, row_number() OVER (PARTITION BY symbol, snap, side ORDER BY {_FIRST}) AS place FROM lv) SELECT * FROM r WHERE place <= {{depth}}", {**_S, "depth": 10}, {**_SS, "depth": 3}),
    Operator("tk10_ladder_rows", f"WITH {_LV}, last1 AS (SELECT symbol, max(snap) AS snap FROM lv GROUP BY symbol) SELECT l.symbol, l.side, l.price, l.v, row_number() OVER (PARTITION BY l.symbol ORDER BY l.price DESC, l.side) AS place FROM lv l JOIN last1 t ON l.symbol = t.symbol AND l.snap = t.snap", _S, _SS),
    Operator("flt07_empty_frames", _BOOK + ", f AS (SELECT symbol, ts_us - ts_us % {step} AS snap, count(*) FILTER (WHERE action IN ('F', 'T')) AS trades FROM {mbo} GROUP BY 1, 2) SELECT f.symbol, f.snap, trades, coalesce(tb + ta, 0) AS depth FROM f LEFT JOIN tot t ON f.symbol = t.symbol AND f.snap = t.snap WHERE trades > 0 OR tb + ta > 0", _S, _SS),
    Operator("ex03_sweep", f"""WITH {_LV}, c AS (SELECT *, sum(v) OVER (PARTITION BY symbol, snap, side ORDER BY {_FIRST} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - v AS before FROM lv),
 f AS (SELECT *, least(v, greatest(0, {{lots}} - before)) AS got FROM c) SELECT symbol, snap, side, CAST(sum(got) AS BIGINT) AS filled, sum(price * got) / sum(got) AS vwap, count(*) FILTER (WHERE got > 0) - 1 AS slippage FROM f GROUP BY 1, 2, 3""", {**_S, "lots": 50}, {**_SS, "lots": 120}),
    Operator("sd01_pull_before_touch", f"WITH {_MATCH}, {_SD01} SELECT symbol, side, price, n, last_us, round(confidence, 9) AS confidence FROM sd1 WHERE confidence >= 0.3", _D1, _D1S),
    Operator("sd02_layering", f"WITH {_SD02} SELECT symbol, side, snap, price, n, levels, last_us, round(confidence, 9) AS confidence FROM sd2 WHERE confidence >= 0.3", _D2, _D2S),
    Operator("sd03_iceberg", f"WITH {_SD03} SELECT symbol, side, price, n, last_us, round(confidence, 9) AS confidence FROM sd3 WHERE confidence >= 0.3", _D3, _D3S),
    Operator("sd04_phantom_wall", f"WITH {_MATCH}, {_SD04} SELECT symbol, seq, side, price, round(confidence, 9) AS confidence FROM sd4 WHERE confidence >= 0.3", _D4, _D4S),
    Operator("sd05_authenticity", f"""WITH {_MATCH}, {_SD01}, {_SD02}, {_SD03}, {_SD04}, every AS (SELECT symbol, confidence AS c, 0.35 AS w, 'pull' AS kind FROM sd1 UNION ALL SELECT symbol, confidence, 0.30, 'layer' FROM sd2 UNION ALL SELECT symbol, confidence, 0.10, 'iceberg' FROM sd3 UNION ALL SELECT symbol, confidence, 0.25, 'phantom' FROM sd4),
 most AS (SELECT symbol, kind, w, max(c) AS c FROM every WHERE c >= 0.3 GROUP BY 1, 2, 3), risk AS (SELECT s.symbol, coalesce(sum(w * c), 0.0) AS r FROM (SELECT DISTINCT symbol FROM {{mbo}}) s LEFT JOIN most m ON s.symbol = m.symbol GROUP BY s.symbol)
 SELECT symbol, round(r, 9) AS risk, round(greatest(0.15, 1 - least(1.0, power(r, 1 / 1.5))), 9) AS authenticity FROM risk""", {**_D1, **_D2, **_D3, **_D4}, {**_D1S, **_D2S, **_D3S, **_D4S}),
    Operator("jn04_level_spoof", f"""WITH {_MATCH}, {_SD01}, l AS (SELECT symbol, side, price, CAST(sum(size) AS BIGINT) AS v FROM {{mbo}} WHERE action = 'A' GROUP BY 1, 2, 3)
 SELECT l.symbol, l.side, l.price, l.v, round(s.confidence, 9) AS confidence FROM l LEFT JOIN sd1 s ON l.symbol = s.symbol AND l.side = s.side AND l.price = s.price""", _D1, _D1S),
    Operator("cf02_pressure", f"WITH {_PRESS} SELECT symbol, snap, round(pressure, 9) AS pressure, round(CASE WHEN delta <> 0 THEN 0.6 * tanh(delta / 100.0) + 0.4 * pressure ELSE pressure END, 9) AS enriched FROM pr", _R, _RS),
    Operator("cf03_stall", f"WITH {_PRESS} SELECT symbol, snap, fail_b, fail_a, least(1.0, greatest(fail_b, fail_a) / ({{least}} * 2.0)) AS confidence FROM pr WHERE greatest(fail_b, fail_a) >= {{least}}", {**_R, "step": 1_500_000, "least": 3}, {**_RS, "least": 1}),
    Operator("cf05_states", f"""WITH {_PRESS}, fl AS (SELECT symbol, ts_us - ts_us % {{step}} AS snap, ts_us, seq, side, CASE WHEN lag(side) OVER (PARTITION BY symbol ORDER BY ts_us, seq) = side AND lag(side, 2) OVER (PARTITION BY symbol ORDER BY ts_us, seq) = side THEN 1 ELSE 0 END AS run FROM {{mbo}} WHERE action IN ('F', 'T')),
 lf AS (SELECT symbol, snap, max_by(run, ORD) AS run, max_by(side, ORD) AS side FROM fl GROUP BY 1, 2),
 raw AS (SELECT p.symbol, p.snap, p.pressure, CASE WHEN fail_b >= {{least}} THEN 'BULL_STALL' WHEN fail_a >= {{least}} THEN 'BEAR_STALL' WHEN run = 1 THEN CASE WHEN side = 'A' THEN 'BULL_STREAK' ELSE 'BEAR_STREAK' END WHEN pressure >= 0.4 THEN 'BULL_STREAK' WHEN pressure <= -0.4 THEN 'BEAR_STREAK' WHEN abs(pressure) <= 0.1 THEN 'BALANCED' END AS state FROM pr p LEFT JOIN lf ON p.symbol = lf.symbol AND p.snap = lf.snap),
 g AS (SELECT *, count(state) OVER (PARTITION BY symbol ORDER BY snap ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS held FROM raw)
 SELECT symbol, snap, round(pressure, 9) AS pressure, coalesce(max(state) OVER (PARTITION BY symbol, held), 'BALANCED') AS state FROM g""", {**_R, "least": 3}, {**_RS, "least": 2}),
    Operator("ag01_signal", f"""WITH {_PRESS}, {_LV}, {_TOT}, weights AS (SELECT * FROM (VALUES ('TRENDING', 0.2, 0.4, 0.3, 0.1, false), ('RANGING', 0.4, 0.2, 0.1, 0.3, false), ('VOLATILE', 0.1, 0.1, 0.1, 0.1, true), ('NEUTRAL', 0.25, 0.25, 0.25, 0.25, false)) AS w(regime, w1, w2, w3, w4, abstain)),
 x AS (SELECT p.symbol, p.snap, pressure, delta, (tb - ta) / (tb + ta) AS l1, CASE WHEN pressure >= 0.4 THEN greatest(pressure, 0.4) WHEN pressure <= -0.4 THEN least(pressure, -0.4) ELSE pressure END AS l2, delta / (abs(delta) + 1.0) AS l3, ({{auth}} - 0.5) * 2 AS l4,
   CASE WHEN (ba - bb) / bb > 0.8 THEN 'VOLATILE' WHEN abs(tb - ta) / (tb + ta) > 0.6 THEN 'TRENDING' WHEN abs(tb - ta) / (tb + ta) < 0.35 THEN 'RANGING' ELSE 'NEUTRAL' END AS regime FROM pr p JOIN tot t ON p.symbol = t.symbol AND p.snap = t.snap),
 d AS (SELECT x.*, abstain, least(1.0, greatest(-1.0, w1 * l1 + w2 * l2 + w3 * l3 + w4 * l4)) AS direction FROM x JOIN weights w ON x.regime = w.regime),
 c AS (SELECT *, least(1.0, abs(direction) * (0.6 + 0.4 * {{auth}})) AS confidence FROM d)
 SELECT symbol, snap, regime, round(direction, 9) AS direction, round(confidence, 9) AS confidence, round(0.5 * abs(pressure) + 0.5 * least(1.0, abs(delta) / 10.0), 9) AS urgency, abstain OR confidence < 0.25 OR {{auth}} < 0.3 OR abs(pressure) < 0.05 AS abstain,
 CASE WHEN abstain OR confidence < 0.2 THEN 0.0 ELSE round(0.5 + 1.5 * confidence * {{auth}}, 9) END AS size_multiplier FROM c""", {**_R, "auth": 0.8}, _RS),
]
