"""Filters, score tables, outcome statistics, screens and window features of the research part.  Frames hold both ends."""

from bookloom.operators.books import _PRESS, _R, _RS
from bookloom.operators.features import _D, _ROWS, _SCORES, _T, _last
from bookloom.operators.scans import _L, _LADDER, _LS
from bookloom.operators.sql import Operator

MIN, DAY = 60_000_000, 86_400_000_000


def _next(h: str) -> str:
    return f"OVER (PARTITION BY symbol ORDER BY ts_us RANGE BETWEEN CURRENT ROW AND {h} FOLLOWING)"


_OUT = f"""WITH f AS (SELECT symbol, seq, ts_us, mid, max(ts_us) OVER (PARTITION BY symbol) AS end_us, max_by(mid, ORD) {_next('{h1}')} AS m1, max_by(mid, ORD) {_next('{h2}')} AS m2, max_by(mid, ORD) {_next('{h3}')} AS m3 FROM {{quotes}}),
 u AS (SELECT symbol, seq, ts_us, 1 AS horizon, CASE WHEN ts_us + {{h1}} <= end_us THEN (m1 - mid) / {{atr}} END AS r FROM f UNION ALL SELECT symbol, seq, ts_us, 2, CASE WHEN ts_us + {{h2}} <= end_us THEN (m2 - mid) / {{atr}} END FROM f UNION ALL SELECT symbol, seq, ts_us, 3, CASE WHEN ts_us + {{h3}} <= end_us THEN (m3 - mid) / {{atr}} END FROM f)"""
_H, _HS = {"h1": 60_000_000, "h2": 300_000_000, "h3": 900_000_000, "atr": 10.0}, {"h1": 600 * MIN, "h2": 1200 * MIN, "h3": 3600 * MIN, "atr": 50.0}
_DAYS = f"""WITH dm AS (SELECT symbol, ts_us - ts_us % 86400000000 AS day_us, ts_us, seq, mid, bid_size + ask_size AS top, ts_us - ts_us % {{slot}} AS slot FROM {{quotes}}),
 sl AS (SELECT symbol, day_us, slot, max_by(mid, ORD) AS m FROM dm GROUP BY 1, 2, 3), df AS (SELECT symbol, day_us, m - lag(m) OVER (PARTITION BY symbol, day_us ORDER BY slot) AS d FROM sl),
 cal AS (SELECT a.symbol, a.day_us, a.depth, greatest(coalesce(b.rms, 0.25), 0.25) AS atr FROM (SELECT symbol, day_us, MEDIAN(top) AS depth FROM dm GROUP BY 1, 2) a JOIN (SELECT symbol, day_us, sqrt(avg(d * d)) AS rms FROM df GROUP BY 1, 2) b ON a.symbol = b.symbol AND a.day_us = b.day_us)"""
_FOLDS = f"WITH g AS (SELECT symbol, seq, row_number() {_ROWS}) AS rn, ntile(5) {_ROWS}) AS grp FROM {{mbo}}), span AS (SELECT symbol, grp AS fold, min(rn) AS lo, max(rn) AS hi FROM g GROUP BY 1, 2)"
_IMB = "(bid_size - ask_size) / (bid_size + ask_size)"
_BINS = ", ".join(f"count(CASE WHEN bin = {k} THEN 1 END) OVER w AS c{k}" for k in range(10))
_ENT = " + ".join(f"CASE WHEN c{k} > 0 THEN -c{k} / 30.0 * log2(c{k} / 30.0) ELSE 0.0 END" for k in range(10))
#: Coefficients of a published rational approximation of the error function (absolute error at most 1.5e-7).
_ERF = (0.3275911, 0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
_T1 = f"(1 / (1 + {_ERF[0]} * abs(z) / sqrt(2.0)))"
_PHI = f"0.5 * (1 + sign(z) * (1 - {_T1} * ({_ERF[1]} + {_T1} * ({_ERF[2]} + {_T1} * ({_ERF[3]} + {_T1} * ({_ERF[4]} + {_T1} * {_ERF[5]})))) * exp(-z * z / 2)))"
_PAIRS = """WITH dd AS (SELECT symbol, ts_us - ts_us % 86400000000 AS day_us, max_by(mid, ORD) AS m FROM {quotes} WHERE mid > 0 GROUP BY 1, 2), r AS (SELECT symbol, day_us, ln(m / lag(m) OVER (PARTITION BY symbol ORDER BY day_us)) AS r FROM dd),
 p AS (SELECT a.symbol AS a, b.symbol AS b, a.day_us, a.r AS x, b.r AS y FROM r a JOIN r b ON a.day_us = b.day_us AND a.symbol <> b.symbol WHERE a.r IS NOT NULL AND b.r IS NOT NULL),
 c AS (SELECT a, b, day_us, count(*) OVER w AS n, corr(x, y) OVER (PARTITION BY a, b ORDER BY day_us ROWS BETWEEN {k1} PRECEDING AND CURRENT ROW) AS c1, corr(x, y) OVER (PARTITION BY a, b ORDER BY day_us ROWS BETWEEN {k2} PRECEDING AND CURRENT ROW) AS c2, corr(x, y) OVER (PARTITION BY a, b ORDER BY day_us ROWS BETWEEN {k3} PRECEDING AND CURRENT ROW) AS c3
   FROM p WINDOW w AS (PARTITION BY a, b ORDER BY day_us ROWS BETWEEN {k3} PRECEDING AND CURRENT ROW)), adj AS (SELECT a, b, day_us, (c1 + 0.7 * c2 + 0.49 * c3) / 2.19 AS c FROM c WHERE n >= 3)"""
_K, _KS = {"k1": 19, "k2": 59, "k3": 119}, {"k1": 4, "k2": 9, "k3": 19}

OPERATORS = [
    Operator("flt02_labels", "SELECT seq, action, CASE action WHEN 'A' THEN 'ADD' WHEN 'C' THEN 'CANCEL' WHEN 'M' THEN 'MODIFY' ELSE 'FILL' END AS label FROM {mbo} WHERE action IN ('F', 'T', 'C')"),
    Operator("flt09_persistence", "WITH " + _LADDER + ", total AS (SELECT count(DISTINCT win) AS n FROM ladder) SELECT zone, side, windows FROM levels CROSS JOIN total WHERE windows >= greatest(floor(n * {share}), {least})", {**_L, "share": 0.1, "least": 3}, {**_LS, "least": 2}),
    Operator("flt10_candidates", f"""WITH f AS (SELECT m.symbol, m.side, m.size % 7 AS pattern, q.move FROM {{mbo}} m JOIN (SELECT symbol, seq, lead(mid, 5) {_ROWS}) - mid AS move FROM {{quotes}}) q ON m.seq = q.seq AND m.symbol = q.symbol WHERE q.move IS NOT NULL),
 c AS (SELECT side, pattern, count(*) AS n, avg(CASE WHEN move > 0 THEN 1.0 ELSE 0.0 END) AS hit_rate, avg(move) / stddev_pop(move) AS sharpe FROM f GROUP BY 1, 2)
 SELECT side, pattern, n, round(hit_rate, 9) AS hit_rate, round(sharpe, 9) AS sharpe, CASE WHEN n < {{least}} THEN 'n' WHEN hit_rate <= {{hit}} THEN 'hit_rate' WHEN sharpe <= {{sharpe}} THEN 'sharpe' ELSE 'kept' END AS verdict FROM c""", {"least": 200, "hit": 0.55, "sharpe": 0.3}, {"least": 30, "hit": 0.5, "sharpe": 0.0}),
    Operator("flt12_fragility_gate", f"SELECT symbol, seq, CASE WHEN x < 0.3 THEN 'calm' WHEN x < 0.6 THEN 'elevated' ELSE 'fragile' END AS bucket FROM (SELECT symbol, seq, abs({_IMB}) AS x FROM {{quotes}}) f"),
    Operator("flt13_cost_gate", _OUT + " SELECT symbol, horizon, round(max(abs(r)) * {atr} / 0.25, 6) AS edge, 2 * {bps} / 10000.0 * greatest(100 * {atr}, 100) / 0.25 AS need, max(abs(r)) * {atr} / 0.25 >= 2 * {bps} / 10000.0 * greatest(100 * {atr}, 100) / 0.25 AS passes FROM u WHERE r IS NOT NULL GROUP BY symbol, horizon", {**_H, "bps": 1.5}, _HS),
    Operator("flt14_tier_demotion", _SCORES + """, t AS (SELECT symbol, CASE WHEN p >= 0.85 THEN 'A' WHEN p >= 0.72 THEN 'B' WHEN p >= 0.6 THEN 'C' END AS tier, y FROM s), h AS (SELECT symbol, avg(y) FILTER (WHERE tier = 'A') AS a, avg(y) FILTER (WHERE tier = 'B') AS b, avg(y) FILTER (WHERE tier = 'C') AS c FROM t GROUP BY symbol)
 SELECT h.symbol, w.tier, CASE WHEN w.tier = 'A' AND coalesce(a >= {need}, true) THEN 'A' WHEN w.tier <= 'B' AND coalesce(b >= {need}, true) THEN 'B' WHEN coalesce(c >= {need}, true) THEN 'C' END AS becomes FROM h CROSS JOIN (VALUES ('A'), ('B'), ('C')) AS w(tier)""", {"need": 0.65}, {"need": 0.5}),
    Operator("flt15_volume_mask", "WITH b AS (SELECT symbol, ts_us - ts_us % {step} AS bar_us, sum(size) AS v FROM {mbo} WHERE action IN ('F', 'T') GROUP BY 1, 2) SELECT symbol, bar_us, v >= {floor} AS active FROM b".replace("SELECT symbol, bar_us, v", "SELECT symbol, bar_us, CAST(v AS BIGINT) AS volume, v"), {"step": 60_000_000, "floor": 100}, {"step": 1440 * MIN}),
    Operator("jn10_tier_outcomes", _SCORES + ", tiers AS (SELECT symbol, ts_us, CASE WHEN p >= 0.85 THEN 'A' ELSE 'B' END AS tier FROM s WHERE p >= 0.72) SELECT coalesce(t.tier, 'untiered') AS tier, s.symbol, count(*) AS n, round(avg(s.y), 9) AS hit_rate FROM s LEFT JOIN tiers t ON s.symbol = t.symbol AND s.ts_us = t.ts_us GROUP BY 1, 2"),
    Operator("jn13_cross_symbol", """WITH a AS (SELECT symbol, seq, ts_us, ts_us - ts_us % {w} AS block FROM {mbo} WHERE action = 'C' AND size >= {large}), o AS (SELECT symbol, ts_us, block FROM a UNION ALL SELECT symbol, ts_us, block - {w} FROM a UNION ALL SELECT symbol, ts_us, block + {w} FROM a)
 SELECT a.symbol, a.seq, count(*) AS events, count(DISTINCT o.symbol) AS symbols FROM a JOIN o ON a.block = o.block AND a.symbol <> o.symbol AND abs(a.ts_us - o.ts_us) <= {w} GROUP BY 1, 2""", {"w": 1_000_000, "large": 50}, {"w": 300 * MIN}),
    Operator("jn14_features", f"SELECT m.symbol, m.seq, m.size, q.ask - q.bid AS spread, {_IMB} AS imbalance FROM {{mbo}} m JOIN {{quotes}} q ON m.symbol = q.symbol AND m.seq = q.seq AND m.ts_us = q.ts_us"),
    Operator("agg18_outcome_stats", _OUT + " SELECT symbol, horizon, count(r) AS n, round(avg(r), 8) AS mean, round(stddev_pop(r), 8) AS sd, round(count(*) FILTER (WHERE r > 0.5) / count(r), 9) AS hit_rate FROM u GROUP BY symbol, horizon", _H, _HS),
    Operator("agg19_trailing_outcomes", _OUT + """, z AS (SELECT *, max(ts_us) OVER () AS now_us FROM u WHERE horizon = 1 AND r IS NOT NULL), g AS (SELECT symbol, count(*) AS n, avg(r) AS mean, stddev_samp(r) AS sd, avg(CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END) AS hit_rate FROM z WHERE ts_us >= now_us - {span} GROUP BY symbol)
 SELECT symbol, n, round(mean, 8) AS mean, round(sd, 8) AS sd, round(hit_rate, 9) AS hit_rate, hit_rate < 0.5 AND n >= 0.8 * {least} AS retire FROM g""", {**_H, "span": 30 * DAY, "least": 200}, {**_HS, "span": 10 * DAY}),
    Operator("agg22_cost_comparison", """WITH c AS (SELECT symbol, (ask - bid) / 2 * (bid_size % 5 + 1) + 2.04 AS cost, bid_size % 2 AS adverse FROM {quotes}), k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY cost) AS place, count(*) OVER (PARTITION BY symbol) AS n FROM c)
 SELECT symbol, round(avg(cost), 8) AS mean, round(sum(cost), 6) AS total, max(CASE WHEN place = floor(n / 2) + 1 THEN cost END) AS upper_median, round(avg(adverse), 9) AS adverse_share FROM k GROUP BY symbol"""),
    Operator("agg25_meta_report", _SCORES + ", g AS (SELECT symbol, y, p >= {first} AS before, p >= {first} AND seq % 3 <> 0 AS after FROM s) SELECT symbol, count(*) FILTER (WHERE before AND y = 1) AS tp_before, count(*) FILTER (WHERE before AND y = 0) AS fp_before, count(*) FILTER (WHERE after AND y = 1) AS tp_after, count(*) FILTER (WHERE after AND y = 0) AS fp_after, round(count(*) FILTER (WHERE after AND y = 1) / count(*) FILTER (WHERE after), 9) AS precision_after, round(count(*) FILTER (WHERE after AND y = 1) / sum(y), 9) AS recall_after FROM g GROUP BY symbol", {"first": 0.85}, {"first": 0.5}),
    Operator("agg27_day_calibration", _DAYS + " SELECT symbol, day_us, depth, round(atr, 8) AS atr FROM cal", {"slot": 60_000_000}, {"slot": 60 * MIN}),
    Operator("agg28_normalizer_tail", _DAYS + ", t AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY day_us DESC) AS place FROM cal) SELECT symbol, count(*) AS days, MEDIAN(depth) AS depth, round(avg(atr), 8) AS atr FROM t WHERE place <= 20 GROUP BY symbol", {"slot": 60_000_000}, {"slot": 60 * MIN}),
    Operator("agg29_class_weights", "WITH c AS (SELECT symbol, action, count(*) AS n FROM {mbo} GROUP BY 1, 2) SELECT symbol, action, n, round(sum(n) OVER (PARTITION BY symbol) / (count(*) OVER (PARTITION BY symbol) * n), 9) AS weight FROM c"),
    Operator("agg30_distribution", "WITH c AS (SELECT action, side, count(*) AS n FROM {mbo} GROUP BY 1, 2) SELECT action, side, n, n / sum(n) OVER () AS share FROM c"),
    Operator("agg31_precision_grid", _SCORES + f""", f AS (SELECT symbol, seq, lead(mid, 5) {_ROWS}) - mid AS r5, lead(mid, 20) {_ROWS}) - mid AS r20 FROM {{quotes}}), u AS (SELECT 5 AS horizon, p, CASE WHEN r5 > {{barrier}} THEN 1 ELSE 0 END AS y FROM s JOIN f ON s.seq = f.seq AND s.symbol = f.symbol WHERE r5 IS NOT NULL UNION ALL SELECT 20, p, CASE WHEN r20 > {{barrier}} THEN 1 ELSE 0 END FROM s JOIN f ON s.seq = f.seq AND s.symbol = f.symbol WHERE r20 IS NOT NULL),
 q AS (SELECT horizon, avg(y) AS base, QUANTILE(p, 0.9) AS t90, QUANTILE(p, 0.95) AS t95 FROM u GROUP BY horizon), k AS (SELECT horizon, base, 90 AS pct, t90 AS t FROM q UNION ALL SELECT horizon, base, 95, t95 FROM q)
 SELECT u.horizon, k.pct, round(k.t, 9) AS threshold, count(*) AS n, round(avg(y), 9) AS hit, round(avg(y) / max(base), 9) AS lift FROM u JOIN k ON u.horizon = k.horizon WHERE u.p >= k.t - 0.000000001 GROUP BY u.horizon, k.pct, k.t HAVING count(*) >= 10 AND avg(y) >= {{need}}""", {"barrier": 0.5, "need": 0.65}, {"need": 0.1}),
    Operator("wn04_global_tier", _SCORES + ", q AS (SELECT symbol, QUANTILE(p, 0.995) AS a, QUANTILE(p, 0.99) AS b, QUANTILE(p, 0.975) AS c FROM s GROUP BY symbol) SELECT s.symbol, s.seq, CASE WHEN p >= a THEN 'A' WHEN p >= b THEN 'B' ELSE 'C' END AS tier FROM s JOIN q ON s.symbol = q.symbol WHERE p >= c"),
    Operator("fe05_bvc", _D + f", z AS (SELECT symbol, seq, dm / stddev_pop(dm) {_ROWS} ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS z, count(dm) {_ROWS} ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS n FROM d) SELECT symbol, seq, round({_PHI}, 6) AS buy_share FROM z WHERE n >= 20"),
    Operator("fe11_hasbrouck", _T + f", d AS (SELECT *, mid - lag(mid) {_ROWS}) AS dm FROM t), e AS (SELECT *, abs(lag(dm) {_ROWS})) AS z FROM d), f AS (SELECT symbol, seq, count(z) {_last('{w}')} AS n, sum(z * dm) {_last('{w}')} AS zy, sum(z * signed) {_last('{w}')} AS zx, sum(CASE WHEN z IS NOT NULL THEN dm * signed END) {_last('{w}')} AS xy, sum(CASE WHEN z IS NOT NULL THEN signed * signed END) {_last('{w}')} AS xx FROM e) SELECT symbol, seq, round(CASE WHEN abs(zx) > 0.000001 THEN zy / zx ELSE xy / xx END, 7) AS hasbrouck FROM f WHERE n >= 8", {"w": 300_000_000}, {"w": 10000 * MIN}),
    Operator("fe14_markov_online", f"""WITH s AS (SELECT symbol, seq, ts_us, mid, least(2, floor(bid_size / (bid_size + ask_size) * 3)) * 2 + CASE WHEN (ask - bid) / mid * 10000.0 > {{bps}} THEN 1 ELSE 0 END AS state, CASE WHEN lead(mid) {_ROWS}) > mid THEN 1 ELSE 0 END AS up, row_number() {_ROWS}) AS seen FROM {{quotes}} WHERE mid > 0),
 k AS (SELECT *, count(*) OVER (PARTITION BY symbol, state ORDER BY ts_us, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS visits, sum(up) OVER (PARTITION BY symbol, state ORDER BY ts_us, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ups FROM s)
 SELECT symbol, seq, CAST(state AS BIGINT) AS state, CASE WHEN seen < 50 OR visits < 5 THEN 0.5 ELSE ups / visits END AS p_up FROM k""", {"bps": 2.0}, {"bps": 150.0}),
    Operator("fe17_energy_ratio", _D + f", f AS (SELECT symbol, seq, avg(dm * dm) {_ROWS} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS a, avg(dm * dm) {_ROWS} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS b, count(dm) {_ROWS} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS n FROM d) SELECT symbol, seq, CASE WHEN n < 20 OR b = 0 THEN 1.0 ELSE round(sqrt(a / b), 8) END AS ratio FROM f"),
    Operator("fe18_entropy_gate", f"WITH b AS (SELECT symbol, seq, ts_us, floor(({_IMB} + 1) / 2 * 9) AS bin FROM {{quotes}}), c AS (SELECT symbol, seq, count(*) OVER w AS n, {_BINS} FROM b WINDOW w AS (PARTITION BY symbol ORDER BY ts_us, seq ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)) SELECT symbol, seq, CASE WHEN n < 30 THEN 0.5 ELSE round(({_ENT}) / log2(10), 8) END AS entropy FROM c"),
    Operator("fe29_coherence", _PAIRS + " SELECT a, b, day_us, round(c, 6) AS coherence, CASE WHEN abs(c) >= {cut} THEN round(c, 6) ELSE 0.0 END AS adjacency FROM adj", {**_K, "cut": 0.15}, _KS),
    Operator("fe29_network_momentum", _PAIRS + """, m AS (SELECT symbol, day_us, (avg(r) OVER (PARTITION BY symbol ORDER BY day_us ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) / stddev_samp(r) OVER (PARTITION BY symbol ORDER BY day_us ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) + avg(r) OVER (PARTITION BY symbol ORDER BY day_us ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) / stddev_samp(r) OVER (PARTITION BY symbol ORDER BY day_us ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)) / 2 AS m FROM r WHERE r IS NOT NULL),
 t AS (SELECT a, b, day_us, CASE WHEN abs(c) >= 0.15 THEN c ELSE 0.0 END AS w FROM adj), n AS (SELECT t.a, t.day_us, sum(w * m.m) / sum(abs(w)) AS nb FROM t JOIN m ON t.b = m.symbol AND t.day_us = m.day_us GROUP BY 1, 2 HAVING sum(abs(w)) > 0)
 SELECT m.symbol, m.day_us, round(0.5 * n.nb + 0.5 * m.m, 6) AS momentum FROM m JOIN n ON m.symbol = n.a AND m.day_us = n.day_us WHERE m.m IS NOT NULL""", _K, _KS),
    Operator("l1_micro_velocity", f"WITH p AS (SELECT symbol, seq, ts_us, (bid * ask_size + ask * bid_size) / (bid_size + ask_size) AS micro FROM {{quotes}}), f AS (SELECT *, min_by(micro, ORD) {_last('{w}')} AS m0, min(ts_us) {_last('{w}')} AS t0 FROM p) SELECT symbol, seq, CASE WHEN ts_us = t0 THEN 0.0 ELSE round((micro - m0) / ((ts_us - t0) / 1000000.0), 9) END AS velocity FROM f", {"w": 250_000}, {"w": 250 * MIN}),
    Operator("l1_shape", f"WITH v AS (SELECT symbol, seq, bid_size AS b, ask_size AS a, (ask - bid) / mid * 10000.0 AS s, {_IMB} AS i FROM {{quotes}} WHERE mid > 0), n AS (SELECT *, sqrt(b * b + a * a + s * s + i * i) AS len FROM v) SELECT symbol, seq, round((0.25 * b + 0.25 * a + 0.2 * s + 0.3 * i) / len, 9) AS shape, round(b / len, 9) AS u0, round(a / len, 9) AS u1, round(i / len, 9) AS u3 FROM n"),
    Operator("lb05_firing_labels", f"""WITH e AS (SELECT symbol, seq, ts_us, max(ts_us) OVER (PARTITION BY symbol) AS end_us, CASE WHEN action = 'C' AND size >= {{large}} THEN ts_us END AS fire_us, CASE WHEN action = 'C' AND size >= {{large}} THEN size END AS score FROM {{mbo}}), f AS (SELECT *, min(fire_us) {_next('{h}')} AS first_us, max(score) {_next('{h}')} AS best FROM e)
 SELECT symbol, seq, CASE WHEN first_us IS NOT NULL THEN 1 WHEN ts_us + {{h}} <= end_us THEN 0 END AS fired, first_us, best FROM f""", {"h": 60_000_000, "large": 50}, {"h": 600 * MIN, "large": 80}),
    Operator("nb02_spearman", f"""WITH f AS (SELECT symbol, {_IMB} AS x, lead(mid, 10) {_ROWS}) - mid AS y FROM {{quotes}}), k AS (SELECT symbol, rank() OVER (PARTITION BY symbol ORDER BY x) + (count(*) OVER (PARTITION BY symbol, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY symbol ORDER BY y) + (count(*) OVER (PARTITION BY symbol, y) - 1) / 2.0 AS ry FROM f WHERE y IS NOT NULL) SELECT symbol, count(*) AS n, round(corr(rx, ry), 7) AS spearman FROM k GROUP BY symbol"""),
    Operator("nb03_binned_information", "WITH j AS (SELECT action, floor(price / {width}) AS bin, count(*) AS n FROM {mbo} GROUP BY 1, 2), k AS (SELECT n, sum(n) OVER () AS t, sum(n) OVER (PARTITION BY action) AS a, sum(n) OVER (PARTITION BY bin) AS b FROM j) SELECT round(sum(n / t * ln(n / a * t / b)), 9) AS nats FROM k", {"width": 10.0}),
    Operator("nb04_purged_folds", _FOLDS + " SELECT g.symbol, s.fold, count(*) FILTER (WHERE rn BETWEEN lo AND hi) AS test_rows, count(*) FILTER (WHERE rn < lo - {purge} OR rn > hi + {purge}) AS train_rows FROM g JOIN span s ON g.symbol = s.symbol GROUP BY 1, 2", {"purge": 50}),
    Operator("nb05_row_purge", _FOLDS + " SELECT g.symbol, s.fold, g.seq FROM g JOIN span s ON g.symbol = s.symbol WHERE (rn < lo AND lo - rn < {purge}) OR (rn > hi AND rn - hi < {purge})", {"purge": 50}),
    Operator("nb06_redundancy", f"WITH f AS (SELECT symbol, ask - bid AS a, bid_size + ask_size AS b, {_IMB} AS c, bid_size AS d, lead(mid, 5) {_ROWS}) - mid AS y FROM {{quotes}}), p AS (SELECT symbol, 'depth,bid_size' AS pair, corr(b, d) AS r, abs(corr(b, y)) AS s, abs(corr(d, y)) AS t FROM f WHERE y IS NOT NULL GROUP BY symbol UNION ALL SELECT symbol, 'imbalance,bid_size', corr(c, d), abs(corr(c, y)), abs(corr(d, y)) FROM f WHERE y IS NOT NULL GROUP BY symbol UNION ALL SELECT symbol, 'spread,depth', corr(a, b), abs(corr(a, y)), abs(corr(b, y)) FROM f WHERE y IS NOT NULL GROUP BY symbol) SELECT symbol, pair, round(r, 7) AS r, CASE WHEN abs(r) > {{cut}} THEN CASE WHEN s < t THEN 'first' ELSE 'second' END END AS dropped FROM p", {"cut": 0.85}, {"cut": 0.6}),
    Operator("nb09_quintiles", _SCORES + ", e AS (SELECT QUANTILE(p, 0.2) AS a, QUANTILE(p, 0.4) AS b, QUANTILE(p, 0.6) AS c, QUANTILE(p, 0.8) AS d FROM s), q AS (SELECT s.*, CASE WHEN p <= a THEN 1 WHEN p <= b THEN 2 WHEN p <= c THEN 3 WHEN p <= d THEN 4 ELSE 5 END AS quintile FROM s CROSS JOIN e) SELECT quintile, count(*) AS n, round(avg(y), 9) AS fill_rate, min(p) AS from_p, max(p) AS to_p FROM q GROUP BY quintile"),
    Operator("nb10_entry_types", f"WITH f AS (SELECT symbol, bid, min(ask) OVER (PARTITION BY symbol ORDER BY ts_us RANGE BETWEEN 1 FOLLOWING AND {{h}} FOLLOWING) AS low FROM {{quotes}}), u AS (SELECT symbol, 'aggressive' AS entry, 1 AS filled FROM f UNION ALL SELECT symbol, 'passive', CASE WHEN low <= bid THEN 1 ELSE 0 END FROM f UNION ALL SELECT symbol, 'tick_back', CASE WHEN low <= bid - 0.25 THEN 1 ELSE 0 END FROM f) SELECT symbol, entry, count(*) AS n, CAST(sum(filled) AS BIGINT) AS filled, round(avg(filled), 9) AS rate FROM u GROUP BY 1, 2", {"h": 60_000_000}, {"h": 300 * MIN}),
    Operator("nb11_realistic_pnl", "SELECT symbol, side, count(*) AS n, round(sum(-(seq % 4) * {tick_value} * (size % 5 + 1)), 6) AS gross, round(sum(-(seq % 4) * {tick_value} * (size % 5 + 1) - 2.04 * (size % 5 + 1)), 6) AS net FROM {mbo} WHERE action IN ('F', 'T') GROUP BY symbol, side", {"tick_value": 12.5}),
    Operator("nb14_lead_time", f"WITH e AS (SELECT m.symbol, m.seq, m.ts_us, m.action = 'C' AND m.size >= {{large}} AS cascade, abs({_IMB}) > {{flag}} AS flagged FROM {{mbo}} m JOIN {{quotes}} q ON m.seq = q.seq AND m.symbol = q.symbol), f AS (SELECT *, min(CASE WHEN flagged THEN ts_us END) {_ROWS} ROWS BETWEEN 3000 PRECEDING AND 1 PRECEDING) AS flag_us, max(CASE WHEN cascade THEN 1 ELSE 0 END) {_ROWS} ROWS BETWEEN 1 FOLLOWING AND 50 FOLLOWING) AS comes FROM e) SELECT symbol, count(*) FILTER (WHERE cascade) AS cascades, round(avg(ts_us - flag_us) FILTER (WHERE cascade), 3) AS mean_lead_us, round(count(*) FILTER (WHERE flagged AND coalesce(comes, 0) = 0) / count(*) FILTER (WHERE flagged), 9) AS false_share FROM f GROUP BY symbol", {"large": 50, "flag": 0.7}, {"large": 95}),
    Operator("nb16_rule_rows", "WITH t AS (SELECT symbol, QUANTILE(size, 0.95) AS cut FROM {mbo} GROUP BY symbol) SELECT m.symbol, m.seq, m.size FROM {mbo} m JOIN t ON m.symbol = t.symbol WHERE m.size > t.cut"),
    Operator("nb17_out_of_sample", _SCORES + f", k AS (SELECT *, row_number() {_ROWS}) / count(*) OVER (PARTITION BY symbol) <= {{share}} AS early FROM s), t AS (SELECT symbol, QUANTILE(p, 0.9) AS cut FROM k WHERE early GROUP BY symbol) SELECT k.symbol, round(t.cut, 9) AS cut, count(*) AS n, round(avg(y), 9) AS hit FROM k JOIN t ON k.symbol = t.symbol WHERE NOT early AND p >= t.cut GROUP BY k.symbol, t.cut", {"share": 0.7}),
    Operator("pt01_event_shape", "SELECT symbol, ts_us - ts_us % {step} AS win, count(*) AS n, avg(CASE WHEN action = 'A' THEN 1.0 ELSE 0.0 END) AS add_ratio, count(*) / ({step} / 1000000.0) AS intensity, round(avg(size), 9) AS mean_size, max(size) AS most, QUANTILE(size, 0.25) AS q25, QUANTILE(size, 0.75) AS q75, round(avg(CASE WHEN side = 'B' THEN 1.0 ELSE -1.0 END), 9) AS asymmetry, floor((max(ts_us) - min(ts_us)) / greatest(count(*) - 1, 1)) AS mean_gap, max(price) - min(price) AS spread FROM {mbo} GROUP BY 1, 2 HAVING count(*) >= {least}", {"step": 2_500_000, "least": 5}, {"step": DAY}),
    Operator("cs01_sustained_stall", f"WITH {_PRESS}, st AS (SELECT symbol, snap, CASE WHEN greatest(fail_b, fail_a) >= {{least}} THEN 1 ELSE 0 END AS stalled FROM pr), i AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY snap) - sum(stalled) OVER (PARTITION BY symbol ORDER BY snap ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM st) SELECT symbol, min(snap) AS from_us, max(snap) + {{step}} AS to_us, count(*) AS snaps FROM i WHERE stalled = 1 GROUP BY symbol, island HAVING max(snap) + {{step}} - min(snap) >= {{sustained}}", {**_R, "step": 1_500_000, "least": 3, "sustained": 60_000_000}, {**_RS, "least": 1, "sustained": DAY}),
    Operator("cs03_recurrent_stall", f"WITH {_PRESS}, st AS (SELECT symbol, snap FROM pr WHERE greatest(fail_b, fail_a) >= {{least}}) SELECT symbol, count(*) AS entries, min(snap) AS from_us, max(snap) AS to_us FROM st GROUP BY symbol HAVING count(*) >= {{entries}} AND max(snap) - min(snap) >= 86400000000", {**_R, "step": 1_500_000, "least": 3, "entries": 8}, {**_RS, "least": 1, "entries": 2}),
    Operator("ex04_adverse", f"SELECT symbol, seq, (mid - min(mid) {_next('{h1}')}) / 0.25 AS t1, (mid - min(mid) {_next('{h2}')}) / 0.25 AS t2, (mid - min(mid) {_next('{h3}')}) / 0.25 AS t3 FROM {{quotes}}", {"h1": 1_000_000, "h2": 5_000_000, "h3": 30_000_000}, {"h1": 100 * MIN, "h2": 500 * MIN, "h3": 3000 * MIN}),
    Operator("ex06_orders", f"SELECT symbol, seq, CASE WHEN x > 0 THEN 'BUY' ELSE 'SELL' END AS side, CASE WHEN x > 0 THEN bid - {{offset}} ELSE ask + {{offset}} END AS limit_price, greatest(1, floor(abs(x) * {{most}})) AS lots FROM (SELECT *, {_IMB} AS x FROM {{quotes}}) q WHERE abs(x) >= {{enter}}", {"offset": 0.25, "most": 5, "enter": 0.3}),
    Operator("st02_sliding", "WITH b AS (SELECT symbol, seq, ts_us, min(ts_us) OVER (PARTITION BY symbol) AS t0 FROM {mbo}), w AS (SELECT symbol, seq, ts_us, t0, t0 + ((ts_us - t0) - (ts_us - t0) % {stride}) - k * {stride} AS from_us FROM b CROSS JOIN (VALUES (0), (1), (2), (3)) AS o(k)) SELECT symbol, from_us, count(*) AS n, min(seq) AS least_seq FROM w WHERE from_us >= t0 AND ts_us < from_us + 4 * {stride} GROUP BY 1, 2", {"stride": 500_000}, {"stride": 500 * MIN}),
    Operator("st06_candle_fallback", "WITH e AS (SELECT m.symbol, m.ts_us, m.seq, CASE WHEN m.action IN ('F', 'T') THEN m.price ELSE q.mid END AS x, CASE WHEN m.action IN ('F', 'T') THEN m.size ELSE 0 END AS v FROM {mbo} m JOIN {quotes} q ON m.seq = q.seq AND m.symbol = q.symbol) SELECT symbol, ts_us - ts_us % {step} AS bucket_us, min_by(x, ORD) AS open, max(x) AS high, min(x) AS low, max_by(x, ORD) AS close, CAST(sum(v) AS BIGINT) AS volume FROM e GROUP BY 1, 2", {"step": 60_000_000}, {"step": 240 * MIN}),
    Operator("st07_frame_at_candle", "WITH c AS (SELECT symbol, ts_us - ts_us % {step} AS bucket_us, max_by(seq, ORD) AS seq FROM {quotes} GROUP BY 1, 2), grid AS (SELECT s.symbol, b.bucket_us FROM (SELECT DISTINCT symbol FROM c) s CROSS JOIN (SELECT DISTINCT bucket_us FROM c) b), j AS (SELECT g.symbol, g.bucket_us, c.seq, count(c.seq) OVER (PARTITION BY g.symbol ORDER BY g.bucket_us ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS held FROM grid g LEFT JOIN c ON g.symbol = c.symbol AND g.bucket_us = c.bucket_us) SELECT symbol, bucket_us, max(seq) OVER (PARTITION BY symbol, held) AS seq FROM j WHERE held > 0", {"step": 60_000_000}, {"step": 60 * MIN}),
    Operator("st10_distinct_events", "SELECT order_id, ts_us, action, min(seq) AS seq FROM (SELECT * FROM {mbo} UNION ALL SELECT * FROM {mbo} WHERE seq % 3 = 0) e GROUP BY 1, 2, 3"),
    Operator("src14_triple_view", "WITH g AS (SELECT m.*, grain, ts_us - ts_us % grain AS bucket_us FROM {mbo} m CROSS JOIN (VALUES ({g1}), ({g2}), ({g3})) AS o(grain)) SELECT symbol, grain, bucket_us, max_by(seq, ORD) AS seq, count(*) AS n FROM g GROUP BY 1, 2, 3", {"g1": 100_000, "g2": 1_000_000, "g3": 5_000_000}, {"g1": 100 * MIN, "g2": 1000 * MIN, "g3": 5000 * MIN}),
    Operator("tk05_actionable", "WITH z AS (SELECT symbol, side, price, count(*) AS n, CAST(sum(size) AS BIGINT) AS v, row_number() OVER (PARTITION BY symbol, side ORDER BY sum(size) DESC, price) AS place FROM {mbo} WHERE action IN ('F', 'T') GROUP BY 1, 2, 3) SELECT * FROM z WHERE place <= 5 AND v >= {total}", {"total": 30}),
    Operator("tk08_tape", f"SELECT symbol, seq, ts_us, price, size, side, place FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts_us DESC, seq DESC) AS place FROM {{mbo}} WHERE action IN ('F', 'T')) t WHERE place <= {{rows}}", {"rows": 30}),
    Operator("set03_complement", _FOLDS + " SELECT symbol, seq FROM g EXCEPT SELECT symbol, seq FROM g WHERE grp IN (2, 4)"),
    Operator("rg02_weights", f"WITH r AS (SELECT symbol, seq, CASE WHEN (ask - bid) > 0.9 THEN 'VOLATILE' WHEN abs({_IMB}) > 0.6 THEN 'TRENDING' WHEN abs({_IMB}) < 0.35 THEN 'RANGING' ELSE 'NEUTRAL' END AS regime, abs({_IMB}) AS c FROM {{quotes}}) SELECT r.symbol, r.seq, w1, w2, w3, w4, stops OR c < 0.25 AS abstain FROM r JOIN (VALUES ('TRENDING', 0.2, 0.4, 0.3, 0.1, false), ('RANGING', 0.4, 0.2, 0.1, 0.3, false), ('VOLATILE', 0.1, 0.1, 0.1, 0.1, true), ('NEUTRAL', 0.25, 0.25, 0.25, 0.25, false)) AS w(regime, w1, w2, w3, w4, stops) ON r.regime = w.regime"),
]
