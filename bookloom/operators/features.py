"""Rolling features, as-of joins, labels, folds and scores.  Frames are bounded in time, both ends included."""

from bookloom.operators.sql import Operator

MIN = 60_000_000


def _last(w: str) -> str:
    return f"OVER (PARTITION BY symbol ORDER BY ts_us RANGE BETWEEN {w} PRECEDING AND CURRENT ROW)"


_ROWS = "OVER (PARTITION BY symbol ORDER BY ts_us, seq"
_D = f"WITH d AS (SELECT *, mid - lag(mid) {_ROWS}) AS dm, ln(mid / lag(mid) {_ROWS})) AS r, lag(ts_us) {_ROWS}) AS before_us FROM {{quotes}} WHERE mid > 0)"
_T = f"""WITH q AS (SELECT m.symbol, m.seq, m.ts_us, m.price, m.size, m.side, q.bid, q.ask, q.mid FROM {{mbo}} m JOIN {{quotes}} q ON m.seq = q.seq AND m.symbol = q.symbol WHERE m.action IN ('F', 'T')),
 t AS (SELECT *, CASE WHEN side = 'A' THEN size ELSE -size END AS signed FROM q)"""
_M = f"WITH m AS (SELECT symbol, seq, ts_us, mid FROM {{quotes}} WHERE mid > 0)"
# Both sides meet by blocks of one horizon (a row's own block and the next): an equi join, linear in the events.
_BARRIER = _M + """, ahead AS (SELECT *, ts_us - ts_us % {horizon} AS block FROM m),
 own AS (SELECT *, block AS met FROM ahead UNION ALL SELECT *, block + {horizon} AS met FROM ahead),
 hit AS (SELECT m.symbol, m.seq, m.mid, min(CASE WHEN p.mid >= m.mid + {up} THEN p.ts_us END) AS up_us, min(CASE WHEN p.mid <= m.mid - {down} THEN p.ts_us END) AS down_us, max(p.mid) - m.mid AS mfe, m.mid - min(p.mid) AS mae, count(p.seq) AS seen,
   max(m.ts_us) + {horizon} AS deadline FROM own m LEFT JOIN ahead p ON m.symbol = p.symbol AND m.met = p.block AND p.ts_us > m.ts_us AND p.ts_us <= m.ts_us + {horizon} GROUP BY m.symbol, m.seq, m.mid),
 ends AS (SELECT symbol, max(ts_us) AS end_us FROM m GROUP BY symbol),
 lab AS (SELECT h.*, CASE WHEN up_us IS NOT NULL AND (down_us IS NULL OR up_us < down_us) THEN 1 WHEN down_us IS NOT NULL THEN -1 WHEN deadline <= end_us THEN 0 END AS label FROM hit h JOIN ends e ON h.symbol = e.symbol)"""
_SCORES = "WITH s AS (SELECT seq, CAST((seq * 7919) % 1000 AS DOUBLE) / 1000 AS p, CASE WHEN side = 'B' THEN 1 ELSE 0 END AS y, symbol, ts_us FROM {mbo})"

# Buckets of equal volume; the form of `frames` runs, this one is its oracle.
_VPIN = """WITH t AS (SELECT symbol, seq, ts_us, size, side FROM {mbo} WHERE action IN ('F', 'T')),
 c AS (SELECT *, CAST(sum(size) OVER (PARTITION BY symbol ORDER BY ts_us, seq) AS BIGINT) AS en FROM t),
 b AS (SELECT symbol, ts_us, side, en, en - size AS st, unnest(generate_series(CAST(floor((en - size) / {bucket}) AS BIGINT), CAST(ceil(en / {bucket}) AS BIGINT) - 1)) AS bucket FROM c),
 p AS (SELECT symbol, bucket, ts_us, side, least(en, (bucket + 1) * {bucket}) - greatest(st, bucket * {bucket}) AS v FROM b),
 g AS (SELECT symbol, bucket, max(ts_us) AS end_us, sum(CASE WHEN side = 'A' THEN v ELSE 0 END) AS buy, sum(v) AS total FROM p GROUP BY 1, 2 HAVING sum(v) >= {bucket}),
 r AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY bucket) AS k FROM g),
 m AS (SELECT a.symbol, a.bucket, a.end_us, count(*) AS n, avg(abs(2 * b.buy - b.total) / b.total) AS mean FROM r a JOIN r b ON a.symbol = b.symbol AND b.k BETWEEN a.k - {last} + 1 AND a.k GROUP BY 1, 2, 3)"""

OPERATORS = [
    Operator("fe02_vpin", _VPIN + " SELECT symbol, bucket, end_us, CASE WHEN n = {last} THEN round(mean, 9) END AS vpin FROM m", {"bucket": 500, "last": 50}, {"bucket": 150}),
    Operator("l2_flow_toxicity", _VPIN + ", q AS (SELECT symbol, seq, ts_us FROM {quotes}), e AS (SELECT q.symbol, q.seq, max(bucket) AS bucket FROM q LEFT JOIN m ON q.symbol = m.symbol AND m.end_us <= q.ts_us GROUP BY 1, 2) SELECT e.symbol, e.seq, CASE WHEN n = {last} THEN round(mean, 9) END AS vpin FROM e LEFT JOIN m ON e.symbol = m.symbol AND e.bucket = m.bucket", {"bucket": 500, "last": 50}, {"bucket": 150}),
    Operator("l1_static", """SELECT symbol, seq, (ask - bid) / 0.25 AS spread_ticks, round((ask - bid) / mid * 10000.0, 6) AS spread_bps, bid_size, ask_size, (bid_size - ask_size) / (bid_size + ask_size) AS top_imbalance FROM {quotes} WHERE mid > 0"""),
    Operator("l1_velocities", f"""WITH f AS (SELECT *, min_by(bid, ORD) {_last('{w}')} AS b0, min_by(ask, ORD) {_last('{w}')} AS a0, min_by(ask - bid, ORD) {_last('{w}')} AS s0, min(ts_us) {_last('{w}')} AS t0 FROM {{quotes}})
 SELECT symbol, seq, CASE WHEN ts_us = t0 THEN 0.0 ELSE round(greatest(0.0, -(bid - b0) / ((ts_us - t0) / 1000000.0)), 9) END AS bid_retreat, CASE WHEN ts_us = t0 THEN 0.0 ELSE round(greatest(0.0, (ask - a0) / ((ts_us - t0) / 1000000.0)), 9) END AS ask_advance,
 CASE WHEN ts_us = t0 THEN 0.0 ELSE round((ask - bid - s0) / ((ts_us - t0) / 1000000.0), 9) END AS spread_rate FROM f""", {"w": 250_000}, {"w": 250 * MIN}),
    Operator("l1_refresh_rate", f"SELECT symbol, seq, count(CASE WHEN action = 'A' AND side = 'B' THEN 1 END) {_last('{w}')} AS bid_adds, count(CASE WHEN action = 'A' AND side = 'A' THEN 1 END) {_last('{w}')} AS ask_adds FROM {{mbo}}", {"w": 100_000}, {"w": 600 * MIN}),
    Operator("l1_tick_streak", f"""WITH s AS (SELECT symbol, seq, ts_us, sign(mid - lag(mid) {_ROWS})) AS dir FROM {{quotes}}),
 g AS (SELECT *, CAST(coalesce(dir, 0) AS BIGINT) AS d, CASE WHEN coalesce(dir, 0) = coalesce(lag(dir) {_ROWS}), 0) THEN 0 ELSE 1 END AS turn FROM s),
 i AS (SELECT *, sum(turn) {_ROWS} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM g)
 SELECT symbol, seq, CAST(d * least(row_number() OVER (PARTITION BY symbol, island ORDER BY ts_us, seq), 100) AS BIGINT) AS streak FROM i"""),
    Operator("l1_trade_ratios", _T + f", f AS (SELECT symbol, seq, avg(CASE WHEN side = 'B' THEN 1.0 ELSE 0.0 END) {_last('{w}')} AS at_bid, max(size) {_last('{w}')} AS most, MEDIAN(size) {_last('{w}')} AS mid_size FROM t) SELECT symbol, seq, round(at_bid, 9) AS at_bid, round(most / mid_size, 9) AS size_spike FROM f", {"w": 1_000_000}, {"w": 1000 * MIN}),
    Operator("l1_tick_acceleration", f"""WITH f AS (SELECT symbol, seq, count(*) OVER (PARTITION BY symbol ORDER BY ts_us RANGE BETWEEN {{half}} PRECEDING AND CURRENT ROW) AS late, count(*) OVER (PARTITION BY symbol ORDER BY ts_us RANGE BETWEEN {{whole}} PRECEDING AND CURRENT ROW) AS every FROM {{quotes}})
 SELECT symbol, seq, (late - (every - late)) / 0.25 / 0.25 AS acceleration FROM f""", {"half": 250_000, "whole": 500_000}, {"half": 250 * MIN, "whole": 500 * MIN}),
    Operator("fe04_lee_ready", _T + f", b AS (SELECT *, lag(price) {_ROWS}) AS before FROM t) SELECT symbol, seq, CASE WHEN price > mid THEN 1 WHEN price < mid THEN -1 WHEN before IS NULL OR price >= before THEN 1 ELSE -1 END AS aggressor FROM b"),
    Operator("fe06_trade_ofi", _T + f" SELECT symbol, seq, CAST(sum(signed) {_last('{w1}')} AS BIGINT) AS ofi_1, CAST(sum(signed) {_last('{w2}')} AS BIGINT) AS ofi_2, CAST(sum(signed) {_last('{w3}')} AS BIGINT) AS ofi_3 FROM t", {"w1": 1_000_000, "w2": 5_000_000, "w3": 30_000_000}, {"w1": 100 * MIN, "w2": 500 * MIN, "w3": 3000 * MIN}),
    Operator("fe07_realized_variance", _D + f", f AS (SELECT symbol, seq, sum(r * r) {_last('{w}')} AS total, first_value(r) {_last('{w}')} AS head FROM d) SELECT symbol, seq, round(coalesce(total, 0) - coalesce(head * head, 0), 8) AS rv FROM f", {"w": 30_000_000}, {"w": 3000 * MIN}),
    Operator("fe08_roll_spread", _D + f", e AS (SELECT *, lag(dm) {_ROWS}) AS before FROM d), f AS (SELECT symbol, seq, mid, covar_pop(dm, before) {_last('{w}')} AS c, count(before) {_last('{w}')} AS n FROM e) SELECT symbol, seq, CASE WHEN n < 3 OR c >= 0 THEN 0.0 ELSE round(2 * sqrt(-c) / mid * 10000.0, 4) END AS roll_bps FROM f", {"w": 60_000_000}, {"w": 6000 * MIN}),
    Operator("fe09_kyle_lambda", _T + f", d AS (SELECT *, mid - lag(mid) {_ROWS}) AS dm FROM t), f AS (SELECT symbol, seq, CASE WHEN count(dm) {_last('{w}')} >= 10 THEN regr_slope(dm, signed) {_last('{w}')} END AS slope FROM d) SELECT symbol, seq, round(slope, 7) AS kyle_lambda FROM f WHERE slope IS NOT NULL", {"w": 300_000_000}, {"w": 10000 * MIN}),
    Operator("fe10_tick_pin", _T + f", d AS (SELECT *, sign(price - lag(price) {_ROWS})) AS s FROM t), f AS (SELECT symbol, seq, count(CASE WHEN s > 0 THEN 1 END) {_last('{w}')} AS up, count(CASE WHEN s < 0 THEN 1 END) {_last('{w}')} AS down FROM d) SELECT symbol, seq, CASE WHEN up + down = 0 THEN 0.0 ELSE abs(up - down) / (up + down) END AS pin FROM f", {"w": 60_000_000}, {"w": 6000 * MIN}),
    Operator("fe12_depth_response", _M.replace("seq, ts_us, mid", "seq, ts_us, mid, bid_size + ask_size AS depth") + f""", d AS (SELECT *, depth - lag(depth) {_ROWS}) AS dd, first_value(mid) OVER (PARTITION BY symbol ORDER BY ts_us RANGE BETWEEN {{lag}} FOLLOWING AND UNBOUNDED FOLLOWING) AS ahead FROM m),
 f AS (SELECT symbol, seq, sum((ahead - mid) * dd) {_last('{w}')} AS xy, sum(dd * dd) {_last('{w}')} AS xx, count(dd) {_last('{w}')} AS n FROM d WHERE ahead IS NOT NULL) SELECT symbol, seq, round(xy / xx, 7) AS qdif FROM f WHERE n >= 10 AND xx > 0""", {"lag": 950_000, "w": 60_000_000}, {"lag": 950 * MIN, "w": 10000 * MIN}),
    Operator("fe13_markov_states", f"""WITH s AS (SELECT symbol, seq, ts_us, mid, CASE WHEN bid_size / (bid_size + ask_size) < 0.4 THEN 2 WHEN bid_size / (bid_size + ask_size) < 0.6 THEN 1 ELSE 0 END * 2 + CASE WHEN ask - bid < {{tight}} THEN 0 ELSE 1 END AS state, lead(mid) {_ROWS}) AS ahead FROM {{quotes}}),
 k AS (SELECT *, count(*) OVER (PARTITION BY symbol, state ORDER BY ts_us, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS visits, coalesce(sum(CASE WHEN ahead > mid THEN 1 ELSE 0 END) OVER (PARTITION BY symbol, state ORDER BY ts_us, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ups FROM s)
 SELECT symbol, seq, CAST(state AS BIGINT) AS state, visits, CAST(ups AS BIGINT) AS ups, ups / visits AS p_up FROM k""", {"tight": 0.03}, {"tight": 0.6}),
    Operator("fe15_fragility_index", f"""WITH f AS (SELECT symbol, seq, (ask - bid) / 0.25 AS ticks, count(*) {_last('{w}')} AS rate, abs(bid_size - ask_size) / (bid_size + ask_size) AS toxic FROM {{quotes}}),
 g AS (SELECT *, 0.35 * least(1.0, rate / 50.0) + 0.35 * least(greatest((ticks - 1) / 4, 0.0), 1.0) + 0.30 * toxic AS fast FROM f) SELECT symbol, seq, round(fast, 9) AS fragility, CASE WHEN fast > 0.7 THEN 0.5 ELSE 1.0 END AS size_factor, CASE WHEN fast > 0.6 THEN 0.40 ELSE 0.55 END AS threshold FROM g""", {"w": 100_000}, {"w": 600 * MIN}),
    Operator("fe16_energy", f"WITH d AS (SELECT symbol, seq, ts_us, mid - lag(mid) {_ROWS}) AS dm FROM {{quotes}}), f AS (SELECT symbol, seq, avg(dm * dm) {_ROWS} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS short_power, avg(dm * dm) {_ROWS} ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS long_power FROM d) SELECT symbol, seq, round(sqrt(short_power), 6) AS rms, short_power, long_power FROM f WHERE long_power IS NOT NULL"),
    Operator("l2_depth_change", f"""WITH q AS (SELECT *, bid_size + ask_size AS depth FROM {{quotes}}), f AS (SELECT symbol, seq, depth, max_by(depth, ORD) OVER (PARTITION BY symbol ORDER BY ts_us RANGE BETWEEN UNBOUNDED PRECEDING AND {{w}} PRECEDING) AS was FROM q) SELECT symbol, seq, depth, was, CASE WHEN was IS NULL THEN 0.0 ELSE (depth - was) / {{s}} END AS rate FROM f""", {"w": 5_000_000, "s": 5.0}, {"w": 500 * MIN}),
    Operator("l2_signed_flow", _T + f", f AS (SELECT symbol, seq, sum(signed) {_last('{w}')} AS s, sum(size) {_last('{w}')} AS v FROM t) SELECT symbol, seq, round(s / v, 9) AS flow FROM f", {"w": 60_000_000}, {"w": 6000 * MIN}),
    Operator("jn07_asof_backward", """WITH t AS (SELECT symbol, seq, ts_us, price FROM {mbo} WHERE action IN ('F', 'T')), u AS (SELECT symbol, ts_us, 0 AS kind, seq, price, NULL AS q_seq FROM t UNION ALL SELECT symbol, ts_us + {ahead}, 1, seq, NULL, seq FROM {quotes}),
 f AS (SELECT *, max(CASE WHEN kind = 0 THEN ts_us END) OVER (PARTITION BY symbol ORDER BY ts_us, kind, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS trade_us FROM u) SELECT symbol, q_seq AS seq, ts_us AS target_us, trade_us FROM f WHERE kind = 1""", {"ahead": 60_000_000}, {"ahead": 60 * MIN}),
    Operator("jn08_asof_forward", f"SELECT symbol, seq, first_value(seq) OVER (PARTITION BY symbol ORDER BY ts_us RANGE BETWEEN {{lag}} FOLLOWING AND UNBOUNDED FOLLOWING) AS ahead_seq FROM {{quotes}}", {"lag": 950_000}, {"lag": 950 * MIN}),
    Operator("jn11_activity_mask", f"WITH e AS (SELECT symbol, seq, ts_us, max(CASE WHEN action = 'T' AND size >= 90 THEN ts_us END) {_last('{after}')} AS last_us, min(CASE WHEN action = 'T' AND size >= 90 THEN ts_us END) OVER (PARTITION BY symbol ORDER BY ts_us RANGE BETWEEN CURRENT ROW AND {{before}} FOLLOWING) AS next_us FROM {{mbo}}) SELECT symbol, seq, (last_us IS NOT NULL OR next_us IS NOT NULL) AS active FROM e", {"after": 0, "before": 60_000_000}, {"before": 600 * MIN}),
    Operator("jn12_embargo", """WITH days AS (SELECT DISTINCT symbol, ts_us - ts_us % 86400000000 AS day_us FROM {mbo}), bad AS (SELECT DISTINCT symbol, ts_us - ts_us % 86400000000 AS day_us FROM {mbo} WHERE action = 'C' AND size >= {large})
 SELECT d.symbol, d.day_us FROM days d ANTI JOIN bad b ON d.symbol = b.symbol AND abs(d.day_us - b.day_us) <= {away}""", {"large": 90, "away": 1_209_600_000_000}, {"large": 100, "away": 86_400_000_000}),
    Operator("jn06_level_union", """WITH l AS (SELECT symbol, side, price, ts_us - ts_us % {step} AS snap, CAST(sum(size) AS BIGINT) AS v FROM {mbo} WHERE action = 'A' GROUP BY 1, 2, 3, 4), n AS (SELECT symbol, side, price, snap + {step} AS snap, v FROM l)
 SELECT coalesce(l.symbol, n.symbol) AS symbol, coalesce(l.side, n.side) AS side, coalesce(l.snap, n.snap) AS snap, coalesce(l.price, n.price) AS price, coalesce(l.v, 0) - coalesce(n.v, 0) AS dv FROM l FULL OUTER JOIN n ON l.symbol = n.symbol AND l.side = n.side AND l.price = n.price AND l.snap = n.snap""", {"step": 100_000}, {"step": 1440 * MIN}),
    Operator("lb01_triple_barrier", _BARRIER + " SELECT symbol, seq, label FROM lab", {"up": 2.0, "down": 2.0, "horizon": 300_000_000}, {"up": 60.0, "down": 60.0, "horizon": 600 * MIN}),
    Operator("lb02_excursions", _BARRIER + " SELECT symbol, seq, mfe, mae, CASE WHEN label IS NULL THEN NULL WHEN label = 1 THEN CASE WHEN mae <= {stop} THEN 2 ELSE 1 END WHEN label = -1 THEN CASE WHEN mfe <= {stop} THEN -2 ELSE -1 END ELSE 0 END AS class FROM lab WHERE seen > 0", {"up": 2.0, "down": 2.0, "stop": 1.0, "horizon": 300_000_000}, {"up": 60.0, "down": 60.0, "stop": 20.0, "horizon": 600 * MIN}),
    Operator("lb03_cost_binary", f"WITH f AS (SELECT symbol, seq, lead(mid, {{h}}) {_ROWS}) - mid AS move FROM {{quotes}}) SELECT symbol, seq, CASE WHEN move > {{cost}} THEN 1 WHEN move < -{{cost}} THEN 0 END AS y FROM f", {"h": 10, "cost": 0.5}, {"cost": 5.0}),
    Operator("lb06_outcomes", f"""WITH f AS (SELECT symbol, seq, ts_us, mid, max_by(mid, ORD) OVER (PARTITION BY symbol ORDER BY ts_us RANGE BETWEEN CURRENT ROW AND {{h}} FOLLOWING) AS ahead, max(ts_us) OVER (PARTITION BY symbol) AS end_us FROM {{quotes}})
 SELECT symbol, seq, CASE WHEN ts_us + {{h}} > end_us THEN 'INCOMPLETE' WHEN (ahead - mid) / {{atr}} > 0.5 THEN 'CONTINUATION' WHEN (ahead - mid) / {{atr}} < -0.5 THEN 'REVERSAL' ELSE 'FLAT' END AS outcome FROM f""", {"h": 60_000_000, "atr": 10.0}, {"h": 600 * MIN, "atr": 50.0}),
    Operator("nb01_forward_returns", f"SELECT symbol, seq, lead(mid, 1) {_ROWS}) - mid AS r1, lead(mid, 10) {_ROWS}) - mid AS r10, lead(mid, 50) {_ROWS}) - mid AS r50 FROM {{quotes}}"),
    Operator("nb07_column_audit", "SELECT symbol, count(*) AS n, count(*) - count(price) AS null_price, count(DISTINCT price) AS prices, count(DISTINCT size) AS sizes, min(size) = max(size) AS constant_size FROM {mbo} GROUP BY symbol"),
    Operator("nb08_label_entropy", "WITH c AS (SELECT action, count(*) AS n FROM {mbo} GROUP BY action), p AS (SELECT n / sum(n) OVER () AS p FROM c) SELECT round(-sum(p * log2(p)), 9) AS bits FROM p"),
    Operator("nb02_auc", _SCORES + ", r AS (SELECT symbol, y, rank() OVER (PARTITION BY symbol ORDER BY p) + (count(*) OVER (PARTITION BY symbol, p) - 1) / 2.0 AS place FROM s) SELECT symbol, round((sum(CASE WHEN y = 1 THEN place ELSE 0 END) - count(*) FILTER (WHERE y = 1) * (count(*) FILTER (WHERE y = 1) + 1) / 2.0) / (count(*) FILTER (WHERE y = 1) * count(*) FILTER (WHERE y = 0)), 9) AS auc FROM r GROUP BY symbol"),
    Operator("agg20_tier_hit_rate", _SCORES + " SELECT symbol, CASE WHEN p >= 0.85 THEN 'A' WHEN p >= 0.72 THEN 'B' WHEN p >= 0.6 THEN 'C' ELSE 'none' END AS tier, count(*) AS n, round(avg(y), 9) AS hit_rate FROM s GROUP BY 1, 2 HAVING count(*) >= {least}", {"least": 10}),
    Operator("agg23_calibration", _SCORES + ", d AS (SELECT least(CAST(floor(p * 10) AS BIGINT), 9) AS decile, y FROM s) SELECT decile, count(*) AS n, round(avg(y), 9) AS hit_rate, round(avg(y) - (decile + 0.5) / 10, 9) AS gap FROM d GROUP BY decile HAVING count(*) >= 30"),
    Operator("agg24_brier", _SCORES + " SELECT symbol, round(avg((p - y) * (p - y)), 9) AS brier FROM s GROUP BY symbol"),
    Operator("agg21_scorecard", """WITH t AS (SELECT symbol, CASE WHEN side = 'A' THEN size ELSE -size END AS pnl FROM {mbo} WHERE action = 'F') SELECT symbol, count(*) AS trades, CAST(sum(pnl) AS BIGINT) AS total, round(avg(pnl) FILTER (WHERE pnl > 0), 9) AS avg_win, round(avg(pnl) FILTER (WHERE pnl < 0), 9) AS avg_loss,
 round(count(*) FILTER (WHERE pnl > 0) / count(*), 9) AS win_rate, round(sum(pnl) FILTER (WHERE pnl > 0) / -sum(pnl) FILTER (WHERE pnl < 0), 9) AS profit_factor, round(avg(pnl) / stddev_samp(pnl) * sqrt(2016), 6) AS sharpe FROM t GROUP BY symbol"""),
    Operator("wn02_drawdown", f"""WITH t AS (SELECT symbol, seq, ts_us, CASE WHEN side = 'A' THEN size ELSE -size END AS pnl FROM {{mbo}} WHERE action = 'F'), e AS (SELECT *, CAST(sum(pnl) {_ROWS} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS equity FROM t)
 SELECT symbol, seq, equity, greatest(max(equity) {_ROWS} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) - equity AS drawdown FROM e"""),
    Operator("wn05_time_groups", "SELECT symbol, seq, CAST(ntile(5) OVER (PARTITION BY symbol ORDER BY ts_us, seq) AS BIGINT) AS fold FROM {mbo}"),
    # Groups are counted first; the pairs are of a handful of groups, not of rows.
    Operator("cv01_folds", """WITH g AS (SELECT symbol, seq, ntile(5) OVER (PARTITION BY symbol ORDER BY ts_us, seq) AS grp FROM {mbo}), n AS (SELECT symbol, grp, count(*) AS k FROM g GROUP BY symbol, grp), s AS (SELECT symbol, CAST(sum(k) AS BIGINT) AS every FROM n GROUP BY symbol)
 SELECT a.symbol, CAST(a.grp AS BIGINT) AS x, CAST(b.grp AS BIGINT) AS y, a.k + b.k AS test_rows, every - a.k - b.k AS train_rows FROM n a JOIN n b ON a.symbol = b.symbol AND a.grp < b.grp JOIN s ON a.symbol = s.symbol"""),
    Operator("wn06_rank_quartiles", "SELECT symbol, seq, CAST(floor((row_number() OVER (PARTITION BY symbol ORDER BY price, seq) - 1) * 4 / count(*) OVER (PARTITION BY symbol)) AS BIGINT) AS quartile FROM {mbo}"),
    Operator("wn07_hit_streak", f"SELECT symbol, seq, avg(CASE WHEN side = 'A' THEN 1.0 ELSE -1.0 END) {_ROWS} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS streak FROM {{mbo}} WHERE action = 'F'"),
    Operator("st01_tumbling", "SELECT symbol, ts_us - ts_us % {g} AS bucket_us, count(*) AS n, max(seq) AS last_seq FROM {mbo} GROUP BY 1, 2", {"g": 100_000}, {"g": 100 * MIN}),
    Operator("st03_horizon_counts", "SELECT symbol, seq, count(*) OVER (PARTITION BY symbol ORDER BY ts_us RANGE BETWEEN CURRENT ROW AND {h} FOLLOWING) AS ahead FROM {mbo}", {"h": 2_000_000}, {"h": 2000 * MIN}),
    Operator("st04_burst_rows", f"SELECT symbol, seq, n FROM (SELECT symbol, seq, count(*) {_last('{w}')} AS n FROM {{mbo}}) c WHERE n >= {{least}}", {"w": 100_000, "least": 5}, {"w": 100 * MIN}),
    Operator("nb13_lead_label", "SELECT symbol, seq, (min(CASE WHEN action = 'C' AND size >= 80 THEN ts_us END) OVER (PARTITION BY symbol ORDER BY ts_us RANGE BETWEEN 1 FOLLOWING AND {h} FOLLOWING)) IS NOT NULL AS ahead FROM {mbo}", {"h": 30_000_000}, {"h": 600 * MIN}),
    Operator("st16_outcome_tracker", f"WITH f AS (SELECT symbol, seq, mid, first_value(mid) OVER (PARTITION BY symbol ORDER BY ts_us RANGE BETWEEN {{h}} FOLLOWING AND UNBOUNDED FOLLOWING) AS leave FROM {{quotes}}) SELECT symbol, seq, mid AS entry, leave, leave - mid > 0.125 AS hit FROM f WHERE leave IS NOT NULL", {"h": 60_000_000}, {"h": 60 * MIN}),
    Operator("sv01_signal_pnl", f"WITH s AS (SELECT symbol, seq, ts_us, mid - lag(mid) {_ROWS}) AS dm, lag(CASE WHEN bid_size > ask_size THEN 1 ELSE -1 END) {_ROWS}) AS held FROM {{quotes}}) SELECT symbol, sum(dm * held) AS pnl, round(avg(dm * held) / stddev_samp(dm * held) * sqrt(count(dm)), 6) AS sharpe, round(count(*) FILTER (WHERE dm * held > 0) / count(dm), 9) AS hit_rate FROM s GROUP BY symbol"),
    Operator("rg01_regime", "SELECT symbol, seq, CASE WHEN (ask - bid) > 0.9 THEN 'VOLATILE' WHEN abs(bid_size - ask_size) / (bid_size + ask_size) > 0.6 THEN 'TRENDING' WHEN abs(bid_size - ask_size) / (bid_size + ask_size) < 0.35 THEN 'RANGING' ELSE 'NEUTRAL' END AS regime FROM {quotes}"),
    Operator("ex05_cost_model", "SELECT symbol, seq, round((ask - bid) / 2 * size_lots + 2.04 + {adverse} * 0.25, 6) AS cost FROM (SELECT *, bid_size % 5 + 1 AS size_lots FROM {quotes}) q", {"adverse": 1}),
]
