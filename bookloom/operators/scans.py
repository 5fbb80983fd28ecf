"""Event queries, candles, lifecycles, session forensics (ids of the survey in the names)."""

from bookloom.operators.sql import Operator

MS, MIN = 1000, 60_000_000  # microseconds; on the driver's tables a minute stands for a millisecond
_PAIRS = """adds AS (SELECT order_id, side, price, size, ts_us FROM {mbo} WHERE action = 'A' AND size >= {least}),
 cancels AS (SELECT order_id, ts_us AS end_us FROM {mbo} WHERE action = 'C'),
 pairs AS (SELECT a.*, c.end_us, c.end_us - a.ts_us AS dt FROM adds a JOIN cancels c ON a.order_id = c.order_id)"""
_PULL = "WITH " + _PAIRS + """, hit AS (SELECT *, round(price / {bucket}) * {bucket} AS zone FROM pairs WHERE dt > 0 AND dt < {most}),
 zones AS (SELECT zone, side, count(*) AS n, min(ts_us) AS first_us, max(ts_us) AS last_us, max(size) AS most_size FROM hit GROUP BY zone, side)"""
_PULLED = "SELECT zone, side, n, first_us, last_us, most_size, least(greatest(n / 20.0, 0.2), 0.95) AS confidence FROM zones WHERE n >= {count}"
_PHANTOM = "WITH " + _PAIRS + """, hit AS (SELECT *, round(price / {bucket}) * {bucket} AS zone FROM pairs WHERE dt >= {from} AND dt <= {most})"""
_ICEBERG = """SELECT round(price / {bucket}) * {bucket} AS zone, side, count(*) AS n, CAST(sum(size) AS BIGINT) AS total, avg(size) AS mean_size,
 least(greatest((sum(size) / 100.0) * (count(*) / 10.0), 0.3), 0.95) AS confidence FROM {mbo} WHERE action IN ('F', 'T')
 GROUP BY 1, side HAVING count(*) >= {count} AND avg(size) < {mean} AND sum(size) >= {total}"""
_LADDER = """ladder AS (SELECT round(price / {bucket}) * {bucket} AS zone, side, ts_us - ts_us % {window} AS win, count(*) AS n, sum(size) AS total, max(size) AS most,
   max(size) / greatest(sum(size), 1) AS conc FROM {mbo} WHERE action = 'A' AND size > 0 GROUP BY 1, 2, 3),
 states AS (SELECT *, CASE WHEN conc > 0.5 OR n <= 2 THEN 'FRAGILE' WHEN conc < 0.3 AND n >= 5 THEN 'SOLID' ELSE 'NEUTRAL' END AS state FROM ladder),
 levels AS (SELECT zone, side, count(*) AS windows, count(*) FILTER (WHERE state = 'FRAGILE') AS fragile, count(*) FILTER (WHERE state = 'SOLID') AS solid,
   round(avg(total), 6) AS mean_volume, round(avg(n), 6) AS mean_orders FROM states GROUP BY zone, side)"""
_P, _PS = {"least": 3, "most": 150 * MS, "bucket": 0.25, "count": 2}, {"most": 150 * MIN, "bucket": 5.0}
_W, _WS = {"least": 50, "from": 100 * MS, "most": 500 * MS, "bucket": 0.25}, {"from": 100 * MIN, "most": 500 * MIN, "bucket": 5.0}
_I, _IS = {"bucket": 0.25, "count": 4, "mean": 8, "total": 30}, {"bucket": 5.0, "mean": 60}
_L, _LS = {"bucket": 0.25, "window": 500 * MS}, {"bucket": 5.0, "window": 1440 * MIN}

OPERATORS = [
    Operator("agg01_candles", """SELECT symbol, ts_us - ts_us % {step} AS bucket_us, min_by(price, ORD) AS open, max(price) AS high, min(price) AS low, max_by(price, ORD) AS close,
 CAST(sum(size) AS BIGINT) AS volume FROM {mbo} WHERE action IN ('F', 'T') AND price > 0 GROUP BY symbol, ts_us - ts_us % {step}""", {"step": 60_000_000}, {"step": 3_600_000_000}),
    Operator("agg02_session_stats", """SELECT symbol, count(*) AS events, count(*) FILTER (WHERE action = 'A') AS adds, count(*) FILTER (WHERE action = 'C') AS cancels, count(*) FILTER (WHERE action = 'M') AS modifies,
 count(*) FILTER (WHERE action IN ('F', 'T')) AS fills, min(ts_us) AS first_us, max(ts_us) AS last_us, min_by(price, ORD) FILTER (WHERE action IN ('F', 'T')) AS open,
 max_by(price, ORD) FILTER (WHERE action IN ('F', 'T')) AS close, max(price) FILTER (WHERE action IN ('F', 'T')) AS high, min(price) FILTER (WHERE action IN ('F', 'T')) AS low,
 CAST(coalesce(sum(size) FILTER (WHERE action IN ('F', 'T')), 0) AS BIGINT) AS volume FROM {mbo} GROUP BY symbol"""),
    Operator("agg03_by_action", """SELECT CASE action WHEN 'A' THEN 'ADD' WHEN 'C' THEN 'CANCEL' WHEN 'M' THEN 'MODIFY' ELSE 'FILL' END AS label, count(*) AS n, CAST(sum(size) AS BIGINT) AS total_size,
 round(avg(size), 2) AS mean_size, round(avg(price), 4) AS mean_price FROM {mbo} GROUP BY 1"""),
    Operator("agg05_tape_summary", """SELECT symbol, ts_us - ts_us % {step} AS bucket_us, CAST(coalesce(sum(size) FILTER (WHERE fill AND side = 'A'), 0) AS BIGINT) AS buy_volume,
 CAST(coalesce(sum(size) FILTER (WHERE fill AND side = 'B'), 0) AS BIGINT) AS sell_volume, CAST(coalesce(sum(CASE WHEN side = 'A' THEN size ELSE -size END) FILTER (WHERE fill), 0) AS BIGINT) AS delta,
 max(size) FILTER (WHERE fill) AS largest_size, count(*) FILTER (WHERE action = 'C' AND side = 'B') AS bid_cancels, count(*) FILTER (WHERE action = 'C' AND side = 'A') AS ask_cancels
 FROM (SELECT *, action IN ('F', 'T') AS fill FROM {mbo}) e GROUP BY symbol, ts_us - ts_us % {step}""", {"step": 60_000_000}, {"step": 14_400_000_000}),
    Operator("flt01_event_query", """SELECT seq, ts_us, order_id, action, side, price, size, count(*) OVER () AS total FROM {mbo} WHERE action IN ('A', 'C') AND side = 'B' AND price >= {low} AND price <= {high}
 AND size >= {least} AND size <= {most} ORDER BY ts_us, seq LIMIT {limit} OFFSET {skip}""", {"low": 0, "high": 1000000, "least": 0, "most": 1000000, "limit": 50000, "skip": 0}, {"low": 5, "high": 80, "least": 10, "limit": 500, "skip": 20}),
    Operator("flt03_fills", "SELECT seq, symbol, price, size, ts_us * 1000 AS ts_ns, (ts_us - ts_us % 1000000) / 1000000 AS ts_sec FROM {mbo} WHERE action IN ('F', 'T') AND price > 0"),
    Operator("flt06_rth_utc", "SELECT seq, symbol, ts_us, price FROM {mbo} WHERE ts_us % 86400000000 >= 48600000000 AND ts_us % 86400000000 < 72000000000"),
    Operator("src16_extract_range", """SELECT action, count(*) AS n, min(ts_us) AS first_us, max(ts_us) AS last_us FROM {mbo} WHERE ts_us >= (SELECT min(ts_us) FROM {mbo}) + {from} AND ts_us <= (SELECT min(ts_us) FROM {mbo}) + {to}
 GROUP BY action""", {"from": 0, "to": 86_400_000_000}, {"from": 86_400_000_000, "to": 864_000_000_000}),
    Operator("bk02_lifecycles", """SELECT order_id, count(*) AS events, min(ts_us) AS first_us, max(ts_us) AS last_us, max(ts_us) - min(ts_us) AS duration_us, min_by(action, ORD) AS first_action,
 max_by(action, ORD) AS last_action, min_by(price, ORD) AS first_price, max_by(size, ORD) AS last_size FROM {mbo} GROUP BY order_id"""),
    Operator("jn01_add_cancel", "WITH " + _PAIRS + " SELECT order_id, side, price, size, ts_us, end_us, dt FROM pairs WHERE dt > 0 AND dt < {most}", {"least": 3, "most": 150 * MS}, {"most": 150 * MIN}),
    Operator("jn02_large_add_cancel", "WITH " + _PAIRS + " SELECT order_id, side, price, size, ts_us, end_us, dt FROM pairs WHERE dt >= {from} AND dt <= {most}", {"least": 50, "from": 100 * MS, "most": 500 * MS}, {"from": 100 * MIN, "most": 500 * MIN}),
    Operator("jn03_sequential_match", """WITH e AS (SELECT *, max(CASE WHEN action = 'A' THEN ts_us END) OVER (PARTITION BY order_id ORDER BY ts_us, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS add_us FROM {mbo})
 SELECT order_id, seq, ts_us, add_us, ts_us - add_us AS dt FROM e WHERE action = 'C' AND add_us IS NOT NULL AND ts_us - add_us <= {most}""", {"most": 150 * MS}, {"most": 500 * MIN}),
    Operator("agg06_pull_zones", _PULL + " " + _PULLED, _P, _PS),
    Operator("agg07_layering_zones", """WITH adds AS (SELECT side, CAST(floor(size) AS BIGINT) AS s, ts_us - ts_us % {window} AS win, count(*) AS n, count(DISTINCT price) AS levels, avg(price) AS mean_price FROM {mbo} WHERE action = 'A' AND size >= 2 GROUP BY 1, 2, 3),
 hit AS (SELECT *, least(greatest(n / 10.0, 0.3), 0.95) AS conf FROM adds WHERE n >= {count} AND levels >= {count})
 SELECT round(mean_price / {bucket}) * {bucket} AS zone, side, max(conf) AS confidence, CAST(sum(n) AS BIGINT) AS n FROM hit GROUP BY 1, 2""", {"window": 300 * MS, "count": 3, "bucket": 0.25}, {"window": 43_200 * MIN, "count": 2, "bucket": 5.0}),
    Operator("agg08_iceberg_zones", _ICEBERG, _I, _IS),
    Operator("agg09_phantom_zones", _PHANTOM + " SELECT zone, side, count(*) AS n, min(ts_us) AS first_us, max(size) AS most_size, least(greatest(count(*) / 5.0, 0.3), 0.95) AS confidence FROM hit GROUP BY zone, side", _W, _WS),
    Operator("agg10_fragility_ladder", "WITH " + _LADDER + " SELECT * FROM levels", _L, _LS),
    Operator("agg11_authenticity", _PULL + """, wide AS (SELECT round(zone / 10.0) * 10.0 AS area, first_us - first_us % {slot} AS slot_us, CAST(sum(n) AS BIGINT) AS n, max(least(greatest(n / 20.0, 0.2), 0.95)) AS conf FROM zones GROUP BY 1, 2),
 scored AS (SELECT *, least(greatest(1 - n / max(n) OVER () * conf, 0), 1) AS authenticity FROM wide)
 SELECT area, count(*) AS slots, CAST(sum(n) AS BIGINT) AS total, round(avg(authenticity), 9) AS mean_authenticity, count(*) FILTER (WHERE authenticity < 0.4) AS low FROM scored WHERE n >= {count} GROUP BY area""", {**_P, "slot": 1_800_000_000}, {**_PS, "slot": 86_400_000_000, "count": 1}),
    Operator("set01_spoof_union", _PULL + ", pulled AS (" + _PULLED + "), ice AS (" + _ICEBERG.replace("{count}", "4") + """) SELECT 'pull' AS kind, zone, side, n, confidence FROM pulled UNION ALL SELECT 'iceberg', zone, side, n, confidence FROM ice""", {**_P, "mean": 8, "total": 30}, {**_PS, "mean": 60}),
    Operator("jn05_fragile_spoofed", _PULL + ", " + _LADDER + " SELECT l.zone, l.side, l.fragile, l.mean_volume FROM levels l LEFT SEMI JOIN zones z ON l.zone = z.zone AND l.side = z.side WHERE l.fragile > 0".replace("LEFT SEMI", "SEMI"), {**_P, **_L}, {**_PS, **_LS}),
    Operator("tk03_top_zones", _PULL + " " + _PULLED + " ORDER BY n DESC, zone, side LIMIT 15", _P, _PS),
    Operator("tk04_nearest_levels", "WITH " + _LADDER + """, last AS (SELECT max_by(price, ORD) AS close FROM {mbo} WHERE action IN ('F', 'T')),
 near AS (SELECT zone, side, fragile, solid, abs(zone - close) AS away, row_number() OVER (PARTITION BY side ORDER BY abs(zone - close), zone) AS place FROM levels CROSS JOIN last) SELECT * FROM near WHERE place <= 10""", _L, _LS),
    Operator("agg12_level_bucketing", "SELECT symbol, side, floor(price / {step}) * {step} AS level, CAST(sum(size) AS BIGINT) AS volume, count(*) AS orders FROM {mbo} WHERE action = 'A' GROUP BY 1, 2, 3", {"step": 0.25}, {"step": 2.5}),
    Operator("agg13_header_stats", """SELECT symbol, CAST(sum(CASE WHEN action IN ('F', 'T') THEN CASE WHEN side = 'A' THEN size ELSE -size END ELSE 0 END) AS BIGINT) AS cvd,
 round(count(*) FILTER (WHERE action IN ('F', 'T')) / greatest((max(ts_us) - min(ts_us)) / 1000000, 1), 9) AS trades_per_s, count(DISTINCT order_id) AS orders FROM {mbo} GROUP BY symbol"""),
    Operator("agg14_side_imbalance", """SELECT symbol, b, a, CASE WHEN b + a = 0 THEN 0.0 ELSE (b - a) / (b + a) END AS imbalance FROM (SELECT symbol, CAST(sum(CASE WHEN side = 'B' THEN size ELSE 0 END) AS BIGINT) AS b,
 CAST(sum(CASE WHEN side = 'A' THEN size ELSE 0 END) AS BIGINT) AS a FROM {mbo} WHERE action = 'A' GROUP BY symbol) s"""),
    Operator("agg16_institutional", """SELECT symbol, side, round(sum(CASE WHEN size >= {large} THEN size ELSE 0 END) / sum(size), 9) AS institutional, round(sum(CASE WHEN size <= 5 THEN size ELSE 0 END) / sum(size), 9) AS retail
 FROM {mbo} WHERE action = 'A' GROUP BY symbol, side""", {"large": 50}),
    Operator("wn01_cumulative_depth", """WITH lv AS (SELECT symbol, side, price, CAST(sum(size) AS BIGINT) AS v FROM {mbo} WHERE action = 'A' GROUP BY 1, 2, 3)
 SELECT symbol, side, price, v, CAST(sum(v) OVER (PARTITION BY symbol, side ORDER BY price ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS depth, v / max(v) OVER (PARTITION BY symbol, side) AS bar FROM lv"""),
    Operator("bk01_order_intervals", """WITH e AS (SELECT *, lead(ts_us) OVER (PARTITION BY symbol, order_id ORDER BY ts_us, seq) AS next_us, max(CASE WHEN action = 'A' THEN 1 ELSE 0 END) OVER (PARTITION BY symbol, order_id ORDER BY ts_us, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS known FROM {mbo})
 SELECT symbol, order_id, seq, side, price, size, ts_us AS from_us, next_us AS to_us FROM e WHERE action = 'A' OR (action = 'M' AND known = 1)"""),
    Operator("pr02_aggressive_adds", "SELECT m.symbol, m.side, count(*) AS n, CAST(sum(m.size) AS BIGINT) AS volume FROM {mbo} m JOIN {quotes} q ON m.seq = q.seq AND m.symbol = q.symbol WHERE m.action = 'A' AND ((m.side = 'B' AND m.price >= q.ask - 0.25) OR (m.side = 'A' AND m.price <= q.bid + 0.25)) GROUP BY 1, 2"),
    Operator("sv02_session_recurrence", """WITH z AS (SELECT DISTINCT ts_us - ts_us % 86400000000 AS day_us, round(price / {bucket}) * {bucket} AS zone FROM {mbo} WHERE action = 'C' AND size >= 50)
 SELECT zone, count(*) AS days FROM z GROUP BY zone HAVING count(*) >= 2 ORDER BY days DESC, zone LIMIT 10""", {"bucket": 0.25}, {"bucket": 5.0}),
    Operator("sv03_nearest_seek", "SELECT symbol, min_by(seq, abs(ts_us - t)) AS seq, min(abs(ts_us - t)) AS away FROM {mbo} CROSS JOIN (SELECT min(ts_us) + {at} AS t FROM {mbo}) x GROUP BY symbol", {"at": 3_600_000_000}),
    # Local hours by one offset from UTC, as day 0 of the epoch was a Thursday; Monday is 0.
    Operator("flt05_rth_local", """WITH l AS (SELECT seq, symbol, ts_us, price, ts_us + {offset} AS local_us FROM {mbo}), d AS (SELECT *, local_us % 86400000000 AS day_us, CAST(((local_us - local_us % 86400000000) / 86400000000 + 3) % 7 AS BIGINT) AS weekday FROM l)
 SELECT seq, symbol, ts_us, price, weekday FROM d WHERE weekday < 5 AND day_us >= 34200000000 AND day_us < 57600000000""", {"offset": -18_000_000_000}),
    # The trades of each bucket of two timeframes in order: a row for each, so that a bucket has no bound.
    Operator("agg04_tick_index", """WITH t AS (SELECT symbol, seq, ts_us, price FROM {mbo} WHERE action IN ('F', 'T')), b AS (SELECT *, {short} AS frame_us, ts_us - ts_us % {short} AS bucket_us FROM t UNION ALL SELECT *, {long} AS frame_us, ts_us - ts_us % {long} AS bucket_us FROM t)
 SELECT symbol, frame_us, bucket_us, seq, price, CAST(row_number() OVER (PARTITION BY symbol, frame_us, bucket_us ORDER BY ts_us, seq) AS BIGINT) AS place FROM b""", {"short": 60_000_000, "long": 300_000_000}, {"short": 3_600_000_000, "long": 86_400_000_000}),
    Operator("agg26_level_sessions", """WITH v AS (SELECT symbol, ts_us - ts_us % 86400000000 AS day_us, round(price / {bucket}) * {bucket} AS level, CAST(sum(size) AS BIGINT) AS volume FROM {mbo} GROUP BY 1, 2, 3), l AS (SELECT symbol, level, count(*) AS sessions, CAST(sum(volume) AS BIGINT) AS volume FROM v WHERE volume >= {least} GROUP BY 1, 2)
 SELECT symbol, sessions, count(*) AS levels, CAST(sum(volume) AS BIGINT) AS volume FROM l GROUP BY symbol, sessions""", {"bucket": 0.25, "least": 100}, {"bucket": 5.0}),
    Operator("tk06_top_matches", "SELECT symbol, call_us, seq, score, place FROM (SELECT symbol, ts_us - ts_us % {call} AS call_us, seq, size AS score, CAST(row_number() OVER (PARTITION BY symbol, ts_us - ts_us % {call} ORDER BY size DESC, seq) AS BIGINT) AS place FROM {mbo} WHERE size >= {least}) x WHERE place <= {most}", {"call": 60_000_000, "least": 50, "most": 20}, {"call": 86_400_000_000}),
    Operator("src15_range_read", "SELECT symbol, seq, ts_us, bid, ask, mid FROM {quotes} WHERE ts_us >= (SELECT min(ts_us) FROM {mbo}) + {from} AND ts_us <= (SELECT min(ts_us) FROM {mbo}) + {to} ORDER BY ts_us, seq LIMIT {most}", {"from": 0, "to": 86_400_000_000, "most": 5000}),
    Operator("set06_distinct", "SELECT DISTINCT symbol, action, side FROM {mbo}"),
]
