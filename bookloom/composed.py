"""Queries of operators that take a caller's tables, made here from the driver's, and their oracles, which state the rows in another form."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bookloom.operators import adapter, book, cascades, engine, fragility, rolling, times, validation
from bookloom.operators.frames import OPERATORS as FRAMES
from bookloom.operators.frames import match_outcomes
from bookloom.sources import library, replay
from bookloom.sources import mbo as source
from bookloom.streaming import folds
from bookloom.tables import scratch_path, written

MIN, DAY = 60_000_000, 86_400_000_000
GRID = 600 * MIN
MBO = f"mbo AS ({source.DUCKDB['mbo']})"
QUOTES = f"{MBO}, quotes AS ({source.DUCKDB['quotes']})"


def _mbo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source.read(spark, sf_dir)


def _quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source.quotes(spark, source.read(spark, sf_dir))


# -- the book, what is added at its best, and fragility

WINDOW, FAST, SLOW = 1200 * MIN, 600 * MIN, 3000 * MIN
SCALES = {"fall": 1e-3, "churn": 5e-4, "refresh": 1e-4, "wide": 4.0}


def bk01_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    return book.book(_mbo(spark, sf_dir), GRID)


def src07_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The book written as a CSV file of levels, and replayed from it."""
    path = scratch_path(spark, "levels.csv")
    levels = bk01_book(spark, sf_dir).select("symbol", (F.col("snap") / 1000).alias("timestamp"), "side", "price", "volume", F.col("n_orders").alias("order_count"))
    levels.write.option("header", True).csv(path)
    placed = replay.positions(replay.snapshots(replay.read_levels(spark, path)), 100 * GRID // 1000)
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x["volume"])
    return placed.select("symbol", "timestamp", "position", F.size("bids").alias("n_bids"), F.size("asks").alias("n_asks"), F.get("bids", F.lit(0))["price"].alias("bid"), F.get("asks", F.lit(0))["price"].alias("ask"), total("bids").alias("bid_volume"), total("asks").alias("ask_volume"))


def _adds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adds at the best of the book of the grid time that shows them first, or of the one before."""
    mbo = _mbo(spark, sf_dir)
    rows = mbo.withColumns({"snap": F.ceil(F.col("ts_us") / GRID) * GRID, "aggressive": F.lit(False)})
    return adapter.passive_adds(book.best_quotes(book.book(mbo, GRID)), rows, block=100 * GRID)


_ADDS = f"""{QUOTES}, book AS ({book.sql(GRID)}), q AS (SELECT symbol, snap, coalesce(max(price) FILTER (side = 'B'), 0) AS bid, coalesce(min(price) FILTER (side = 'A'), 0) AS ask FROM book GROUP BY 1, 2),
 l AS (SELECT *, lag(bid, 1, bid) OVER w AS bid0, lag(ask, 1, ask) OVER w AS ask0 FROM q WINDOW w AS (PARTITION BY symbol ORDER BY snap)), e AS (SELECT * FROM mbo WHERE action = 'A' QUALIFY row_number() OVER (PARTITION BY symbol, order_id, ts_us ORDER BY seq) = 1),
 adds AS (SELECT e.symbol, e.ts_us, e.side FROM e JOIN l ON e.symbol = l.symbol AND CAST(ceil(e.ts_us / {GRID}) AS BIGINT) * {GRID} = l.snap WHERE side = 'B' AND abs(price - greatest(bid, bid0)) < 125e-3 OR side = 'A' AND abs(price - least(ask, ask0)) < 125e-3),
 rates AS (SELECT q.symbol, q.seq, count(*) FILTER (a.side = 'B') / ({WINDOW} / 1e6) AS bid_rate, count(*) FILTER (a.side = 'A') / ({WINDOW} / 1e6) AS ask_rate FROM quotes q LEFT JOIN adds a ON a.symbol = q.symbol AND a.ts_us BETWEEN q.ts_us - {WINDOW} AND q.ts_us GROUP BY 1, 2)"""


def l1_refresh_at_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fragility.refresh_rates(_quotes(spark, sf_dir), _adds(spark, sf_dir), WINDOW)


def fe15_fragility_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    quotes = _quotes(spark, sf_dir)
    vpin = FRAMES["fe02_vpin"](_mbo(spark, sf_dir), quotes, bucket=500, last=10).groupBy("symbol", F.col("end_us").alias("at_us")).agg(F.max_by("vpin", "bucket").alias("vpin"))
    return fragility.fragility(quotes, _adds(spark, sf_dir), vpin, None, 0.25, FAST, SLOW, WINDOW, **SCALES)


_WAS = "(SELECT max_by(depth, row(ts_us, seq)) FROM d b WHERE b.symbol = d.symbol AND b.ts_us <= d.ts_us - {w})"
_FE15 = f"""WITH {_ADDS}, d AS (SELECT symbol, seq, ts_us, CAST(bid_size + ask_size AS DOUBLE) AS depth, (ask - bid) / 25e-2 AS ticks FROM quotes),
 w AS (SELECT symbol, seq, ticks, max_by(depth, row(ts_us, seq)) OVER (PARTITION BY symbol ORDER BY ts_us RANGE BETWEEN UNBOUNDED PRECEDING AND {FAST} PRECEDING) AS was5, max_by(depth, row(ts_us, seq)) OVER (PARTITION BY symbol ORDER BY ts_us RANGE BETWEEN UNBOUNDED PRECEDING AND {SLOW} PRECEDING) AS was30, depth, ts_us FROM d),
 t AS (SELECT symbol, ts_us, seq, side, size, sum(size) OVER (PARTITION BY symbol ORDER BY ts_us, seq ROWS UNBOUNDED PRECEDING) AS stop FROM mbo WHERE action IN ('F', 'T')),
 u AS (SELECT symbol, ts_us, side, b, least(stop, (b + 1) * 500) - greatest(stop - size, b * 500) AS v FROM (SELECT *, unnest(range(CAST(floor((stop - size) / 500) AS BIGINT), CAST(ceil(stop / 500) AS BIGINT))) AS b FROM t)),
 g AS (SELECT symbol, b, max(ts_us) AS end_us, sum(v) AS total, coalesce(sum(v) FILTER (side = 'A'), 0) AS buy FROM u GROUP BY 1, 2 HAVING sum(v) >= 500),
 v AS (SELECT symbol, b, end_us, CASE WHEN count(*) OVER x = 10 THEN round(avg(abs(2 * buy - total) / total) OVER x, 9) END AS vpin FROM g WINDOW x AS (PARTITION BY symbol ORDER BY b ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)),
 k AS (SELECT symbol, end_us, max_by(vpin, b) AS vpin FROM v GROUP BY 1, 2),
 p AS (SELECT w.symbol, w.seq, least(1e0, greatest(0e0, -coalesce((depth - was5) / ({FAST} / 1e6), 0e0) / {SCALES['fall']:e})) AS "DF", least(1e0, abs(coalesce((depth - was30) / ({SLOW} / 1e6), 0e0)) / {SCALES['churn']:e}) AS "CF", least(1e0, (bid_rate + ask_rate) / {SCALES['refresh']:e}) AS "RF",
   least(1e0, greatest(0e0, (ticks - 1) / 4e0)) AS "SF", coalesce(k.vpin, 0e0) AS "FT", 0e0 AS "CIS" FROM w JOIN rates r ON w.symbol = r.symbol AND w.seq = r.seq ASOF LEFT JOIN k ON w.symbol = k.symbol AND w.ts_us >= k.end_us),
 f AS (SELECT *, round(35e-2 * "RF" + 35e-2 * "SF" + 3e-1 * "FT", 9) AS fi_fast, round(2e-1 * "DF" + 15e-2 * "CF" + 2e-1 * "RF" + 15e-2 * "SF" + 15e-2 * "FT" + 15e-2 * "CIS", 9) AS fi_full FROM p)
 SELECT *, CASE WHEN fi_fast > 6e-1 THEN 4e-1 ELSE 55e-2 END AS signal_threshold, CASE WHEN fi_full > 7e-1 THEN 5e-1 ELSE 1e0 END AS size_multiplier FROM f"""


# -- cascades: states are what an hour's events show

HOUR = 60 * MIN
STATES = f"""SELECT symbol, ts_us, seq, CASE WHEN fills >= 2 AND buy > 2 * sell THEN 'BULL_STREAK' WHEN fills >= 2 AND sell > 2 * buy THEN 'BEAR_STREAK' WHEN cancels >= 1 THEN CASE WHEN buy >= sell THEN 'BULL_STALL' ELSE 'BEAR_STALL' END ELSE 'BALANCED' END AS state,
 fills AS streak_length, levels / 1e0 AS streak_velocity, abs(buy - sell) / (buy + sell + 1e0) * 2 AS pressure_acceleration, cancels AS stall_count, cancels / (fills + 1e0) AS streak_exhaustion FROM
 (SELECT symbol, ts_us - ts_us % {HOUR} AS ts_us, min(seq) AS seq, count(*) FILTER (WHERE action IN ('F', 'T')) AS fills, count(*) FILTER (WHERE action = 'C') AS cancels, count(DISTINCT CASE WHEN action IN ('F', 'T') THEN price END) AS levels,
  sum(CASE WHEN action IN ('F', 'T') AND side = 'A' THEN size ELSE 0 END) AS buy, sum(CASE WHEN action IN ('F', 'T') AND side = 'B' THEN size ELSE 0 END) AS sell FROM {{mbo}} GROUP BY 1, 2) s"""
IGNITION = {"least_length": 2, "least_velocity": 2.0, "least_acceleration": 1.0, "gap_us": 24 * HOUR}
WITHDRAWAL = {"least_us": HOUR, "least_count": 1, "most_acceleration": 1.5, "least_exhaustion": 0.5, "gap_us": 12 * HOUR}
CLUSTER = {"window_us": 30 * MIN, "gap_us": 5 * HOUR}


def _states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(STATES, mbo=_mbo(spark, sf_dir))


def cs02_ignitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cascades.ignitions(_states(spark, sf_dir), block_us=30 * HOUR, **IGNITION).withColumn("confidence", F.round("confidence", 9))


def cs01_withdrawals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cascades.withdrawals(_states(spark, sf_dir), block_us=30 * HOUR, **WITHDRAWAL).withColumn("confidence", F.round("confidence", 9))


def _walk(states: str, ready: str, confidence: str, gap: int) -> str:
    """A recursive walk over what is ready, and where its run of states began."""
    return f"""WITH RECURSIVE {MBO}, s AS ({STATES.replace('{mbo}', 'mbo')}), r AS (SELECT *, state IN {states} AS inside, count(*) FILTER (state NOT IN {states}) OVER (PARTITION BY symbol ORDER BY ts_us, seq ROWS UNBOUNDED PRECEDING) AS run FROM s),
 c AS (SELECT *, min(ts_us) FILTER (inside) OVER (PARTITION BY symbol, run) AS anchor_us FROM r), f AS (SELECT * FROM c WHERE inside AND {ready}),
 w AS (SELECT symbol, min({{'t': ts_us, 's': seq}}) AS k FROM f GROUP BY symbol UNION ALL SELECT symbol, (SELECT min({{'t': f.ts_us, 's': f.seq}}) FROM f WHERE f.symbol = w.symbol AND f.ts_us >= w.k.t + {gap}) FROM w WHERE k IS NOT NULL)
 SELECT f.symbol, f.seq, anchor_us, f.ts_us AS end_us, round(least(1e0, {confidence}), 9) AS confidence FROM f JOIN w ON f.symbol = w.symbol AND f.seq = w.k.s"""


def cs04_contagion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Large cancels of five symbols; pairs are coherent where their symbols trade at one price level in ten or more."""
    mbo = _mbo(spark, sf_dir)
    levels = mbo.where("action IN ('F', 'T')").select("symbol", "price").distinct()
    shared = levels.alias("a").join(levels.alias("b"), (F.col("a.price") == F.col("b.price")) & (F.col("a.symbol") < F.col("b.symbol"))).groupBy(F.col("a.symbol").alias("a"), F.col("b.symbol").alias("b")).agg((F.count(F.lit(1)) / 100).alias("value"))
    found = cascades.contagion(mbo.where("action = 'C' AND size >= 50").select("symbol", "ts_us", "seq"), shared, None, **CLUSTER, least_coherence=0.2)
    return found.withColumns({"symbols": F.array_join("symbols", ","), "confidence": F.round("confidence", 9)})


_CS04 = f"""WITH RECURSIVE {MBO}, e AS (SELECT symbol, ts_us, seq FROM mbo WHERE action = 'C' AND size >= 50), lv AS (SELECT DISTINCT symbol, price FROM mbo WHERE action IN ('F', 'T')), g AS (SELECT a.symbol AS a, b.symbol AS b FROM lv a JOIN lv b ON a.price = b.price AND a.symbol <> b.symbol GROUP BY 1, 2 HAVING count(*) / 100 >= 2e-1),
 f AS (SELECT x.symbol, x.seq, x.ts_us, max(y.ts_us) AS end_us, count(DISTINCT y.symbol) + 1 AS n, list_sort(list_append(list(DISTINCT y.symbol), x.symbol)) AS symbols FROM e x JOIN g ON x.symbol = g.a JOIN e y ON y.symbol = g.b AND y.ts_us - x.ts_us BETWEEN 0 AND {CLUSTER['window_us']} AND row(y.ts_us, y.seq) > row(x.ts_us, x.seq) GROUP BY 1, 2, 3),
 w AS (SELECT min({{'t': ts_us, 's': seq}}) AS k FROM f UNION ALL SELECT (SELECT min({{'t': f.ts_us, 's': f.seq}}) FROM f WHERE f.ts_us >= w.k.t + {CLUSTER['gap_us']}) FROM w WHERE k IS NOT NULL)
 SELECT f.symbol, f.seq, f.ts_us AS anchor_us, end_us, array_to_string(symbols, ',') AS symbols, round(least(1e0, 5e-1 + 15e-2 * (n - 2)), 9) AS confidence FROM f JOIN w ON f.seq = w.k.s"""


# -- ordered folds

GAP, HORIZON = 300 * MIN, 600 * MIN


def st11_cusum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.on_table(_quotes(spark, sf_dir), folds.cusum(50.0), DAY)


def st13_throttle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.on_table(_quotes(spark, sf_dir), folds.throttle(GAP)).drop("session")


def st16_match_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every quote of a large order is a match, whose side tells its direction."""
    sides = _mbo(spark, sf_dir).where("size >= 60").selectExpr("symbol", "seq", "seq AS match_id", "CASE side WHEN 'B' THEN 'bull' ELSE 'bear' END AS direction")
    rows = _quotes(spark, sf_dir).join(sides, ["symbol", "seq"], "left")
    return match_outcomes(rows, HORIZON)


_ST13 = f"""WITH RECURSIVE {QUOTES}, f AS (SELECT symbol, ts_us, seq FROM quotes QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts_us, seq) >= 5),
 w AS (SELECT symbol, min({{'t': ts_us, 's': seq}}) AS k FROM f GROUP BY symbol UNION ALL SELECT symbol, (SELECT min({{'t': f.ts_us, 's': f.seq}}) FROM f WHERE f.symbol = w.symbol AND f.ts_us >= w.k.t + {GAP}) FROM w WHERE k IS NOT NULL) SELECT symbol, k.s AS seq, k.t AS ts_us FROM w WHERE k IS NOT NULL"""
_ST16 = f"""WITH {QUOTES}, b AS (SELECT symbol, ts_us, min_by(mid, seq) AS mid FROM quotes GROUP BY 1, 2), m AS (SELECT q.symbol, q.seq, q.ts_us, q.mid, CASE e.side WHEN 'B' THEN 1e0 ELSE -1e0 END AS sign FROM quotes q JOIN mbo e ON q.symbol = e.symbol AND q.seq = e.seq WHERE e.size >= 60)
 SELECT m.symbol, m.seq AS match_id, m.ts_us AS entry_us, b.ts_us AS exit_us, m.mid AS entry, b.mid AS leave, (b.mid - m.mid) * sign AS realized, (b.mid - m.mid) * sign > 125e-3 AS hit FROM m ASOF JOIN b ON m.symbol = b.symbol AND m.ts_us + {HORIZON} <= b.ts_us"""


# -- rolling tiers, signatures, folds of rows

HISTORY, WARMUP = 500, 100


def wn03_rolling_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = _quotes(spark, sf_dir).selectExpr("symbol", "ts_us", "seq", "abs(bid_size - ask_size) / (bid_size + ask_size) AS p")
    return rolling.rolling_tiers(scores, HISTORY, WARMUP)


_WN03 = f"""WITH {QUOTES}, s AS (SELECT symbol, ts_us, seq, abs(bid_size - ask_size) / (bid_size + ask_size) AS p FROM quotes), q AS (SELECT symbol, seq, p, count(*) OVER w AS n, {', '.join(f"quantile_cont(p, {q}) OVER w AS q{i}" for i, (_, q) in enumerate(rolling.TIERS))} FROM s WINDOW w AS (PARTITION BY symbol ORDER BY ts_us, seq ROWS BETWEEN {HISTORY - 1} PRECEDING AND CURRENT ROW))
 SELECT symbol, seq, CASE WHEN n < {WARMUP} THEN NULL {' '.join(f"WHEN p >= q{i} THEN '{t}'" for i, (t, _) in enumerate(rolling.TIERS))} END AS tier FROM q"""


def fe27_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three levels of the path of time, mid and difference of sizes over each session."""
    rows = _quotes(spark, sf_dir).selectExpr("symbol", "ts_us", "seq", "mid", "CAST(bid_size - ask_size AS DOUBLE) AS imbalance")
    made = rolling.signatures(rows, ["mid", "imbalance"], depth=3, block_us=240 * MIN)
    return made.withColumn("signature", F.array_join(F.transform("signature", lambda x: F.format_string("%.6f", F.round(x, 6) + 0.0)), ","))


def _signature_sql() -> str:
    """Running sums over whole sessions, level by level."""
    d = ("t", "m", "i")
    over = "OVER (PARTITION BY symbol, session ORDER BY ts_us, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    one = ", ".join(f"coalesce(sum(d{a}) {over}, 0) AS x{a}" for a in d)
    two = ", ".join(f"x{a} * d{b} AS x{a}{b}" for a in d for b in d)
    run = ", ".join(f"coalesce(sum(x{a}{b}) {over}, 0) AS y{a}{b}" for a in d for b in d)
    sums = ", ".join([*[f"sum(d{a}) AS s{a}" for a in d], *[f"sum(x{a}{b}) AS s{a}{b}" for a in d for b in d], *[f"sum(y{a}{b} * d{c}) AS s{a}{b}{c}" for a in d for b in d for c in d]])
    whole = [*[f"s{a}" for a in d], *[f"(s{a}{b} + s{b}{a}) / 2" for a in d for b in d], *[f"s{a}{b}{c}" for a in d for b in d for c in d]]
    return f"""WITH {QUOTES}, p AS (SELECT symbol, ts_us, seq, ts_us - ts_us % {DAY} AS session, mid, CAST(bid_size - ask_size AS DOUBLE) AS i FROM quotes), c AS (SELECT symbol, session, count(*) AS n FROM p GROUP BY 1, 2),
 d AS (SELECT *, mid - lag(mid) OVER w AS dm, i - lag(i) OVER w AS di FROM p WINDOW w AS (PARTITION BY symbol, session ORDER BY ts_us, seq)), e AS (SELECT d.*, 1 / (n - 1e0) AS dt FROM d JOIN c USING (symbol, session) WHERE dm IS NOT NULL AND n >= 3),
 a AS (SELECT *, {one} FROM e), b AS (SELECT *, {two} FROM a), g AS (SELECT *, {run} FROM b), s AS (SELECT symbol, session, {sums} FROM g GROUP BY 1, 2), v AS (SELECT symbol, session, [{', '.join(whole)}] AS x FROM s),
 z AS (SELECT symbol, session, list_transform(x, lambda y: y / sqrt(list_sum(list_transform(x, lambda q: q * q)))) AS x FROM v)
 SELECT c.symbol, c.session, c.n, array_to_string(list_transform(coalesce(z.x, list_transform(range(39), lambda k: 0e0)), lambda y: printf('%.6f', round(y, 6) + 0e0)), ',') AS signature FROM c LEFT JOIN z ON c.symbol = z.symbol AND c.session = z.session"""


def _large(mbo: DataFrame) -> DataFrame:
    return mbo.where("action = 'C' AND size >= 97").select("symbol", "ts_us")


def cv01_purged_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    mbo = _mbo(spark, sf_dir)
    return validation.folds(mbo, _large(mbo), embargo_days=1)


def cv01_day_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embargo around the largest cancel of each symbol; days of training are scarce."""
    mbo = _mbo(spark, sf_dir)
    events = _large(mbo).groupBy("symbol").agg(F.min("ts_us").alias("ts_us"))
    return validation.folds(mbo, events, embargo_days=2, day_aware=True, least_train_days=15)


_PAIRS = "(SELECT a, b, row_number() OVER (ORDER BY a, b) - 1 AS choice FROM range(5) x(a), range(5) y(b) WHERE a < b)"
_CV01 = f"""WITH {MBO}, e AS (SELECT symbol, ts_us FROM mbo WHERE action = 'C' AND size >= 97), g AS (SELECT symbol, seq, ts_us, ntile(5) OVER (PARTITION BY symbol ORDER BY ts_us, seq) - 1 AS grp FROM mbo),
 n AS (SELECT g.symbol, g.seq, g.grp, count(e.ts_us) > 0 AS near FROM g LEFT JOIN e ON g.symbol = e.symbol AND abs(g.ts_us - e.ts_us) <= {DAY} GROUP BY 1, 2, 3)
 SELECT symbol, CAST(choice AS INT) AS fold, seq, CASE WHEN grp IN (a, b) THEN 'test' WHEN near THEN 'embargoed' ELSE 'train' END AS role FROM n, {_PAIRS} f"""
_CV01_DAYS = f"""WITH {MBO}, e AS (SELECT symbol, min(ts_us) // {DAY} AS day FROM mbo WHERE action = 'C' AND size >= 97 GROUP BY 1), d AS (SELECT symbol, day, row_number() OVER (PARTITION BY symbol ORDER BY day) AS no, ntile(5) OVER (PARTITION BY symbol ORDER BY day) - 1 AS grp FROM (SELECT DISTINCT symbol, ts_us // {DAY} AS day FROM mbo)),
 ev AS (SELECT e.symbol, min(d.no) AS no FROM e JOIN d ON e.symbol = d.symbol AND d.day >= e.day GROUP BY 1), n AS (SELECT d.*, coalesce(abs(d.no - ev.no) <= 2, false) AS near FROM d LEFT JOIN ev ON d.symbol = ev.symbol),
 f AS (SELECT symbol, a, b, row_number() OVER (PARTITION BY symbol ORDER BY choice) - 1 AS fold FROM (SELECT symbol, a, b, choice FROM n, {_PAIRS} c GROUP BY 1, 2, 3, 4 HAVING count(*) FILTER (grp IN (a, b)) >= 1 AND count(*) FILTER (grp NOT IN (a, b) AND NOT near) >= 15))
 SELECT m.symbol, CAST(fold AS INT) AS fold, m.seq, CASE WHEN grp IN (a, b) THEN 'test' WHEN near THEN 'embargoed' ELSE 'train' END AS role FROM mbo m JOIN n ON m.symbol = n.symbol AND m.ts_us // {DAY} = n.day JOIN f ON m.symbol = f.symbol"""


# -- matching against a library, and the library's figures

#: Windows are vectors, patterns the means of their labels; contexts and gates follow from the numbers of both.
_WINDOWS = "vec_id AS window_id, CASE vec_id % 3 WHEN 0 THEN 'ES' WHEN 1 THEN 'NQ' ELSE 'CL' END AS instrument, CAST(vec_id % 45 AS DOUBLE) AS vix, CAST(vec_id * 7 % 1440 AS INT) AS minutes, vec_id % 4 / 2e0 AS volume, CASE vec_id % 4 WHEN 0 THEN 'calm' WHEN 1 THEN 'fragile' END AS fragility, 2e0 AS atr, vec_id % 3 * 1e0 AS slippage_bps"
_PATTERNS = "CASE label % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'high' END AS vix_regime, CAST(label * 100 AS INT) AS minutes, CASE WHEN label = 4 THEN 'calm' END AS fragility, label / 100e0 - 3e-2 AS best_atr, label / 10e0 - 5e-1 AS mean_atr"


def _matching(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("embedding is not null").withColumn("series", F.col("embedding").cast("array<double>"))
    head = F.slice("series", 1, 16)
    windows = vectors.selectExpr("series", "slice(series, 1, 16) AS features", "CASE WHEN vec_id % 10 > 0 THEN slice(series, 1, 16) END AS l1", *source.select_list(_WINDOWS))
    means = vectors.select("label", F.posexplode("series")).groupBy("label", "pos").agg(F.avg("col").alias("m")).groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda x: x["m"]).alias("series"))
    templates = means.selectExpr("concat('p', label) AS pattern_id", "series", "CASE WHEN label < 3 THEN array('ES', 'CL') END AS instruments", "CASE WHEN label = 3 THEN array('low', 'high') END AS regimes", *source.select_list(_PATTERNS)).withColumn("features", head)
    order = lambda ddl: [c.split()[0] for c in ddl.split(", ")]
    return windows.select(order(engine.WINDOWS)), templates.select(order(engine.TEMPLATES))


def jn15_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = engine.match(*_matching(spark, sf_dir))
    return found.select("window_id", "pattern_id", F.round("score", 6).alias("score"), F.round("stage1", 6).alias("stage1"), "regime", "tier", "direction")


def jn15_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine.funnel(*_matching(spark, sf_dir))


_SCORED = f"""WITH v AS (SELECT *, CAST(embedding AS DOUBLE[]) AS series FROM embeddings WHERE embedding IS NOT NULL), f AS (SELECT label, unnest(range(len(series))) AS i, unnest(series) AS x FROM v), c AS (SELECT label, i, avg(x) AS m FROM f GROUP BY 1, 2),
 t AS (SELECT 'p' || label AS pattern_id, label, list(m ORDER BY i) AS series, {_PATTERNS} FROM c GROUP BY label), w AS (SELECT series, {_WINDOWS}, CASE WHEN vec_id % 45 < 15 THEN 'low' WHEN vec_id % 45 < 25 THEN 'normal' WHEN vec_id % 45 < 35 THEN 'elevated' ELSE 'high' END AS regime FROM v),
 g AS (SELECT w.*, t.pattern_id, t.series AS centre, t.vix_regime, t.minutes AS at_minutes, t.mean_atr, (label >= 3 OR instrument IN ('ES', 'CL')) AND (label <> 3 OR regime IN ('low', 'high')) AND (t.fragility IS NULL OR w.fragility IS NULL OR t.fragility = w.fragility) AND (slippage_bps = 0 OR abs(best_atr) * atr >= slippage_bps / 10000 * 200 * 2) AS open_ FROM w, t),
 s AS (SELECT *, CASE WHEN window_id % 10 > 0 THEN (list_cosine_similarity(series[:16], centre[:16]) + 1) / 2 ELSE 1e0 END AS stage1 FROM g),
 r AS (SELECT *, 4e-1 * (list_cosine_similarity(series, centre) + 1) / 2 + 35e-2 / (1 + list_distance(series[:16], centre[:16])) + 25e-2 * (CASE WHEN vix_regime IS NULL OR vix_regime = regime THEN 1e0 ELSE 5e-1 END + exp(-power((at_minutes - minutes) / 90e0, 2)) + greatest(0, 1 - abs(volume - 1) / 2)) / 3 AS score FROM s)"""
_JN15 = f"""{_SCORED} SELECT window_id, pattern_id, round(score, 6) AS score, round(stage1, 6) AS stage1, regime, CASE WHEN score >= 85e-2 THEN 'A' WHEN score >= 72e-2 THEN 'B' ELSE 'C' END AS tier, CASE WHEN mean_atr > 1e-1 THEN 'bull' WHEN mean_atr < -1e-1 THEN 'bear' ELSE 'neutral' END AS direction
 FROM r WHERE open_ AND stage1 >= 4e-1 AND score >= 6e-1 QUALIFY row_number() OVER (PARTITION BY window_id ORDER BY score DESC, pattern_id) <= 20"""
_FUNNEL = f"{_SCORED} SELECT window_id, count(*) AS templates, count(*) FILTER (open_) AS gated, count(*) FILTER (open_ AND stage1 >= 4e-1) AS screened, count(*) FILTER (open_ AND stage1 >= 4e-1 AND score >= 6e-1) AS matched FROM r GROUP BY 1"


def pt08_library_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patterns by symbol and direction, with the figures of their matches of the last ten days."""
    outcomes = st16_match_outcomes(spark, sf_dir).join(_mbo(spark, sf_dir).select(F.col("seq").alias("match_id"), "side"), "match_id").withColumn("pattern_id", F.concat("symbol", F.lit("-"), "side"))
    outcomes = written(outcomes, "outcomes")  # read for the names, for the last entry and for the figures
    names = outcomes.select(F.col("pattern_id").alias("name")).distinct()
    blank = F.lit(None).cast("string")
    outcomes_of = F.lit(None).cast("map<string, struct<mean_atr: double, std: double, hit_rate: double, n: long>>")
    patterns = names.select("name", F.col("name").alias("l3_signature"), blank.alias("l2_manifestation"), blank.alias("l1_footprint"), outcomes_of.alias("outcomes"), F.lit(100).alias("min_sample_size"), F.lit(False).alias("regime_specific"), F.lit(None).cast("array<string>").alias("instruments"), F.when(F.col("name").startswith("ES"), "rejected").otherwise("active").alias("status"), blank.alias("validation_hash"))
    made = library.reaggregated(patterns, outcomes, window_us=10 * DAY)
    figures = F.col("outcomes")["5m"]
    return made.select("name", "status", figures["n"].alias("n"), *[F.round(figures[c], 6).alias(c) for c in ("mean_atr", "std", "hit_rate")])


# -- times and candles

SPAN = ("2024-01-05", "2024-01-07T12:00:00+02:00")
FRAMES_US = (60 * MIN, 240 * MIN, DAY)


def flt04_time_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return times.between(_mbo(spark, sf_dir), *SPAN).select("symbol", "seq", "ts_us")


def st08_seek(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candle of each timeframe at every large cancel."""
    mbo = _mbo(spark, sf_dir)
    asked, traded = mbo.where("action = 'C' AND size >= 90"), mbo.where("action IN ('F', 'T')")
    each = [times.seek(times.candles(traded, us), asked, us).select("symbol", "seq", F.lit(us).alias("frame_us"), "index", "bucket_us") for us in FRAMES_US]
    return reduce(DataFrame.unionByName, each)


_ST08 = f"""WITH {MBO}, a AS (SELECT symbol, seq, ts_us FROM mbo WHERE action = 'C' AND size >= 90), k AS (SELECT symbol, frame_us, ts_us - ts_us % frame_us AS bucket_us FROM mbo, (VALUES {', '.join(f'(CAST({u} AS BIGINT))' for u in FRAMES_US)}) f(frame_us) WHERE action IN ('F', 'T') GROUP BY 1, 2, 3),
 i AS (SELECT *, row_number() OVER (PARTITION BY symbol, frame_us ORDER BY bucket_us) - 1 AS "index" FROM k), m AS (SELECT a.symbol, a.seq, i.frame_us, coalesce(max(i."index") FILTER (i.bucket_us <= a.ts_us), 0) AS "index" FROM a JOIN i ON a.symbol = i.symbol GROUP BY 1, 2, 3)
 SELECT m.symbol, m.seq, m.frame_us, m."index", i.bucket_us FROM m JOIN i ON m.symbol = i.symbol AND m.frame_us = i.frame_us AND m."index" = i."index" """


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    made = (bk01_book, l1_refresh_at_best, fe15_fragility_full, cs01_withdrawals, cs02_ignitions, cs04_contagion, st11_cusum, st13_throttle, st16_match_outcomes, wn03_rolling_tier, fe27_signature, cv01_purged_folds, cv01_day_folds, flt04_time_range, st08_seek, jn15_matches, jn15_funnel, pt08_library_update, src07_replay)
    return {f.__name__: f for f in made}


def oracle_sql() -> dict[str, str]:
    """st11_cusum has none: its sums start anew at every event."""
    count, speed = "streak_length >= 2 AND streak_velocity >= 2 AND pressure_acceleration >= 1", "5e-1 * streak_velocity / 2 + 5e-1 * pressure_acceleration"
    stall = f"ts_us - anchor_us >= {HOUR} AND stall_count >= 1 AND pressure_acceleration < 15e-1 AND streak_exhaustion >= 5e-1"
    return {
        "bk01_book": f"WITH {MBO} {book.sql(GRID)}", "l1_refresh_at_best": f"WITH {_ADDS} SELECT * FROM rates", "fe15_fragility_full": _FE15,
        "cs02_ignitions": _walk(str(cascades.STREAKS), count, speed, IGNITION["gap_us"]), "cs01_withdrawals": _walk(str(cascades.STALLS), stall, "5e-1 * stall_count + 5e-1 * streak_exhaustion", WITHDRAWAL["gap_us"]), "cs04_contagion": _CS04,
        "st13_throttle": _ST13, "st16_match_outcomes": _ST16, "wn03_rolling_tier": _WN03, "fe27_signature": _signature_sql(), "cv01_purged_folds": _CV01, "cv01_day_folds": _CV01_DAYS,
        "src07_replay": f"""WITH {MBO}, b AS ({book.sql(GRID)}) SELECT symbol, snap // 1000 AS timestamp, row_number() OVER (PARTITION BY symbol ORDER BY snap) - 1 AS position, count(*) FILTER (side = 'B') AS n_bids, count(*) FILTER (side = 'A') AS n_asks, max(price) FILTER (side = 'B') AS bid, min(price) FILTER (side = 'A') AS ask,
 CAST(coalesce(sum(volume) FILTER (side = 'B'), 0) AS DOUBLE) AS bid_volume, CAST(coalesce(sum(volume) FILTER (side = 'A'), 0) AS DOUBLE) AS ask_volume FROM b GROUP BY symbol, snap""",
        "jn15_matches": _JN15, "jn15_funnel": _FUNNEL,
        "pt08_library_update": f"""WITH o AS ({_ST16}), m AS ({source.DUCKDB['mbo']}), x AS (SELECT o.symbol || '-' || m.side AS name, o.* FROM o JOIN m ON o.match_id = m.seq), r AS (SELECT * FROM x WHERE entry_us >= (SELECT max(entry_us) FROM x) - {10 * DAY}),
 g AS (SELECT name, count(*) AS n, avg(realized) AS mean_atr, coalesce(stddev_samp(realized), 0) AS std, avg(CASE WHEN hit THEN 1e0 ELSE 0e0 END) AS hit_rate FROM r GROUP BY 1)
 SELECT p.name, CASE WHEN p.name LIKE 'ES%' THEN 'rejected' WHEN hit_rate < 5e-1 AND n >= 80 THEN 'retired' ELSE 'active' END AS status, n, round(mean_atr, 6) AS mean_atr, round(std, 6) AS std, round(hit_rate, 6) AS hit_rate FROM (SELECT DISTINCT name FROM x) p LEFT JOIN g ON p.name = g.name""",
        "flt04_time_range": f"WITH {MBO} SELECT symbol, seq, ts_us FROM mbo WHERE ts_us BETWEEN epoch_us(TIMESTAMP '2024-01-05 00:00:00') AND epoch_us(TIMESTAMP '2024-01-07 10:00:00')", "st08_seek": _ST08,
    }
