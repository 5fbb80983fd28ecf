"""All queries of the market-data operators, with the SQL that states the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from bookloom import composed
from bookloom.operators import adapter, barriers, books, dense, features, frames, halo, layering, matches, models, queues, research, scans, spans, stateful
from bookloom.sources import mbo as source

OPERATORS = {o.name: o for o in (*scans.OPERATORS, *features.OPERATORS, *books.OPERATORS, *research.OPERATORS)}


MIN = 60_000_000


def _stateful() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """What SQL cannot say; tests hold them against plain loops."""

    def on(table: str, f: Callable[..., DataFrame], **params) -> Callable[[SparkSession, str], DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            mbo = source.read(spark, sf_dir)
            return f(mbo if table == "mbo" else source.quotes(spark, mbo), **params)

        return run

    return {
        "cf01_streaks": on("mbo", stateful.streaks, least=2), "fe21_kalman": on("quotes", stateful.kalman),
        "fe03_vpin_reset": on("mbo", stateful.vpin_reset, bucket=100.0), "sp01_spectral": on("mbo", stateful.spectral, step_us=60 * MIN), "bt01_backtest": on("quotes", stateful.backtest, stop=0.5),
        "l2_imbalance_ema": on("quotes", queues.imbalance_ema), "cf04_stop_run": lambda s, d: queues.stop_runs(stateful.streaks(source.read(s, d), least=1), depth=1, velocity=1e-5),
        "bk03_queue_positions": on("mbo", queues.queue_positions, tick=5.0), "bk03_pro_rata": on("mbo", queues.queue_positions, tick=5.0, pro_rata=True), "ex01_fill_simulation": _fills,
        "ex07_position_limits": lambda s, d: queues.position_limits(stateful.backtest(source.quotes(s, source.read(s, d)), stop=0.5)), "lt01_levels": on("mbo", queues.track_levels, step_us=60 * MIN, age_us=120 * MIN, fade_us=600 * MIN, tick=20.0),
        "st04_bursts": on("mbo", queues.bursts, span_us=60 * MIN, least=2, gap_us=300 * MIN, before_us=30 * MIN, after_us=60 * MIN), "nb12_anchors": on("quotes", queues.anchors, move=20.0, gap_us=300 * MIN),
        "fe19_flux_stark": on("quotes", dense.flux_stark, window=8, recent=3), "fe23_wavelet": on("quotes", dense.wavelets, step_us=10 * MIN), "fe24_modes": on("quotes", dense.modes), "fe25_hilbert": on("quotes", dense.hilbert),
        "fe26_coherence": on("quotes", dense.depth_coherence, segment=4), "fe28_hawkes": on("quotes", dense.hawkes_fit), "cv06_augment": on("quotes", dense.augment), "cv04_gain": _gain,
    }


def _fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    mbo = source.read(spark, sf_dir)
    return queues.simulate_fills(mbo, source.quotes(spark, mbo), every=3, horizon_us=300 * MIN, adverse_ticks=20, sweep_us=60 * MIN, tick=5.0)


def _gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score that follows the side more than chance, against the base rate."""
    scores = source.read(spark, sf_dir).selectExpr("symbol", "ts_us", "seq", "CASE WHEN side = 'B' THEN 1D ELSE 0D END AS y", "5e-1 AS base")
    return dense.bootstrap_gain(scores.selectExpr("*", "y * 3e-1 + (seq * 7919) % 1000 / 1000D * 6e-1 AS model"))


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def _clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.shape_clusters(OPERATORS["pt01_event_shape"].query(spark, sf_dir), ["add_ratio", "mean_size", "q25", "q75", "asymmetry", "spread"])


def _learned() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def on(f: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, sf_dir: f(source.quotes(spark, source.read(spark, sf_dir)))

    return {
        "rg03_learned_regime": on(models.learned_regime), "cv02_fold_auc": on(models.fold_auc), "cv03_calibration_gain": on(models.calibration_gain), "cv05_meta_labels": on(models.meta_labels), "pt02_clusters": _clusters,
        "fe30_latent": lambda s, d: models.latent(_vectors(s, d)), "pt03_projection": lambda s, d: models.latent(_vectors(s, d), 2), "tk09_exemplars": lambda s, d: models.exemplars(_vectors(s, d)),
        "pt05_template_match": lambda s, d: models.match_templates(_vectors(s, d).where("embedding is not null"), 0.0).selectExpr("vec_id", "pattern", "round(score, 6) AS score").where("score >= 6e-1"),
    }


def _framed() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """What runs by blocks of time or parts of symbols; the statement of the same name stays its oracle."""

    def on(name: str, f: Callable[..., DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            mbo = source.read(spark, sf_dir)
            return f(mbo, source.quotes(spark, mbo), **{**OPERATORS[name].defaults, **OPERATORS[name].scaled})

        return run

    by_frames = {**frames.OPERATORS, **spans.OPERATORS, **layering.OPERATORS, "lb01_triple_barrier": barriers.triple_barrier, "lb02_excursions": barriers.excursions}
    return {name: halo.query(OPERATORS[name], h) for name, h in halo.HALOS.items()} | {name: on(name, f) for name, f in by_frames.items()}


_SNAPS = f"SELECT symbol, ts_us - ts_us % {600 * MIN} AS snap, max(CASE WHEN side = 'B' THEN price END) AS bid, min(CASE WHEN side = 'A' THEN price END) AS ask FROM {{mbo}} WHERE action = 'A' GROUP BY 1, 2"
_ADAPTED = f"WITH mbo AS ({source.DUCKDB['mbo']}), s AS ({_SNAPS.replace('{mbo}', 'mbo')}), p AS (SELECT symbol, snap, coalesce(bid, 0) AS bid, coalesce(ask, 0) AS ask FROM s), l AS (SELECT *, lag(bid, 1, bid) OVER w AS bid0, lag(ask, 1, ask) OVER w AS ask0 FROM p WINDOW w AS (PARTITION BY symbol ORDER BY snap)), e AS (SELECT * FROM mbo QUALIFY row_number() OVER (PARTITION BY symbol, order_id, ts_us, CASE WHEN action IN ('F', 'T') THEN 'T' ELSE action END ORDER BY seq) = 1) SELECT e.symbol, e.seq, e.ts_us, "
_MATCHED_ON = f" FROM e JOIN l ON e.symbol = l.symbol AND e.ts_us - e.ts_us % {600 * MIN} = l.snap WHERE "
_ADAPTER_SQL = {
    "l1ad_passive_adds": _ADAPTED + "e.side" + _MATCHED_ON + "action = 'A' AND (side = 'B' AND abs(price - greatest(bid, bid0)) < 125e-3 OR side = 'A' AND abs(price - least(ask, ask0)) < 125e-3)",
    "l1ad_trade_sides": _ADAPTED + "CASE WHEN bid = 0 OR ask = 0 THEN CASE WHEN price > 0 OR side = 'A' AND price = 0 THEN 'ask' ELSE 'bid' END WHEN 2 * price > bid + ask THEN 'ask' WHEN 2 * price < bid + ask OR side = 'B' THEN 'bid' ELSE 'ask' END AS side, e.size" + _MATCHED_ON + "action IN ('F', 'T')",
}


def _adapted() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Stand-in snapshots: the best prices added in a step of time, which also show all events of the step."""

    def on(f: Callable[..., DataFrame], where: str, **params) -> Callable[[SparkSession, str], DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            mbo = source.read(spark, sf_dir)
            rows = mbo.where(where).selectExpr("*", f"ts_us - ts_us % {600 * MIN} AS snap", "false AS aggressive")
            return f(spark.sql(_SNAPS, mbo=mbo), rows, **params)

        return run

    return {"l1ad_passive_adds": on(adapter.passive_adds, "action = 'A'", block=60_000 * MIN), "l1ad_trade_sides": on(adapter.trade_sides, "action IN ('F', 'T')")}


_CASCADES = ["action AS cascade_type", "size / 101D AS confidence", "ts_us AS anchor_us", "ts_us + seq % 1000 * 700 AS end_us"]
#: A pattern for each symbol and action: without instruments for trades, no outcomes by regime for cancels.
_PATTERNS = """SELECT symbol || '-' || action AS pattern_id, CASE WHEN action = 'T' THEN array() ELSE array(symbol) END AS instruments, action IN ('A', 'C', 'F') AS regime_specific,
 CASE WHEN action = 'C' THEN map('5m', count(*)) ELSE map('LOW_5m', count_if(size < 34), 'HIGH_5m', count_if(size >= 67)) END AS outcomes FROM {mbo} GROUP BY symbol, action"""
_MATCH_SQL = {
    "nb15_cascade_stats": f"WITH mbo AS ({source.DUCKDB['mbo']}) SELECT action AS cascade_type, count(*) AS n, round(avg(size / 101e0), 3) AS mean_confidence, round(avg(seq % 1000 * 7e-1), 1) AS mean_duration_ms FROM mbo GROUP BY 1",
    "flt11_applicable": f"WITH mbo AS ({source.DUCKDB['mbo']}) SELECT symbol || '-' || action AS pattern_id, CASE action WHEN 'T' THEN true WHEN 'M' THEN symbol = 'ES' WHEN 'C' THEN symbol = 'ES' ELSE symbol = 'ES' AND count(*) FILTER (WHERE size >= 67) >= 140 END AS selected FROM mbo GROUP BY symbol, action",
}


def _matched() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Stand-ins for the caller's tables of patterns, cascades and matches; tests hold the pairs against a loop."""

    def sides(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
        rows = source.read(spark, sf_dir)
        return [rows.where(rows["action"] == a).selectExpr("symbol || side AS pattern_id", "seq AS match_id", "ts_us AS end_us") for a in "FT"]

    return {
        "nb15_cascade_stats": lambda s, d: matches.cascade_stats(source.read(s, d).selectExpr(*_CASCADES)),
        "flt11_applicable": lambda s, d: matches.applicable(s.sql(_PATTERNS, mbo=source.read(s, d)), "ES", "high", 140),
        "jn09_pairs": lambda s, d: matches.pair_matches(*sides(s, d), window_us=60 * MIN),
    }


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: o.query for name, o in OPERATORS.items()} | _framed() | _stateful() | _learned() | _matched() | _adapted() | composed.queries()


def oracle_sql() -> dict[str, str]:
    return {name: o.oracle() for name, o in OPERATORS.items()} | {"tk09_exemplars": models.EXEMPLARS_SQL, "pt05_template_match": models.MATCH_SQL} | _MATCH_SQL | _ADAPTER_SQL | composed.oracle_sql()
