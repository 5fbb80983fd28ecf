"""Matching against the definition, pair by pair; the shrunk covariance against its formula."""

import numpy as np
import pytest

from bookloom.operators import engine


def _cos(a, b, ends):
    n = min(len(a), len(b))
    if not n:
        return None
    a, b = (np.array(x[-n:] if ends else x[:n]) for x in (a, b))
    norm = np.linalg.norm(a) * np.linalg.norm(b)
    return float(a @ b / norm) if norm else None


def _pair(w, t, inverse):
    """score and stage of a pair; None where a gate or the first stage stops it."""
    _, instrument, series, features, l1, vix, minutes, volume, fragility, atr, bps = w
    _, t_series, t_features, instruments, regimes, vix_regime, t_minutes, tag, best, _ = t
    regime = "low" if vix < 15 else "normal" if vix < 25 else "elevated" if vix < 35 else "high"
    if (instruments and instrument not in instruments) or (regimes and regime not in regimes) or (tag is not None and tag != fragility and fragility in ("calm", "elevated", "fragile")):
        return None
    if atr and bps and atr > 0 and bps > 0 and best is not None and abs(best) * atr / 0.25 < bps / 10_000 * max(atr * 100, 100) / 0.25 * 2:
        return None
    stage = _cos(l1 or [], t_features or [], False)
    stage = 1.0 if stage is None else max(0.0, min(1.0, (stage + 1) / 2))
    if stage < 0.40:
        return None
    cosine = _cos(series or [], t_series or [], True) or 0.0
    d = np.array(features) - np.array(t_features)
    distance = np.sqrt(max(0.0, d @ inverse @ d)) if inverse is not None else np.linalg.norm(d)
    time = 1.0 if t_minutes is None else np.exp(-(((t_minutes - minutes) / 90) ** 2))
    context = ((1.0 if vix_regime is None or vix_regime == regime else 0.5) + time + max(0.0, 1 - abs(max(0.0, min(3.0, volume)) - 1) / 2)) / 3
    return 0.40 * (cosine + 1) / 2 + 0.35 / (1 + distance) + 0.25 * context, stage


@pytest.fixture(scope="module")
def tables(spark):
    r = np.random.default_rng(7)
    base = r.normal(size=(6, 12))
    pick = lambda *x: x[r.integers(len(x))]
    windows = []
    for i in range(120):
        b = base[r.integers(6)]
        windows.append((i, pick("ES", "NQ", "CL"), (b + 0.3 * r.normal(size=12)).tolist()[: pick(12, 8, 12)], (b[:4] + 0.1 * r.normal(size=4)).tolist(), pick(None, b[:4].tolist(), (-b[:4]).tolist(), [0.0] * 4, b[:3].tolist()), float(pick(10, 20, 30, 40)), int(r.integers(1440)), float(pick(0.5, 1.0, 4.0)), pick("calm", "elevated", "fragile", "other", None), pick(None, 2.0, 0.0), pick(None, 1.0, 30.0)))
    templates = []
    for j in range(70):
        b = base[r.integers(6)]
        templates.append((f"p{j:02}", b.tolist()[: pick(12, 10)], b[:4].tolist(), pick(None, [], ["ES"], ["NQ", "CL"]), pick(None, ["low", "normal"], ["high"]), pick(None, "low", "high"), pick(None, int(r.integers(1440))), pick(None, None, "calm", "fragile"), pick(None, 0.02, -3.0), float(pick(0.5, -0.5, 0.05))))
    return windows, templates, spark.createDataFrame(windows, engine.WINDOWS), spark.createDataFrame(templates, engine.TEMPLATES)


@pytest.mark.parametrize(("block", "shrunk"), [(2048, False), (16, True), (1, False)])
def test_matches(spark, tables, block, shrunk):
    windows, templates, w, t = tables
    inverse = engine.shrunk_covariance(w, "features") if shrunk else None
    if block == 1:
        templates, t = templates[:9], t.where("pattern_id < 'p09'")
    exp, passed = {}, 0
    for x in windows:
        found = [(p, s, y[9]) for y in templates if (p := y[0]) and (s := _pair(x, y, inverse))]
        passed += len(found)
        best = sorted([f for f in found if f[1][0] >= 0.60], key=lambda f: (-f[1][0], f[0]))[:20]
        exp |= {(x[0], p): (*s, k, "A" if s[0] >= 0.85 else "B" if s[0] >= 0.72 else "C", "bull" if m > 0.1 else "bear" if m < -0.1 else "neutral") for k, (p, s, m) in enumerate(best, 1)}
    got = {(r.window_id, r.pattern_id): r for r in engine.match(w, t, inverse, block=block).collect()}
    assert set(got) == set(exp) and len(exp) > 20
    for key, (score, stage, place, tier, direction) in exp.items():
        g = got[key]
        assert (g.score, g.stage1) == (pytest.approx(score, abs=1e-9), pytest.approx(stage, abs=1e-9)) and (g.place, g.tier, g.direction) == (place, tier, direction)
    steps = engine.funnel(w, t, block).toPandas()
    assert (steps["templates"] == len(templates)).all() and steps["screened"].sum() == passed and (steps["gated"] > steps["screened"]).any()


def test_the_first_stage_prunes_only_itself(spark, tables):
    """Without it the same pairs have the same scores; it only takes those under its threshold."""
    _, _, w, t = tables
    key = lambda x: {(r.window_id, r.pattern_id): r.score for r in engine.match(w.limit(40), t.limit(15), None, screen=x).collect()}
    on, off = key(True), key(False)
    assert on.items() <= off.items() and len(on) < len(off)


def test_empty(spark, tables):
    _, _, w, t = tables
    assert engine.match(w.where("false"), t).count() == 0 and engine.match(w, t.where("false")).count() == 0 and engine.funnel(w, t.where("false")).count() == 0


def test_shrunk_covariance(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(200, 5)) @ r.normal(size=(5, 5)) + 3
    got = engine.shrunk_covariance(spark.createDataFrame([(v.tolist(),) for v in x], "v array<double>"), "v")
    c = x - x.mean(0)
    s = c.T @ c / len(x)
    level = np.trace(s) / 5
    spread = np.sum((s - level * np.eye(5)) ** 2) / 5
    noise = sum(np.sum((np.outer(v, v) - s) ** 2) for v in c) / len(x) ** 2 / 5
    share = min(noise, spread) / spread
    assert got == pytest.approx(np.linalg.inv((1 - share) * s + share * level * np.eye(5)), rel=1e-8)
    assert engine.shrunk_covariance(spark.createDataFrame([([1.0, 2.0],)], "v array<double>"), "v") is None
    flat = spark.createDataFrame([([float(i), 1e-9 * (i % 3)],) for i in range(4000)], "v array<double>")
    assert engine.shrunk_covariance(flat, "v") is None
