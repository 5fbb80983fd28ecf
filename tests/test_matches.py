"""Pairs of matches against a loop over all that wait; patterns and cascades by hand."""

import numpy as np
import pytest

from bookloom.operators import matches


def _loop(left, right, window):
    """Every match looks through all that wait on the other side."""
    waiting, out = {0: [], 1: []}, []
    for now, side, match, pattern in sorted([(e, 0, m, p) for p, m, e in left] + [(e, 1, m, p) for p, m, e in right]):
        near = [(now - e, k) for k, (p, m, e) in enumerate(waiting[1 - side]) if p == pattern and now - e <= window]
        if near:
            _, other, then = waiting[1 - side].pop(min(near)[1])
            out.append((pattern, other, match, now - then) if side else (pattern, match, other, then - now))
        else:
            waiting[side].append((pattern, match, now))
    return sorted(out)


@pytest.mark.parametrize("window", [1, 7, 40])
def test_pairs(spark, window):
    r = np.random.default_rng(window)
    rows = [[("ab"[int(r.integers(5) == 0)], int(i), int(r.integers(-4000, 9000) // 3 * 3)) for i in range(n)] for n in (900, 700)]
    rows[0] += [("a", 2000 + i, 100_000) for i in range(3)]  # many at one time
    rows[1] += [("a", 3000 + i, 100_000) for i in range(2)]
    frames = [spark.createDataFrame(x, "pattern_id string, match_id long, end_us long") for x in rows]
    got = sorted(map(tuple, matches.pair_matches(*frames, window).collect()))
    assert got == _loop(*rows, window)
    assert len(got) > 50


def test_chains_cross_blocks(spark):
    times = [-25, -20, 0, 9, 18, 27, 36, 100, 110, 121]
    rows = spark.createDataFrame([("a", t) for t in times], "pattern_id string, end_us long")
    got = {r.end_us: r.chain for r in matches.chains(rows, 10, blocks_of=2).collect()}
    assert got == {-25: -25, -20: -25, 0: 0, 9: 0, 18: 0, 27: 0, 36: 0, 100: 100, 110: 100, 121: 121}


def test_pairs_edge_cases(spark):
    schema = "pattern_id string, match_id long, end_us long, side string"
    empty, odd = spark.createDataFrame([], schema), spark.createDataFrame([(None, 1, None, "x"), (None, 1, None, "x")], schema)
    assert matches.pair_matches(empty, empty).collect() == []
    assert matches.pair_matches(odd, empty).collect() == []
    assert [tuple(r) for r in matches.pair_matches(odd, odd.limit(1)).collect()] == [("?", 1, 1, 0)]


def test_applicable(spark):
    rows = [
        ("all", None, None, None), ("listed", ["ES", "NQ"], False, {"low": 1}), ("other", ["NQ"], False, None), ("none listed", [], True, {}),
        ("enough", ["ES"], True, {"5m_HIGH": 200}), ("few", ["ES"], True, {"5m_High": 199}), ("first key", [], True, {"high_a": 5, "high_b": 900}),
        ("unsplit", [], True, {"5m": 3}), ("other regime", [], True, {"low_5m": 900}), ("null n", [], True, {"high": None}),
    ]
    table = spark.createDataFrame(rows, "pattern_id string, instruments array<string>, regime_specific boolean, outcomes map<string, long>")
    got = {r.pattern_id for r in matches.applicable(table, "ES", "high").collect() if r.selected}
    assert got == {"all", "listed", "none listed", "enough", "unsplit"}
    assert matches.applicable(table.limit(0), "ES", "high").collect() == []


def test_cascade_stats(spark):
    rows = [("A", 0.5, 1000, 3000), ("A", 0.2, 0, 1000), ("B", None, 0, None)]
    got = {tuple(r) for r in matches.cascade_stats(spark.createDataFrame(rows, "cascade_type string, confidence double, anchor_us long, end_us long")).collect()}
    assert got == {("A", 2, 0.35, 1.5), ("B", 1, None, None)}
