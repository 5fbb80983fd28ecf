"""Outcomes of matches by blocks against the ordered walk."""

import pytest
from test_folds import SCHEMA, S, _outcomes, _rows

from bookloom import composed
from bookloom.operators import frames


@pytest.mark.parametrize("horizon", [1, 60, 3000])
def test_outcomes_by_blocks(spark, horizon):
    rows = _rows(1, 800)
    table = spark.createDataFrame(rows, SCHEMA)
    got = sorted(map(tuple, frames.match_outcomes(table, horizon * S).collect()))
    exp = sorted((x[0], *x[2:]) for x in _outcomes(rows, horizon * S, 0.125))
    assert got == exp and len(got) > 100
    with pytest.raises(ValueError):
        frames.match_outcomes(table, 0)


def test_no_symbol_is_a_walk(spark):
    plan = composed.st16_match_outcomes(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan
