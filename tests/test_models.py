"""Ranks from counts against ranks of rows; the features of a model are made once, and its scores too."""

import numpy as np

from bookloom.operators import models
from bookloom.sources import mbo as source


def test_auc_from_counts(spark):
    r = np.random.default_rng(1)
    rows = [(int(r.integers(3)), float(r.integers(20)) / 20, float(r.integers(2))) for _ in range(500)] + [(9, 0.5, 1.0)]
    table = spark.createDataFrame(rows, "fold int, p double, y double")
    for fold, n, auc in models._auc(table, ["fold"]).collect():
        own = [x for x in rows if x[0] == fold]
        ones, zeros = ([p for _, p, y in own if y == k] for k in (1, 0))
        wins = [(a > b) + (a == b) / 2 for a in ones for b in zeros]
        assert n == len(own) and (auc is None if not wins else abs(auc - np.mean(wins)) < 1e-12)


def test_scores_are_a_table(spark):
    quotes = source.quotes(spark, source.read(spark, "/root/testdata/sf0.001"))
    scores = models.fold_scores(quotes, trees=2)
    plan = scores._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Union" not in plan
    assert scores.count() == models.features(quotes).count() and scores.select("symbol", "seq").distinct().count() == scores.count()
