"""Combinatorial purged folds of rows: groups of time or of whole days, an embargo around events, guards on days.

A row has one group and is or is not near an event, whatever the fold: so rows carry two values, and folds are a table
of a few rows that is laid over them at the end.  Places come by blocks; days and folds are counted on the table of days.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bookloom.operators.frames import last_until
from bookloom.operators.rolling import DAY, with_place


def _group(place: Column, n: Column, k: int) -> Column:
    """Of n things in k groups of nearly one size, the larger ones first."""
    q, r = F.floor(n / k), n % k
    return F.when(place < r * (q + 1), F.floor(place / (q + 1))).otherwise(r + F.floor((place - r * (q + 1)) / q)).cast("int")


def _near(rows: DataFrame, events: DataFrame, span_us: int, block_us: int) -> DataFrame:
    """rows with `near`: is an event of the symbol at most span_us away, before or after?"""
    facts = events.where("ts_us is not null").select("symbol", F.col("ts_us").alias("at_us")).distinct()
    before = last_until(rows, facts.withColumn("then", F.col("at_us")), ["then"], block_us)
    back = before.withColumns({"was": F.col("then"), "now": F.col("ts_us"), "ts_us": -F.col("ts_us")}).drop("then")
    after = last_until(back, facts.select("symbol", (-F.col("at_us")).alias("at_us"), F.col("at_us").alias("then")), ["then"], block_us)
    near = F.coalesce(F.col("now") - F.col("was") <= span_us, F.lit(False)) | F.coalesce(F.col("then") - F.col("now") <= span_us, F.lit(False))
    return after.select(*[F.col("now").alias("ts_us") if c == "ts_us" else F.col(c) for c in rows.columns], near.alias("near"))


def grouped(rows: DataFrame, events: DataFrame | None, k: int, embargo_days: int, day_aware: bool, block_us: int = DAY) -> DataFrame:
    """symbol, seq, ts_us, day, grp (from 0), near; by days, symbols with fewer than k days are left out."""
    base = rows.select("symbol", "seq", "ts_us", F.floor(F.col("ts_us") / DAY).alias("day"))
    if not day_aware:
        n = base.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))
        placed = with_place(base, block_us).join(n, "symbol").withColumn("grp", _group(F.col("place"), F.col("n"), k)).drop("place", "n")
        return placed.withColumn("near", F.lit(False)) if events is None else _near(placed, events, embargo_days * DAY, block_us)
    days = base.select("symbol", "day").distinct()  # a row a day
    w = Window.partitionBy("symbol")
    days = days.withColumns({"no": F.row_number().over(w.orderBy("day")) - 1, "n": F.count(F.lit(1)).over(w)}).where(F.col("n") >= k).withColumn("grp", _group(F.col("no"), F.col("n"), k))
    days = days.withColumn("near", F.lit(False))
    if events is not None:
        # An event on a day without rows counts for the next day that has some.
        hit = events.where("ts_us is not null").select("symbol", F.floor(F.col("ts_us") / DAY).alias("at")).distinct()
        marks = days.select("symbol", F.col("day").alias("at"), "no").unionByName(hit.withColumn("no", F.lit(None).cast("int")))
        snapped = marks.withColumn("no", F.first("no", True).over(w.orderBy("at", F.col("no").isNotNull()).rowsBetween(0, Window.unboundedFollowing)))
        snapped = snapped.join(hit, ["symbol", "at"], "left_semi").where("no is not null").select("symbol", "no").distinct()
        near = snapped.select("symbol", F.explode(F.sequence(F.col("no") - embargo_days, F.col("no") + embargo_days)).alias("no")).distinct().withColumn("hit", F.lit(True))
        days = days.drop("near").join(near, ["symbol", "no"], "left").withColumn("near", F.coalesce("hit", F.lit(False)))
    return base.join(days.select("symbol", "day", "grp", "near"), ["symbol", "day"]).select("symbol", "seq", "ts_us", "day", "grp", "near")


def folds(rows: DataFrame, events: DataFrame | None = None, k: int = 5, test_groups: int = 2, embargo_days: int = 14, day_aware: bool = False, least_train_days: int = 3, least_test_days: int = 1, block_us: int = DAY) -> DataFrame:
    """symbol, fold, seq, role: every row in every fold, as 'test', 'train' or 'embargoed'.

    rows: symbol, ts_us, seq; events: symbol, ts_us.  Folds are the choices of `test_groups` of the k groups, in order, numbered from 0; by days, those with too few days of training
    (after the embargo) or test are left out before they are numbered, and the embargo counts days that have rows.  Groups that have no row make no fold of their own.
    """
    assigned = grouped(rows, events, k, embargo_days, day_aware, block_us)
    choices = list(combinations(range(k), test_groups))
    spark = rows.sparkSession
    table = F.broadcast(spark.createDataFrame([(i, list(c)) for i, c in enumerate(choices)], "choice int, tests array<int>"))  # C(k, test_groups) rows
    days = assigned.groupBy("symbol", "day", "grp", "near").agg(F.count(F.lit(1)).alias("n"))
    tested = F.array_contains("tests", F.col("grp"))
    each = days.withColumn("choice", F.explode(F.sequence(F.lit(0), F.lit(len(choices) - 1)))).join(table, "choice")
    sums = each.groupBy("symbol", "choice", "tests").agg(F.count_distinct(F.when(tested, F.col("day"))).alias("test_days"), F.count_distinct(F.when(~tested & ~F.col("near"), F.col("day"))).alias("train_days"))
    kept = sums.where((F.col("train_days") >= least_train_days) & (F.col("test_days") >= least_test_days)) if day_aware else sums.where("test_days > 0")
    numbered = kept.select("symbol", "tests", (F.row_number().over(Window.partitionBy("symbol").orderBy("choice")) - 1).alias("fold"))
    choices_of = numbered.groupBy("symbol").agg(F.collect_list(F.struct("fold", "tests")).alias("folds"))
    laid = assigned.join(choices_of, "symbol").select("symbol", "seq", "grp", "near", F.explode("folds").alias("f"))
    role = F.when(F.array_contains("f.tests", F.col("grp")), "test").when(F.col("near"), "embargoed").otherwise("train")
    return laid.select("symbol", F.col("f.fold").alias("fold"), "seq", role.alias("role"))
