"""Matches of patterns: which patterns apply, one-to-one pairs of two sources, figures by cascade type; all on a caller's tables."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from functools import reduce
from operator import or_

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Names of regimes.
REGIMES = ("low", "normal", "elevated", "high")


def applicable(patterns: DataFrame, instrument: str, regime: str, least: int = 200) -> DataFrame:
    """pattern_id, selected: does a pattern apply to the instrument in the regime?

    patterns: pattern_id, instruments (array; null or empty: all), regime_specific (null: false), outcomes (map of key to
    n).  A regime-specific pattern needs n >= `least` at its first key with the regime's name, or no key that names any.
    """
    keys = F.coalesce(F.map_keys("outcomes"), F.array().cast("array<string>"))
    named = F.filter(keys, lambda k: F.contains(F.lower(k), F.lit(regime)))
    split = F.exists(keys, lambda k: reduce(or_, [F.contains(F.lower(k), F.lit(r)) for r in REGIMES]))
    supports = F.when(F.size(named) > 0, F.coalesce(F.element_at("outcomes", F.get(named, 0)) >= least, F.lit(False))).otherwise(~split)
    listed = F.coalesce(F.size("instruments") < 1, F.lit(True)) | F.coalesce(F.array_contains("instruments", instrument), F.lit(False))
    return patterns.select("pattern_id", (listed & (~F.coalesce("regime_specific", F.lit(False)) | supports)).alias("selected"))


def cascade_stats(cascades: DataFrame) -> DataFrame:
    """n, mean confidence and mean duration of each cascade_type; cascades: cascade_type, confidence, anchor_us, end_us."""
    duration = F.avg((F.col("end_us") - F.col("anchor_us")) / 1000)
    return cascades.groupBy("cascade_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("confidence"), 3).alias("mean_confidence"), F.round(duration, 1).alias("mean_duration_ms"))


def chains(rows: DataFrame, gap_us: int, blocks_of: int = 1000) -> DataFrame:
    """rows with `chain`, the end_us at which the row's run of events of its pattern began; runs are more than `gap_us` apart.

    Rows are ordered within blocks of time only; what goes from block to block is one row for each pattern and block.
    """
    rows = rows.withColumn("block", F.floor(F.col("end_us") / (gap_us * blocks_of)))
    inside, over = Window.partitionBy("pattern_id", "block").orderBy("end_us"), Window.partitionBy("pattern_id").orderBy("block")
    last = rows.groupBy("pattern_id", "block").agg(F.max("end_us").alias("last"))
    before = last.select("pattern_id", "block", F.lag("last").over(over).alias("before"))
    was = F.coalesce(F.lag("end_us").over(inside), "before")
    begun = rows.join(before, ["pattern_id", "block"]).withColumn("was", was).withColumn("start", F.when(F.col("was").isNull() | (F.col("end_us") - F.col("was") > gap_us), F.col("end_us")))
    starts = begun.groupBy("pattern_id", "block").agg(F.max("start").alias("start"))
    carried = starts.select("pattern_id", "block", F.max("start").over(over.rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    own = F.max("start").over(inside.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    return begun.join(carried, ["pattern_id", "block"]).withColumn("chain", F.coalesce(own, "carried")).drop("block", "before", "was", "start", "carried")


def pair_matches(left: DataFrame, right: DataFrame, window_us: int = 100_000) -> DataFrame:
    """pattern_id, left_id, right_id, delta_us: each match is paired once, with the nearest unpaired one of the other side.

    left, right: pattern_id (null: '?'), match_id, end_us (null: 0).  Matches come by end_us, left before right, match_id;
    one looks at those of the other side that came before it, at most `window_us` away; of equally near ones the first wins.
    No pair spans a gap of more than the window, so runs between such gaps are dealt out, and a task holds a window's matches.
    """
    sides = [x.select(F.coalesce("pattern_id", F.lit("?")).alias("pattern_id"), F.col("match_id").cast("long").alias("match_id"), F.coalesce(F.col("end_us").cast("long"), F.lit(0)).alias("end_us"), F.lit(i).alias("side")) for i, x in enumerate((left, right))]
    rows = chains(sides[0].unionByName(sides[1]), window_us)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, waiting = None, (deque(), deque())
        for b in batches:
            out = []
            for pattern, chain, now, side, match in zip(*(b.column(c).to_pylist() for c in ("pattern_id", "chain", "end_us", "side", "match_id"))):
                if (pattern, chain) != at:
                    at, waiting = (pattern, chain), (deque(), deque())
                for w in waiting:
                    while w and now - w[0][0] > window_us:
                        w.popleft()
                others = waiting[1 - side]
                if not others:
                    waiting[side].append((now, match))
                    continue
                k = len(others) - 1
                while k and others[k - 1][0] == others[-1][0]:
                    k -= 1
                then, other = others[k]
                del others[k]
                out.append((pattern, other, match, now - then) if side else (pattern, match, other, then - now))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.int64()))], ["pattern_id", "left_id", "right_id", "delta_us"])

    dealt = rows.repartition("pattern_id", "chain").sortWithinPartitions("pattern_id", "chain", "end_us", "side", "match_id")
    return dealt.mapInArrow(run, "pattern_id string, left_id long, right_id long, delta_us long")
