"""Folds over the events of a key in their order, on a table and on a stream alike: one step of a state and a row.

On a table the keys are dealt out and sorted, and a task walks its rows in Arrow batches with one state at a time: no key is
held in memory.  On a stream rows come in any order within the watermark: they wait, by blocks of event time, in a map
state; a timer at a block's end fires once the watermark is past it, and the block is folded in order into the value
state.  So the result does not depend on arrival or on restarts, and what waits is what the watermark holds open.

Edge cases: rows of one (key, ts_us, seq) count once; rows later than the watermark are dropped, as by every operator
on streams; what is not yet past the watermark is not yet folded; nulls reach the step as None; an empty table gives no
rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: For streams: the state store that keeps map states and timers.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


@dataclass(frozen=True)
class Fold:
    """`columns` (a schema) of a row after ts_us and seq; `state` and `out` (schemas); step(state, (ts_us, seq, *columns)) -> (state, rows out)."""

    columns: str
    state: str
    start: tuple
    step: Callable[[tuple, tuple], tuple[tuple, list[tuple]]]
    out: str


def cusum(h: float) -> Fold:
    """Events where the sum of rises or of falls of `mid` since the last event reaches h: seq, direction."""

    def step(state: tuple, row: tuple) -> tuple[tuple, list[tuple]]:
        up, down, was = state
        ts, seq, mid = row
        if mid is None:
            return state, []
        d = 0.0 if was is None else mid - was
        up, down = max(0.0, up + d), min(0.0, down + d)
        if up >= h or down <= -h:
            return (0.0, 0.0, mid), [(seq, 1 if up >= h else -1)]
        return (up, down, mid), []

    return Fold("mid double", "up double, down double, was double", (0.0, 0.0, None), step, "seq long, direction int")


def throttle(gap_us: int, least: int = 5) -> Fold:
    """Rows that may match: at least `least` rows seen, this one included, and `gap_us` since the last that did: seq, ts_us."""

    def step(state: tuple, row: tuple) -> tuple[tuple, list[tuple]]:
        n, last = state
        ts, seq = row[:2]
        if n + 1 >= least and (last is None or ts - last >= gap_us):
            return (n + 1, ts), [(seq, ts)]
        return (n + 1, last), []

    return Fold("mid double", "n long, last long", (0, None), step, "seq long, ts_us long")


def outcomes(horizon_us: int, tolerance: float = 0.125) -> Fold:
    """What became of each match: it opens at the last price known, and the first price at `horizon_us` after it or later closes it.

    Rows: mid (null: none), match_id (null: a price only), direction (bull, bear, else neutral, which never hits).  Out: match_id,
    entry_us, exit_us, entry, leave, realized (signed by the direction), hit (realized > tolerance).  A price closes before
    the match of its own row opens; a match before any price is dropped.
    """

    def step(state: tuple, row: tuple) -> tuple[tuple, list[tuple]]:
        ids, times, mids, signs, last = state
        ts, seq, mid, match, direction = row
        closed = []
        if mid is not None:
            keep = []
            for i, (m, t, x, s) in enumerate(zip(ids, times, mids, signs)):
                if ts - t >= horizon_us:
                    realized = (mid - x) * s
                    closed.append((m, t, ts, x, mid, realized, realized > tolerance))
                else:
                    keep.append(i)
            if closed:
                ids, times, mids, signs = ([c[i] for i in keep] for c in (ids, times, mids, signs))
            last = mid
        if match is not None and last is not None:
            sign = {"bull": 1.0, "bear": -1.0}.get(direction, 0.0)
            ids, times, mids, signs = [*ids, match], [*times, ts], [*mids, last], [*signs, sign]
        return (ids, times, mids, signs, last), closed

    state = "ids array<long>, times array<long>, mids array<double>, signs array<double>, last double"
    out = "match_id long, entry_us long, exit_us long, entry double, leave double, realized double, hit boolean"
    return Fold("mid double, match_id long, direction string", state, ([], [], [], [], None), step, out)


def _keyed(rows: DataFrame, fold: Fold, session_us: int | None) -> DataFrame:
    """symbol, session (begin of the row's session; 0 without sessions), ts_us, seq, the fold's columns."""
    session = F.col("ts_us") - F.pmod(F.col("ts_us"), F.lit(session_us)) if session_us else F.lit(0).cast("long")
    typed = [F.col(f.name).cast(f.dataType).alias(f.name) for f in T.StructType.fromDDL(fold.columns)]
    extra = [c for c in rows.columns if c == "ts"] if rows.isStreaming else []
    return rows.select(F.col("symbol").cast("string").alias("symbol"), session.alias("session"), F.col("ts_us").cast("long").alias("ts_us"), F.col("seq").cast("long").alias("seq"), *typed, *extra)


def on_table(rows: DataFrame, fold: Fold, session_us: int | None = None) -> DataFrame:
    """symbol, session and the fold's output; rows: symbol, ts_us, seq and the fold's columns."""
    schema = T.StructType.fromDDL(f"symbol string, session long, {fold.out}")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = place = None
        state = fold.start
        for b in batches:
            out = []
            for symbol, session, *row in zip(*(c.to_pylist() for c in b.columns)):
                if (symbol, session) != key:
                    key, place, state = (symbol, session), None, fold.start
                if tuple(row[:2]) == place:
                    continue
                place = tuple(row[:2])
                state, made = fold.step(state, tuple(row))
                out += [(*key, *x) for x in made]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], f.type) for i, f in enumerate(arrow)], schema=arrow)

    dealt = _keyed(rows, fold, session_us).repartition("symbol", "session").sortWithinPartitions("symbol", "session", "ts_us", "seq")
    return dealt.mapInArrow(run, schema)


class _InOrder(StatefulProcessor):
    def __init__(self, fold: Fold, block_ms: int, session_us: int | None):
        self.fold, self.block_ms, self.session_us = fold, block_ms, session_us
        columns = T.StructType.fromDDL(f"ts_us long, seq long, {fold.columns}").fields  # schemas are read on the driver only
        # pandas holds longs with nulls as floats, and a state would read those as nulls
        self.casts = [(f.name, int if isinstance(f.dataType, T.IntegralType) else lambda x: x) for f in columns]
        self.made = ["symbol", "session", *T.StructType.fromDDL(fold.out).names]
        self.held = ", ".join(f"{f.name} array<{f.dataType.simpleString()}>" for f in columns)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", self.fold.state)
        self.waiting = handle.getMapState("waiting", "block long", self.held)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        by_block: dict[int, list[tuple]] = {}
        for frame in rows:
            for row in zip(*([None if pd.isna(x) else cast(x) for x in frame[c]] for c, cast in self.casts)):
                by_block.setdefault(row[0] // 1000 // self.block_ms, []).append(row)
        for block, new in by_block.items():
            if self.waiting.containsKey((block,)):
                held = self.waiting.getValue((block,))
                new = [*zip(*held), *new]
            else:
                self.handle.registerTimer((block + 1) * self.block_ms)
            self.waiting.updateValue((block,), tuple(list(c) for c in zip(*new)))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = expiredTimerInfo.getExpiryTimeInMs() // self.block_ms
        state = self.state.get() if self.state.exists() else self.fold.start
        out = []
        for (block,) in sorted(k for k in self.waiting.keys() if k[0] < until):
            place = None
            for row in sorted(zip(*self.waiting.getValue((block,))), key=lambda r: r[:2]):
                if row[:2] != place:
                    place = row[:2]
                    state, made = self.fold.step(tuple(list(x) if isinstance(x, (list, tuple)) else x for x in state), row)
                    out += [(*key, *x) for x in made]
            self.waiting.removeKey((block,))
        self.state.update(tuple(state))
        if out:
            yield pd.DataFrame(out, columns=self.made)
        if self.session_us and (until * self.block_ms * 1000 >= key[1] + self.session_us):
            self.state.clear()  # no row of this session can come any more

    def close(self) -> None:
        pass


def on_stream(rows: DataFrame, fold: Fold, late: str, block_ms: int = 60_000, session_us: int | None = None) -> DataFrame:
    """The same rows as `on_table`, from a stream; sessions must be whole blocks.  The session needs STORE in its settings."""
    if session_us and session_us % (1000 * block_ms):
        raise ValueError("a session must be a whole number of blocks")
    timed = _keyed(rows.withColumn("ts", F.timestamp_micros("ts_us")), fold, session_us).withWatermark("ts", late)
    return timed.groupBy("symbol", "session").transformWithStateInPandas(_InOrder(fold, block_ms, session_us), f"symbol string, session long, {fold.out}", "append", "EventTime")
