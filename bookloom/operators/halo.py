"""Statements over whole symbols, run by parts of symbols: each part holds its own rows and those that their frames reach.

A frame bounded in time reaches a known time before and after a row, one bounded in rows a known number of them.  So the
tables are cut into parts by time or by place, each row is copied to the parts whose frames reach it, the symbol in a
statement is the symbol's part, and of the rows that come out those of the part itself are kept: a number tells a
copy by its last bit, which leaves the order as it is.  The statement over whole symbols stays the oracle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bookloom.operators.frames import LEAST_BLOCK_US
from bookloom.operators.rolling import with_place
from bookloom.operators.sql import Operator
from bookloom.sources import mbo as source

_END = "max(ts_us) OVER (PARTITION BY symbol)"


@dataclass(frozen=True)
class Halo:
    """How far frames reach: in microseconds, or in rows (numbers, or names of the statement's parameters); `where` the statement keeps rows of its table."""

    before: int | str = 0
    after: int | str = 0
    rows: bool = False
    where: str = "true"


def _parts(at: Column, size: int, before: int, after: int) -> Column:
    own = F.floor(at / size)
    later, earlier = at >= (own + 1) * size - before, at < own * size + after
    copy = lambda part: F.struct(part.alias("part"), F.lit(1).alias("copy"))
    every = F.array(F.struct(own.alias("part"), F.lit(0).alias("copy")), F.when(later, copy(own + 1)), F.when(earlier, copy(own - 1)))
    return F.explode(F.array_compact(every))


def cut(rows: DataFrame, before: int, after: int, by_rows: bool) -> DataFrame:
    """rows by parts: symbol is symbol|part, seq is 2 seq, or 2 seq + 1 for a copy, end_us the symbol's last time; parts hold some 16 times what frames reach."""
    ends = rows.groupBy("symbol").agg(F.max("ts_us").alias("end_us"))
    if by_rows:
        size, placed = max(16 * (before + after), 256), with_place(rows)
        each = placed.withColumn("x", _parts(F.col("place"), size, before, after)).drop("place")
    else:
        size = max(16 * (before + after), LEAST_BLOCK_US)
        each = rows.withColumn("x", _parts(F.col("ts_us"), size, before, after))
    named = F.concat(F.col("symbol"), F.lit("|"), F.col("x.part").cast("string"))
    return each.join(ends, "symbol").withColumns({"symbol": named, "seq": 2 * F.col("seq") + F.col("x.copy")}).drop("x")


def by_parts(op: Operator, halo: Halo, spark: SparkSession, tables: dict[str, DataFrame], **params: float) -> DataFrame:
    """The rows of the statement, which must give symbol and seq and use seq for order and joins alone."""
    values = {**op.defaults, **params}
    before, after = (int(values[x]) if isinstance(x, str) else x for x in (halo.before, halo.after))
    cuts = {t: cut(tables[t].where(halo.where), before, after, halo.rows) for t in op.tables()}
    run = Operator(op.name, op.sql.replace(_END, "end_us"), op.defaults).apply(spark, cuts, **params)
    own = run.where(F.col("seq") % 2 == 0)
    return own.withColumns({"symbol": F.regexp_replace("symbol", r"\|-?\d+$", ""), "seq": (F.col("seq") / 2).cast("long")})


#: Each within its frames: the look back or ahead of the statement, and one row more where it takes differences.
HALOS = {
    "l1_trade_ratios": Halo(before="w"), "ex04_adverse": Halo(after="h3"), "lb06_outcomes": Halo(after="h"), "lb05_firing_labels": Halo(after="h"),
    "nb01_forward_returns": Halo(after=50, rows=True), "lb03_cost_binary": Halo(after="h", rows=True), "fe16_energy": Halo(before=50, rows=True), "fe17_energy_ratio": Halo(before=20, rows=True, where="mid > 0"),
    "fe18_entropy_gate": Halo(before=29, rows=True), "fe05_bvc": Halo(before=50, rows=True, where="mid > 0"),
}


def query(op: Operator, halo: Halo):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        mbo = source.read(spark, sf_dir)
        tables = {"mbo": mbo, "quotes": source.quotes(spark, mbo)}
        return by_parts(op, halo, spark, {t: tables[t] for t in op.tables()}, **op.scaled)

    return run
