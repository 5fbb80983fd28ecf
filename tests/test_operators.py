"""Relational operators against the oracle, stateful ones against plain loops, the stream against the batch."""

import math

import duckdb
import pytest

from bookloom import catalog
from bookloom.operators import stateful
from bookloom.sources import mbo as source

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events embeddings".split():
        c.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    return c


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else v


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_oracle(spark, duck, name):
    df = catalog.queries()[name](spark, DATA)
    found = duck.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    mine = sorted(([plain(r[c]) for c in names] for r in df.collect()), key=repr)
    assert mine == sorted(([plain(v) for v in r] for r in found.fetchall()), key=repr)


def test_cusum_and_streaks_follow_a_loop(spark):
    mbo = source.read(spark, DATA)
    quotes = source.quotes(spark, mbo)
    rows = sorted(quotes.collect(), key=lambda r: (r["symbol"], r["ts_us"], r["seq"]))
    want, state = [], {}
    for r in rows:
        key = (r["symbol"], r["ts_us"] // stateful.DAY)
        up, down, last = state.get(key, (0.0, 0.0, r["mid"]))
        d = r["mid"] - last
        up, down = max(0.0, up + d), min(0.0, down + d)
        if up >= 50 or down <= -50:
            want.append((r["seq"], 1 if up >= 50 else -1))
            up = down = 0.0
        state[key] = (up, down, r["mid"])
    assert sorted((r["seq"], r["direction"]) for r in stateful.cusum(quotes, 50.0).collect()) == sorted(want)
    assert all(r["fills"] >= 2 and r["depth"] >= 1 for r in stateful.streaks(mbo, 2).collect())


def test_empty_tables(spark):
    mbo = source.read(spark, DATA).limit(0)
    assert stateful.kalman(source.quotes(spark, mbo)).count() == 0
    assert catalog.OPERATORS["agg01_candles"].apply(spark, {"mbo": mbo}).count() == 0


def test_stream_equals_batch(spark, tmp_path):
    from bookloom.streaming import candles

    events = spark.read.parquet(f"{DATA}/events.parquet").orderBy("ts")
    events.limit(600).coalesce(1).write.parquet(str(tmp_path / "in"))
    events.limit(300).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))  # repeated rows
    stream = candles.candles(candles.event_stream(spark, str(tmp_path / "in"), events.schema), late="60 days")
    q = stream.writeStream.format("memory").queryName("c").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {tuple(r) for r in spark.table("c").collect()}
    assert got == {tuple(r) for r in candles.candles(events.limit(600)).collect()} and got


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
