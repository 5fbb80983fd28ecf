"""Order events ("mbo"), quotes and trades from the event table, in Spark and as SQL for the oracle.

mbo: symbol, seq, order_id, ts_us, action (A C M F T), side (B A, of the resting order), price, size.
quotes: symbol, seq, ts_us, bid, ask, bid_size, ask_size, mid (a stand-in: a quote around every event's price).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SYMBOLS = ["CL", "ES", "GC", "NQ", "SI"]
_ACTION = "CASE event_type WHEN 'view' THEN 'A' WHEN 'click' THEN 'M' WHEN 'error' THEN 'C' WHEN 'purchase' THEN 'F' ELSE 'T' END"
_SYMBOL = "CASE user_id % 5 " + " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(SYMBOLS[:-1])) + f" ELSE '{SYMBOLS[-1]}' END"
_REST = f"user_id AS order_id, {_ACTION} AS action, CASE WHEN event_id % 2 = 0 THEN 'B' ELSE 'A' END AS side, round(value / 25e-2) * 25e-2 AS price, {_SYMBOL} AS symbol"
_QUOTES = (
    "SELECT symbol, seq, ts_us, price - 25e-2 * (seq % 3 + 1) AS bid, price + 25e-2 * (size % 2 + 1) AS ask, size AS bid_size, "
    "(seq * 7) % 50 + 1 AS ask_size, price + 125e-3 * (size % 2 - seq % 3) AS mid FROM {mbo}"
)
#: Views of the oracle.
DUCKDB = {
    "mbo": f"SELECT event_id AS seq, epoch_us(ts) AS ts_us, CAST(CAST(json_extract_string(props, '$.k') AS INT) + 1 AS BIGINT) AS size, {_REST} FROM events",
    "quotes": _QUOTES.replace("{mbo}", "mbo"),
}


def from_events(events: DataFrame) -> DataFrame:
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    return events.select(F.col("event_id").alias("seq"), micros.alias("ts_us"), (F.get_json_object("props", "$.k").cast("int") + 1).cast("long").alias("size"), "user_id", "event_type", "event_id", "value").selectExpr("seq", "ts_us", "size", *select_list(_REST))


def select_list(text: str) -> list[str]:
    """The select list, cut at the commas that stand outside brackets."""
    out, depth, last = [], 0, 0
    for i, c in enumerate(text):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(text[last:i])
            last = i + 1
    return [*out, text[last:]]


def read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_events(spark.read.parquet(f"{sf_dir}/events.parquet"))


def quotes(spark: SparkSession, mbo: DataFrame) -> DataFrame:
    return spark.sql(_QUOTES, mbo=mbo)
