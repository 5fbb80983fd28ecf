"""A relational operator: one SQL statement over order events, with its thresholds as parameters.

Statements use what Spark SQL and the oracle's dialect share.  Plain decimals are doubles; ORD is the total order of
events within a symbol, MEDIAN(x) and QUANTILE(x, q) interpolate.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from bookloom.operators import book
from bookloom.sources import mbo as source

_DECIMAL = re.compile(r"(?<![\w.])(\d+\.\d+)(?![\w.])")


def _doubles(sql: str) -> str:
    return _DECIMAL.sub(r"\1e0", sql)


@dataclass(frozen=True)
class Operator:
    """name, statement with {mbo}, {quotes}, {book} (at the times of {step}) or a table's name in braces, defaults as the reference has them, values for the driver's tables."""

    name: str
    sql: str
    defaults: dict[str, float] = field(default_factory=dict)
    scaled: dict[str, float] = field(default_factory=dict)

    def statement(self, **params: float) -> str:
        values = {**self.defaults, **params}
        if bad := [k for k, v in values.items() if not isinstance(v, (int, float)) and not re.fullmatch(r"\w+", str(v))]:
            raise ValueError(f"not plain values: {bad}")
        text = self.sql
        for k, v in values.items():
            text = text.replace("{" + k + "}", str(v))
        return _doubles(text)

    def tables(self) -> list[str]:
        return sorted(set(re.findall(r"\{(\w+)\}", self.statement())))

    def apply(self, spark: SparkSession, tables: dict[str, DataFrame], **params: float) -> DataFrame:
        text = re.sub(r"\bORD\b", "struct(ts_us, seq)", self.statement(**params)).replace("MEDIAN(", "percentile(0.5D, ")
        text = re.sub(r"percentile\(0\.5D, (\w+)\)", r"percentile(\1, 0.5D)", text).replace("QUANTILE(", "percentile(")
        return spark.sql(text, **{t: tables[t] for t in self.tables()})

    def query(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        """The operator over the driver's tables."""
        found: dict[str, DataFrame] = {}
        for t in self.tables():
            if t == "mbo":
                found[t] = source.read(spark, sf_dir)
            elif t == "quotes":
                found[t] = source.quotes(spark, source.read(spark, sf_dir))
            elif t == "book":
                found[t] = book.book(source.read(spark, sf_dir), {**self.defaults, **self.scaled}["step"])
            else:
                found[t] = spark.read.parquet(f"{sf_dir}/{t}.parquet")
        return self.apply(spark, found, **self.scaled)

    def oracle(self) -> str:
        text = re.sub(r"\bORD\b", "row(ts_us, seq)", self.statement(**self.scaled)).replace("MEDIAN(", "quantile_cont(0.5, ")
        text = re.sub(r"quantile_cont\(0\.5, (\w+)\)", r"quantile_cont(\1, 0.5)", text).replace("QUANTILE(", "quantile_cont(")
        used, step = self.tables(), {**self.defaults, **self.scaled}.get("step")
        views = ["mbo"] * bool({"mbo", "quotes", "book"} & set(used)) + [v for v in ("quotes", "book") if v in used]
        for t in used:
            text = text.replace("{" + t + "}", t)
        heads = ", ".join(f"{v} AS ({book.sql(step) if v == 'book' else source.DUCKDB[v]})" for v in views)
        if not heads:
            return text
        return f"WITH {heads}, {text[5:]}" if text.startswith("WITH ") else f"WITH {heads} {text}"
