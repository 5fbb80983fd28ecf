"""Sinks of streams and tables: every batch in a folder of its own, named by the batch, so that a batch written again replaces itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def commit(df: DataFrame, batch: int, path: str, fmt: str = "json") -> None:
    """Write the rows of a batch, in one action; doing so again leaves one copy."""
    df.write.mode("overwrite").format(fmt).save(f"{path}/batch={batch}")


def start(stream: DataFrame, path: str, checkpoint: str, fmt: str = "json", **trigger) -> StreamingQuery:
    """Outcomes as JSON lines, candidates as Parquet: the stream's batches under their numbers."""
    return stream.writeStream.foreachBatch(lambda df, batch: commit(df, batch, path, fmt)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def read(spark: SparkSession, path: str, schema: StructType | str, fmt: str = "json") -> DataFrame:
    """All rows that were committed."""
    full = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    return spark.read.schema(full).format(fmt).option("recursiveFileLookup", "true").load(path)


def append_calibration(calibration: DataFrame, path: str, version: int) -> None:
    """symbol, day_us and whatever else of a calibration run; a version written again replaces itself."""
    commit(calibration, version, path, "parquet")


def latest_calibration(spark: SparkSession, path: str) -> DataFrame:
    """For each symbol its row of the last day; of several versions of that day, the last."""
    rows = spark.read.parquet(path)
    best = rows.groupBy("symbol").agg(F.max_by(F.struct(*rows.columns), F.struct("day_us", "batch")).alias("x"))
    return best.select("x.*").drop("batch")
