"""Exact dedup by content sort, DataFrame functions only.

Splitters drawn from a sample of all rows cut the order of (normalised text, doc_id) into parts of similar size;
because the identifier is in the key, a text with very many copies is cut into several parts too.  Within a part an
external sort places equal texts adjacent and each row is compared in full with its neighbour.  A run of equal texts
can only be cut where a splitter lies, so the runs to be joined across parts are at most as many as there are
splitters and parts: the heads of those few, and only those, are compared in full, and what they sum to is broadcast by (part, run).

Edge cases: a null text counts as empty; rows with equal doc_id stay separate rows, and of equal texts the one
smallest doc_id stays (all its repeated rows are marked as not kept but one); null identifiers sort last and stay
only where a text has no other; an empty table gives no rows; other columns are left out.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bookloom.llm.common import SPACE_RE


@dataclass(frozen=True)
class Plan:
    """Parts for each shuffle partition, the most parts of all, sampled rows for each part, characters of a splitter."""

    per_partition: int = 3
    most_parts: int = 20_000
    sample_per_part: int = 24
    prefix: int = 48


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE_RE, " ")


def _id_key(doc_id: Column) -> Column:
    """doc_id as text of one length that sorts as the number does; null last."""
    return F.coalesce(F.lpad(F.hex(doc_id.cast("long").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0"), F.lit("g"))


def _sort_key(prefix: int) -> Column:
    return F.concat_ws("\u0000", F.substring("norm", 1, prefix), F.col("text_sha256"), _id_key(F.col("doc_id")))


def splitters(rows: DataFrame, parts: int, plan: Plan) -> list[str]:
    """At most parts - 1 keys at even steps of a sample; its size has the bound most_parts * sample_per_part."""
    total = rows.count()
    want = parts * plan.sample_per_part
    step = max(1, total // max(1, want))
    keys = rows.where(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(step)) == 0) if step > 1 else rows
    found = sorted(r[0] for r in keys.select(_sort_key(plan.prefix).alias("k")).orderBy(F.xxhash64("k"), "k").limit(4 * want).collect())
    return sorted({found[i * len(found) // parts] for i in range(1, parts)}) if found else []


def _part_of(key: Column, cuts: list[str]) -> Column:
    """How many cuts are at or below the key, by binary search."""
    if not cuts:
        return F.lit(0)
    table = F.lit(cuts)
    start = F.struct(F.lit(0).alias("lo"), F.lit(len(cuts)).alias("hi"))

    def step(s: Column, _: Column) -> Column:
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        go = (s["lo"] < s["hi"]) & (F.get(table, mid) <= key)
        return F.struct(F.when(go, mid + 1).otherwise(s["lo"]).alias("lo"), F.when(go | (s["lo"] >= s["hi"]), s["hi"]).otherwise(mid).alias("hi"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(len(cuts).bit_length() + 1)), start, step)["lo"]


def dedup(docs: DataFrame, plan: Plan = Plan(), carry: bool = False) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row; with `carry` also the row itself."""
    spark = docs.sparkSession
    more = ["row"] if carry else []
    rows = docs.select("doc_id", normalised(F.col("text")).alias("norm")).select("doc_id", "norm", F.sha2("norm", 256).alias("text_sha256"))
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = splitters(rows, min(plan.most_parts, plan.per_partition * partitions), plan)
    part = _part_of(_sort_key(plan.prefix), cuts).alias("part")
    if carry:  # the text travels once, within the row
        whole = docs.select("doc_id", F.struct(*docs.columns).alias("row"), normalised(F.col("text")).alias("norm")).withColumn("text_sha256", F.sha2("norm", 256))
        placed = whole.select("doc_id", "text_sha256", "row", part).repartition(partitions, "part").withColumn("norm", normalised(F.col("row.text")))
    else:
        placed = rows.select("doc_id", "norm", "text_sha256", part).repartition(partitions, "part")

    # Within a part: equal texts are adjacent, identifiers ascend, null ones last.
    order = Window.partitionBy("part").orderBy("norm", F.col("doc_id").asc_nulls_last())
    first = F.coalesce(F.col("norm") != F.lag("norm").over(order), F.lit(True))
    cut = F.col("text_sha256").isin(sorted({c.split("\u0000")[-2] for c in cuts})) if cuts else F.lit(False)
    marked = placed.select("doc_id", "text_sha256", "part", *more, F.row_number().over(order).alias("at"), first.alias("first"), F.when(first & cut, F.col("norm")).alias("head"))
    begun = Window.partitionBy("part").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    runs = marked.withColumn("run", F.max(F.when(F.col("first"), F.col("at"))).over(begun))
    whole = Window.partitionBy("part", "run")
    local = runs.select("doc_id", "text_sha256", *more, "part", "run", "head", "first", F.min("doc_id").over(whole).alias("run_id"), F.count(F.lit(1)).over(whole).alias("run_size"))
    heads = local.where("head is not null").groupBy("text_sha256", "head").agg(F.min("run_id").alias("all_id"), F.sum("run_size").alias("all_size"), F.collect_list(F.struct("part", "run")).alias("runs"))
    joined = heads.select(F.explode("runs").alias("at"), "all_id", "all_size").select("at.part", "at.run", "all_id", "all_size")
    out = local.join(F.broadcast(joined), ["part", "run"], "left")
    keep = F.coalesce("all_id", "run_id")
    kept = F.col("first") & (F.col("doc_id").eqNullSafe(keep))
    return out.select("doc_id", keep.alias("keep_id"), F.coalesce("all_size", "run_size").cast("long").alias("group_size"), kept.alias("kept"), "text_sha256", *more)


def keep(docs: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """The rows of docs, all columns, that stay."""
    return dedup(docs, plan, carry=True).where("kept").select("row.*")
