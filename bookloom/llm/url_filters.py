"""URL filters: explicit rules first, else a tree of path templates for each host.

Paths of a host are read level by level, down to the deepest.  At a level, the branches of a node get their labelled purity,
drawn towards that of all branches by `branch_prior` (so few labels do not set a branch apart), and the interval of it that
they fall into (equal steps of arcsin(sqrt), in which the error does not depend on the purity).  A branch that few of its
siblings' urls share becomes a wildcard (its file ending stays) if its interval is that of all together; other branches of
one interval are merged, and a branch alone in its interval stays.  What is left is a template; it is rejected when
its labelled purity, smoothed towards its host and that towards all hosts, is under a limit.

Labels: those that the caller gives by page_id, else the verdicts of the explicit rules (what no rule blocks is presumed
good), so that urls of a template that the rules block for the most part go too.
All counts are sums over distinct paths, pre-aggregated before any shuffle, and the siblings of a node and the paths of
a template are dealt over salts where they meet their sums (`dealt_join`).

Edge cases: a null url or one without "://" has an empty host and path, and is judged as a host of its own; a path that
is alone under its node is its own template at once; without labels nothing is rejected; repeated rows are judged each; a null page_id has no
label of the caller's; an empty table gives no rows; other columns are left out.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookloom.llm.common import materialise

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class Tree:
    """Least siblings and share for wildcards, intervals of purity, weight of the priors of a branch and of a template, least purity, salts."""

    siblings: int = 8
    share: float = 0.02
    intervals: int = 6
    branch_prior: float = 4.0
    prior: float = 8.0
    purity: float = 0.5
    salts: int = 8


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), "^[^?#]*", 0)
    return F.coalesce(F.translate(host, _UPPER, _LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def matching_rule(rules: list[Rule], value) -> Column:
    """`value` of the longest rule that fits host and path, else null; a handful of rules is one expression."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path)
        out = F.when(fits, F.lit(value(r))).otherwise(out)
    return out


def dealt_join(left: DataFrame, right: DataFrame, keys: list[str], salts: int) -> DataFrame:
    """left joined to the one row of right with its keys (null where there is none); many rows of a key are dealt over the salts."""
    every = right.withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(salts)])))
    return left.withColumn("salt", F.pmod(F.xxhash64(*left.columns), F.lit(salts)).cast("int")).join(every, [*keys, "salt"], "left").drop("salt")


def _interval(purity: Column, how: Tree) -> Column:
    return F.least(F.floor(F.asin(F.sqrt(purity)) / (math.pi / 2) * how.intervals), F.lit(how.intervals - 1)).cast("int")


def templates(paths: DataFrame, how: Tree) -> DataFrame:
    """paths: host, path, segments, n, labelled, bad.  Adds `template`, the generalised path."""
    sums = ("n", "labelled", "bad")
    state = materialise(paths.withColumn("template", F.lit("")), "paths")
    done, d = [], 0
    while True:
        done.append(state.where(F.size("segments") <= d).drop("segments"))
        active = state.where(F.size("segments") > d).withColumns({"above": F.col("template"), "seg": F.get("segments", F.lit(d))})
        if not active.limit(1).count():
            return reduce(DataFrame.unionByName, done)
        nodes = materialise(active.groupBy("host", "above", "seg").agg(F.count(F.lit(1)).alias("paths"), *[F.sum(c).alias(c) for c in sums]), "nodes")
        total = nodes.groupBy("host", "above").agg(F.count(F.lit(1)).alias("kids"), F.sum("paths").alias("all_paths"), *[F.sum(c).alias(f"all_{c}") for c in sums])
        share = (F.col("all_bad") + 0.5) / (F.col("all_labelled") + 1)
        found = dealt_join(nodes, total, ["host", "above"], how.salts)
        found = found.withColumn("k", _interval((F.col("bad") + how.branch_prior * share) / (F.col("labelled") + how.branch_prior), how))
        rare = (F.col("kids") >= how.siblings) & (F.col("n") < F.greatest(F.lit(3.0), how.share * F.col("all_n")))
        found = found.withColumn("wild", rare & (F.col("k") == _interval(share, how)))
        alike = found.where("not wild").groupBy("host", "above", "k").agg((F.count(F.lit(1)) > 1).alias("merged"))
        found = dealt_join(found, alike, ["host", "above", "k"], how.salts)
        ending = F.regexp_extract("seg", r"\.[A-Za-z0-9]{1,5}$", 0)
        mark = F.when(F.col("wild"), F.concat(F.lit("*"), ending)).when(F.col("merged"), F.concat(F.lit("+"), F.col("k").cast("string"))).otherwise(F.col("seg"))
        marks = found.select("host", "above", "seg", mark.alias("mark"), (F.col("all_paths") == 1).alias("alone"))
        joined = dealt_join(active, marks, ["host", "above", "seg"], how.salts)
        rest = F.array_join(F.slice("segments", d + 1, F.size("segments")), "/")
        state = joined.select("host", "path", F.when(F.col("alone"), F.slice("segments", 1, d + 1)).otherwise(F.col("segments")).alias("segments"), *sums, F.concat("template", F.lit("/"), F.when(F.col("alone"), rest).otherwise(F.col("mark"))).alias("template"))
        state, d = materialise(state, "paths"), d + 1


def judge(pages: DataFrame, rules: list[Rule], labels: DataFrame | None = None, how: Tree = Tree()) -> DataFrame:
    """pages: page_id, url; labels: page_id, bad (0 or 1).  page_id, host, path, rule, verdict, template, purity of every row."""
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    ruled = matching_rule(rules, lambda r: r.verdict)
    if labels is None:
        marked = rows.withColumn("bad", F.when(ruled == "block", 1).otherwise(0).cast("long"))
    else:
        marked = rows.join(labels.where(F.col("bad").isNotNull()).groupBy("page_id").agg(F.max("bad").cast("long").alias("bad")), "page_id", "left")
    paths = marked.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.count("bad").alias("labelled"), F.coalesce(F.sum("bad"), F.lit(0)).cast("long").alias("bad"))
    named = templates(paths.withColumn("segments", F.filter(F.split("path", "/"), lambda x: x != "")), how)
    by_template = named.groupBy("host", "template").agg(*[F.sum(c).alias(c) for c in ("labelled", "bad")])
    by_host = named.groupBy("host").agg(*[F.sum(c).alias(f"host_{c}") for c in ("labelled", "bad")])
    all_labelled, all_bad = named.agg(F.coalesce(F.sum("labelled"), F.lit(0)), F.coalesce(F.sum("bad"), F.lit(0))).first()
    everywhere = (all_labelled - all_bad + 1) / (all_labelled + 1)
    host_purity = (F.col("host_labelled") - F.col("host_bad") + how.prior * everywhere) / (F.col("host_labelled") + how.prior)
    purity = (F.col("labelled") - F.col("bad") + how.prior * host_purity) / (F.col("labelled") + how.prior)
    judged = dealt_join(by_template, by_host, ["host"], how.salts).select("host", "template", purity.alias("purity"))
    keys = dealt_join(named.select("host", "path", "template"), judged, ["host", "template"], how.salts)
    out = rows.join(keys, ["host", "path"], "left")
    own = F.when(F.col("purity") < how.purity, F.lit("block")).otherwise(F.lit("allow"))
    return out.select("page_id", "host", "path", matching_rule(rules, lambda r: r.text).alias("rule"), F.coalesce(ruled, own).alias("verdict"), "template", "purity")
