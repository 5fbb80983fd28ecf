"""Near duplicates by improved consistent weighted sampling over TF-IDF shingles.

1. Shingles are five words (a shorter text is one shingle), hashed to 64 bits.  Their weight is (1 + ln tf) * idf; idf
   is ln(1 + N / df), scaled to 1 for all shingles in at most `common` of the texts and at least `floor` for the rest.
   So only the frequent shingles need a df: lossy counting over all texts lists at most 4 (shingles of a text) / `common`
   of them, which are then counted exactly.
2. A text's sketch is 4 permutations of 16 bins: each shingle falls into one bin of each and the bin keeps the
   shingle with the least sampled value (r, c, beta of consistent weighted sampling come from the hash).  A band is one
   bin over the 4 permutations.
3. Texts of equal words are one node.  All nodes of a band of at most `small` are linked.  Those of a larger, hot band are
   first linked sparsely, within salted parts of the band and between the parts, which joins most near copies.
4. Linked pairs whose sketches agree by less than `least_agree` of 64 (over four standard deviations below the
   threshold) are left out; the others are verified by weighted Jaccard similarity over their whole texts.
5. Verified links are closed into classes by minimum labels with pointer jumping, each round written to the shared folder.
6. Nodes of hot bands that are in different classes by now are compared by their shingles (`missed`), with an exact prefix
   filter: pairs that share a shingle of few nodes meet there; all others share frequent shingles only, and meet by the
   lightest text of each set of these.  New verified links are closed again.

Edge cases: a null or empty text has no shingles; all such texts are one class; repeated rows join one class; a row
with a null doc_id gets the class of its text, which is null where no such text has an identifier; an empty table
gives no rows; other columns are left out.  Different texts under one doc_id are texts of their own, each in its own class.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bookloom.llm.common import as_bytes, id_filter, materialise, mix, passed, passing, span_hashes, text_slices, tidy, word_spans
from bookloom.llm.vocab import release

_U = np.uint64
SLICE = 1 << 19  # bytes of text hashed at once: some 40 MB of arrays
PERMUTATIONS, BINS = 4, 16
_ODD = [_U(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


@dataclass(frozen=True)
class Near:
    """Words of a shingle, similarity, share of texts above which a shingle counts as common, least idf, agreement, nodes of a part of a hot band, of a small band or shingle, of a block, frequent prefix shingles up to which a node carries their list, sums of a node's frequent weights."""

    words: int = 5
    similarity: float = 0.8
    common: float = 0.02
    floor: float = 0.5
    least_agree: int = 38
    part: int = 256
    small: int = 16
    block: int = 1000
    listed: int = 256
    sums: int = 256


def shingles(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int, np.ndarray]:
    """(owner, hash, tf) of the distinct shingles of each text in order, the number of texts, and a 128-bit digest of its words."""
    data, offsets = as_bytes(texts)
    n = len(offsets) - 1
    starts, ends, first = word_spans(data, offsets)
    h, words = span_hashes(data, starts, ends), np.diff(first)
    owner = np.repeat(np.arange(n, dtype=np.int64), words)
    place = (np.arange(len(h)) - first[owner]).astype(_U) if len(h) else h
    digest = np.zeros((n, 2), _U)
    for j in (0, 1):
        total = np.concatenate([[_U(0)], np.cumsum(mix(h * _ODD[j] + (place + _U(1)) * _ODD[j + 2]))])
        digest[:, j] = total[first[1:]] - total[first[:-1]]
    m = max(0, len(h) - k + 1)
    joined = np.zeros(m, _U)
    for j in range(k):
        joined += h[j : j + m] * _ODD[j % 5] * _U(2 * (j // 5) + 1)
    inside = owner[:m] == owner[k - 1 :] if m else np.zeros(0, bool)
    few = np.flatnonzero((words > 0) & (words < k))
    who, what = np.concatenate([owner[:m][inside], few]), np.concatenate([mix(joined[inside]), mix(digest[few, 0])])
    order = np.lexsort((what, who))
    who, what = who[order], what[order]
    begin = np.concatenate([[0], np.flatnonzero((who[1:] != who[:-1]) | (what[1:] != what[:-1])) + 1]) if len(who) else np.zeros(0, np.int64)
    return who[begin], what[begin], np.diff(begin, append=len(who)), n, digest


class Weights:
    """Frequent shingles in order with their idf; all others have idf 1."""

    def __init__(self, found: list[tuple[int, int]], n: int, how: Near):
        pairs = sorted((h % (1 << 64), df) for h, df in found)
        self.known = np.array([h for h, _ in pairs], _U)
        df = np.array([d for _, d in pairs], float)
        self.idf = np.clip(np.log1p(n / np.maximum(df, 1)) / np.log1p(1 / how.common), how.floor, 1.0)

    def of(self, what: np.ndarray, tf: np.ndarray) -> np.ndarray:
        w = 1 + np.log(tf)
        if len(self.known):
            at = np.minimum(np.searchsorted(self.known, what), len(self.known) - 1)
            w *= np.where(self.known[at] == what, self.idf[at], 1.0)
        return w


def common_shingles(docs: DataFrame, how: Near) -> Weights:
    """Document frequencies over all texts: lossy counting makes a short list, and a second pass counts what is on it.

    A slice leaves out what at most three quarters of `common` of its texts hold (nothing where that is less than a text),
    so a quarter of `common` of all texts is passed on for each common shingle.
    """
    lossy = 0.75

    @tidy
    def shortlist(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        held, n = [], 0

        def counted() -> pa.RecordBatch:
            found, count = np.unique(np.concatenate(held), return_counts=True)
            often = count > lossy * how.common * n
            return pa.RecordBatch.from_arrays([pa.array(found[often].view(np.int64)), pa.array(count[often])], ["h", "n"])

        for s in text_slices(batches, limit=SLICE):
            _, what, _, m, _ = shingles(s.column("text"), how.words)
            held, n = [*held, what], n + m
            if len(held) == 4:  # hashed one by one, which needs a quarter of the memory, and counted together
                yield counted()
                held, n = [], 0
        if held:
            yield counted()

    total, texts = docs.count(), docs.select("text")
    least = (1 - lossy) * how.common * total * (1 - 1e-9)
    listed = texts.mapInArrow(shortlist, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") > least).select("h").collect()
    known = np.sort(np.array([r["h"] for r in listed], np.int64).view(_U))
    if not len(known):
        return Weights([], total, how)

    @tidy
    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        counts = np.zeros(len(known), np.int64)
        for s in text_slices(batches, limit=SLICE):
            what = shingles(s.column("text"), how.words)[1]
            at = np.minimum(np.searchsorted(known, what), len(known) - 1)
            counts += np.bincount(at[known[at] == what], minlength=len(known))
        seen = counts > 0
        yield pa.RecordBatch.from_arrays([pa.array(known[seen].view(np.int64)), pa.array(counts[seen])], ["h", "n"])

    rows = texts.mapInArrow(exact, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") > how.common * total).collect()
    return Weights([(r["h"], r["n"]) for r in rows], total, how)


def sketches(who: np.ndarray, what: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """n x PERMUTATIONS x BINS samples of 32 bits; an empty bin has all bits set."""
    out = np.full((PERMUTATIONS, n * BINS), np.iinfo(np.uint64).max, _U)
    log_w = np.log(weight)
    scale = 2.0**-32
    low = _U(0xFFFFFFFF)
    for p in range(PERMUTATIONS):
        a = mix(what + _ODD[p] * _U(p + 1))
        b = mix(a ^ _ODD[4])
        c = mix(b + _ODD[p])
        r = -np.log(((a >> _U(32)) + _U(1)).astype(float) * scale * ((a & low) + _U(1)).astype(float) * scale) + 1e-12
        log_c = np.log(-np.log(((b >> _U(32)) + _U(1)).astype(float) * scale * ((b & low) + _U(1)).astype(float) * scale) + 1e-12)
        beta = (c >> _U(32)).astype(float) * scale
        t = np.floor(log_w / r + beta)
        value = (log_c - r * (t - beta) - r).astype(np.float32)
        bits = value.view(np.int32)
        ordered = np.where(bits < 0, ~bits, bits ^ np.int32(-(1 << 31))).view(np.uint32).astype(_U)
        sample = mix(what ^ (t.astype(np.int64).view(_U) * _ODD[3])) & low
        np.minimum.at(out[p], who * BINS + (c & _U(BINS - 1)).astype(np.int64), ordered << _U(32) | sample)
    return (out & low).reshape(PERMUTATIONS, n, BINS).transpose(1, 0, 2)


_BANDS, _SKETCH = [f"b{i}" for i in range(BINS)], [f"s{i}" for i in range(PERMUTATIONS * BINS // 8)]


def signatures(docs: DataFrame, weights: Weights, how: Near) -> DataFrame:
    """doc_id, d0, d1 (digest of the words), bands b0.. (null where empty), sketch s0.. (one byte of each sample)."""
    schema = T.StructType([docs.schema["doc_id"], *[T.StructField(c, T.LongType()) for c in ("d0", "d1", *_BANDS, *_SKETCH)]])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for s in text_slices(batches, limit=SLICE):
            who, what, tf, n, digest = shingles(s.column("text"), how.words)
            found = sketches(who, what, weights.of(what, tf), n)
            band = np.zeros((n, BINS), _U)
            for p in range(PERMUTATIONS):
                band = mix(band * _ODD[p] + found[:, p, :] + np.arange(BINS, dtype=_U) * _ODD[4])
            empty = (found == _U(0xFFFFFFFF)).all(1)
            packed = np.ascontiguousarray((found & _U(255)).astype(np.uint8).reshape(n, -1)).view(np.int64)
            columns = [digest[:, 0].view(np.int64).copy(), digest[:, 1].view(np.int64).copy()]
            yield pa.RecordBatch.from_arrays([s.column("doc_id"), *[pa.array(np.ascontiguousarray(c).view(np.int64)) for c in columns], *[pa.array(np.ascontiguousarray(band[:, i]).view(np.int64), mask=empty[:, i]) for i in range(BINS)], *[pa.array(np.ascontiguousarray(packed[:, i])) for i in range(packed.shape[1])]], schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def band_rows(nodes: DataFrame, how: Near) -> DataFrame:
    """key, node, two further bands n1, n2, an order o, `hot` (more than `small` nodes have the band) and a salt (a part of a hot band) of every band of two nodes or more."""
    bands = [F.struct(F.col(b).alias("key"), F.coalesce(F.col(_BANDS[(i + 1) % BINS]), F.lit(0)).alias("n1"), F.coalesce(F.col(_BANDS[(i + 6) % BINS]), F.lit(0)).alias("n2")) for i, b in enumerate(_BANDS)]
    rows = nodes.select("node", F.explode(F.array(*bands)).alias("x")).where("x.key is not null").select("x.key", "node", "x.n1", "x.n2", F.xxhash64("node").alias("o"))
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    salt = F.pmod(F.col("o"), F.ceil(F.col("m") / how.part).cast("long"))  # by the node: near copies share bands, not this
    return rows.join(sizes, "key").withColumns({"hot": F.col("m") > how.small, "salt": salt}).drop("m")


def links(rows: DataFrame) -> DataFrame:
    """Distinct pairs a < b of nodes that share a band: all pairs of a small band, at most 5 m of a hot one with m nodes.

    A hot band's nodes are salted and put in order by two further bands of theirs: like texts stand beside each other there.
    """
    few, salted = rows.where("not hot").select("key", "node"), rows.where("hot")

    def window(*order: str) -> Window:
        return Window.partitionBy("key", "salt").orderBy(*order, "o", "node")

    one = salted.select("key", "node", "o", F.first("node").over(window()).alias("head"), F.lag("node").over(window("n1")).alias("l1"), F.lag("node").over(window("n2")).alias("l2"))
    over = Window.partitionBy("key").orderBy("o", "node")
    two = one.where(F.col("head") == F.col("node")).select("key", "node", "o").select("node", F.first("node").over(over).alias("head"), F.lag("node").over(over).alias("l1"))
    pairs = one.select("node", F.explode(F.array("head", "l1", "l2")).alias("other")).unionByName(two.select("node", F.explode(F.array("head", "l1")).alias("other")))
    every = few.join(few.select("key", F.col("node").alias("other")), "key").where("node < other").select("node", "other")
    return pairs.unionByName(every).where("other <> node").select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()


def with_digest(rows: DataFrame, found: np.ndarray | None = None) -> DataFrame:
    """rows with d0, d1, the digest of the words of `text`; only those whose doc_id the bit map passes, if one is given."""
    schema = T.StructType([*rows.schema.fields, T.StructField("d0", T.LongType()), T.StructField("d1", T.LongType())])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in text_slices(batches if found is None else (passed(b, "doc_id", found) for b in batches), limit=SLICE):
            digest = shingles(s.column("text"), 5)[4]
            yield pa.RecordBatch.from_arrays([*s.columns, *[pa.array(np.ascontiguousarray(digest[:, i]).view(np.int64)) for i in (0, 1)]], schema.names)

    return rows.mapInArrow(run, schema)


@dataclass(frozen=True)
class Texts:
    """Documents, and nodes (node, rep, d0, d1): the text of a node is that of a document with its identifier, and with its digest where identifiers clash."""

    docs: DataFrame
    nodes: DataFrame
    clash: bool

    def of(self, ids: DataFrame, most: int) -> DataFrame:
        """doc_id (the node) and text of the nodes of ids (node), a text each; most texts are not shuffled."""
        asked = self.nodes.select("node", F.col("rep").alias("doc_id"), "d0", "d1").join(ids, "node", "left_semi")
        texts, found = self.docs.select("doc_id", "text"), id_filter(asked.select("doc_id"), most)
        if self.clash:
            met = with_digest(texts, found).join(asked, ["doc_id", "d0", "d1"])
        else:
            met = passing(texts, "doc_id", found).join(asked, "doc_id")
        return materialise(met.select(F.col("node").alias("doc_id"), "text").dropDuplicates(["doc_id"]), "texts")


def frequent_sums(frequent: DataFrame, how: Near) -> DataFrame:
    """node and the sums v (32-bit) of the weights of its shingles (node, h, w), dealt by their hash to `sums` places.

    The lesser of two nodes' sums, added over all places, is at least what they share.
    """

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            owner = np.repeat(np.arange(x.num_rows), pc.list_value_length(x.column("hs")).to_numpy(zero_copy_only=False).astype(np.int64))
            place = (mix(pc.list_flatten(x.column("hs")).to_numpy(zero_copy_only=False).view(_U)) % _U(how.sums)).astype(np.int64)
            total = np.bincount(owner * how.sums + place, pc.list_flatten(x.column("ws")).to_numpy(zero_copy_only=False), x.num_rows * how.sums).astype(np.float32)
            yield pa.RecordBatch.from_arrays([x.column("node"), pa.array([v.tobytes() for v in total.reshape(-1, how.sums)], pa.binary())], ["node", "v"])

    each = frequent.groupBy("node").agg(F.collect_list(F.struct("h", "w")).alias("x")).select("node", F.col("x.h").alias("hs"), F.col("x.w").alias("ws"))
    return materialise(each.mapInArrow(run, "node long, v binary"), "sums")


def missed(hot: DataFrame, source: Texts, weights: Weights, how: Near) -> DataFrame:
    """hot: node, label (its class so far), sketch.  Candidates (a, b) that connect all nodes of similarity enough.

    Shingles have one order, by how many of the nodes have them.  Two nodes of similarity t share t of the weight of
    either, so the first shingle that they share is in the prefix of both: the first shingles up to 1 - t of the weight.
    A rare one (`small` nodes at most) makes all pairs of its nodes.  If the first is frequent, all that they share is; with
    overlap o the similarity of x and y is o / (w(x) + w(y) - o), and of the nodes with the same frequent shingles as y, the
    lightest, v, is at least as similar to x; with u the lightest for x, so are u and v, and u and y: x - v - u - y is a
    chain.  So nodes are compared with the lightest ones only, in blocks of those with a frequent prefix shingle in common.
    A pair is passed on where the bound by sums of frequent weights lets it be similar enough: few others are verified.
    """
    texts = source.of(hot.select("node"), hot.count())
    schema = T.StructType([T.StructField("node", T.LongType()), T.StructField("h", T.LongType()), T.StructField("w", T.DoubleType())])

    @tidy
    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for s in text_slices(batches, limit=SLICE):
            who, what, tf, _, _ = shingles(s.column("text"), how.words)
            ids = s.column("doc_id").cast(pa.int64()).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(ids[who]), pa.array(what.view(np.int64)), pa.array(weights.of(what, tf))], schema.names)

    tokens = materialise(texts.mapInArrow(explode, schema), "tokens")
    shared = tokens.groupBy("h").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    own, often = Window.partitionBy("node"), F.col("df") > how.small
    ahead = own.orderBy("df", "h").rowsBetween(Window.unboundedPreceding, -1)
    ranked = tokens.join(shared, "h", "left").withColumn("df", F.coalesce("df", F.lit(1)))
    ranked = ranked.withColumns({"total": F.sum("w").over(own), "part": F.sum(F.when(often, F.col("w")).otherwise(0.0)).over(own), "set": F.bit_xor(F.when(often, F.xxhash64("h", "w"))).over(own), "before": F.coalesce(F.sum("w").over(ahead), F.lit(0.0))})
    ranked = materialise(ranked, "ranked")
    sums = frequent_sums(ranked.where(often), how)
    prefix = materialise(ranked.where((F.col("before") <= (1 - how.similarity + 1e-9) * F.col("total")) & (F.col("df") > 1)).select("node", "h", often.alias("often"), "total", "part", "set"), "prefix")

    rare = prefix.where("not often").join(hot.select("node", "label"), "node").select("h", "node", "label")
    other = rare.select("h", F.col("node").alias("b"), F.col("label").alias("label_b"))
    meet = rare.join(other, "h").where("node < b and label <> label_b").select(F.col("node").alias("a"), "b")

    heavy = prefix.where("often")
    lists = heavy.groupBy("node").agg(F.collect_list("h").alias("hs")).where(F.size("hs") <= how.listed)
    lightest = heavy.groupBy("set").agg(F.min_by("node", F.struct("total", "node")).alias("node")).select("node")
    salts = 8

    def blocks(rows: DataFrame, side: str) -> DataFrame:
        """h and the nodes, labels, weights (all, of frequent shingles), sketches, prefix lists (values, lengths) and sums of up to `block` of its rows."""

        @tidy
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for x in batches:
                h = x.column("h").to_numpy()
                cuts = np.concatenate([[0], np.flatnonzero(h[1:] != h[:-1]) + 1, [len(h)]]) if len(h) else [0]
                for begin, end in zip(cuts[:-1], cuts[1:]):
                    for at in range(begin, end, how.block):
                        y = x.slice(at, min(how.block, end - at))
                        columns = [np.ascontiguousarray(y.column(c).to_numpy()) for c in ("node", "label", "total", "part")]
                        sketch = np.stack([y.column(c).to_numpy() for c in _SKETCH], 1)
                        lists = [pc.list_flatten(y.column("hs")).to_numpy(zero_copy_only=False).astype(np.int64), pc.fill_null(pc.list_value_length(y.column("hs")), 0).to_numpy(zero_copy_only=False).astype(np.int64)]
                        held = [z.tobytes() for z in (*columns, sketch, *lists)] + [b"".join(y.column("v").to_pylist())]
                        yield pa.RecordBatch.from_arrays([pa.array([h[begin]]), *[pa.array([z], pa.binary()) for z in held]], ["h", *[f"{side}{i}" for i in range(8)]])

        dealt = rows.join(hot, "node").join(sums, "node").join(lists, "node", "left").select("h", "label", "node", "total", "part", *_SKETCH, "hs", "v").repartition("h", F.pmod(F.xxhash64("label", "node"), F.lit(salts))).sortWithinPartitions("h", "label", "node")
        return materialise(dealt.mapInArrow(run, "h long, " + ", ".join(f"{side}{i} binary" for i in range(8))), "blocks")

    @tidy
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (row for x in batches for at in range(x.num_rows) for row in x.slice(at, 1).to_pylist()):
            (a, la, wa, pa_, sa, va, na, ta), (b, lb, wb, pb, sb, vb, nb, tb) = ([np.frombuffer(row[f"{side}{i}"], {2: np.float64, 3: np.float64, 7: np.float32}.get(i, np.int64)) for i in range(8)] for side in "xy")
            if la[0] == lb[0] and (la == la[0]).all() and (lb == lb[0]).all():
                continue
            sa, sb = sa.view(np.uint8).reshape(len(a), -1), sb.view(np.uint8).reshape(len(b), -1)
            ta, tb = ta.reshape(len(a), -1), tb.reshape(len(b), -1)
            ends_a, ends_b = np.cumsum(na), np.cumsum(nb)
            for i in range(len(a)):
                # what two nodes share of frequent shingles is at most the lesser of what they have of them
                fits = np.flatnonzero((lb != la[i]) & (np.minimum(pa_[i], pb) * (1 + how.similarity) >= (how.similarity - 1e-9) * (wa[i] + wb)))
                fits = fits[(sb[fits] == sa[i]).sum(1) >= how.least_agree]
                if len(fits):
                    shared = np.minimum(ta[i], tb[fits]).sum(1, dtype=np.float64)
                    fits = fits[shared * (1 + how.similarity) >= (how.similarity - 1e-5) * (wa[i] + wb[fits])]
                # A pair that meets at several shingles is passed on at the least of them; nodes with very many carry no list.
                if len(fits) and na[i]:
                    own = frozenset(va[ends_a[i] - na[i] : ends_a[i]].tolist())
                    fits = fits[[not nb[j] or min(own.intersection(vb[ends_b[j] - nb[j] : ends_b[j]].tolist())) == row["h"] for j in fits]]
                if len(fits):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a[i], b[fits])), pa.array(np.maximum(a[i], b[fits]))], ["a", "b"])

    members = blocks(heavy, "x").withColumn("salt", F.pmod(F.xxhash64("x0"), F.lit(salts)))
    stars = blocks(heavy.join(lightest, "node", "left_semi"), "y").withColumn("salt", F.explode(F.array(*[F.lit(i).cast("long") for i in range(salts)])))
    met = members.join(stars, ["h", "salt"]).mapInArrow(compare, "a long, b long")
    return agreeing(meet.distinct(), hot, how).unionByName(met).distinct()


def agreeing(pairs: DataFrame, nodes: DataFrame, how: Near) -> DataFrame:
    """The pairs whose sketches agree often enough."""
    left = nodes.select(F.col("node").alias("a"), *[F.col(c).alias(f"a{c}") for c in _SKETCH])
    right = nodes.select(F.col("node").alias("b"), *[F.col(c).alias(f"b{c}") for c in _SKETCH])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            same = sum(((x.column(f"a{c}").to_numpy().view(np.uint8) == x.column(f"b{c}").to_numpy().view(np.uint8)).reshape(-1, 8).sum(1) for c in _SKETCH), np.zeros(x.num_rows, np.int64))
            yield x.select(["a", "b"]).filter(pa.array(same >= how.least_agree))

    return pairs.join(left, "a").join(right, "b").mapInArrow(run, pairs.schema)


def verified(pairs: DataFrame, source: Texts, weights: Weights, how: Near) -> DataFrame:
    """a, b, similarity of the pairs at or above the threshold, by their whole texts."""
    # written once: the nodes are read for the bit map and again for the texts
    asked = materialise(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "asked")
    texts = source.of(asked, asked.count())
    both = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    schema = T.StructType([*pairs.schema.fields, T.StructField("similarity", T.DoubleType())])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for x in text_slices(batches, "text_a", "text_b", limit=2 * SLICE):
            sides = [shingles(x.column(c), how.words) for c in ("text_a", "text_b")]
            who, what = np.concatenate([s[0] for s in sides]), np.concatenate([s[1] for s in sides])
            w = np.concatenate([weights.of(s[1], s[2]) for s in sides])
            order = np.lexsort((what, who))
            who, what, w = who[order], what[order], w[order]
            same = np.flatnonzero((who[1:] == who[:-1]) & (what[1:] == what[:-1]))
            met = np.bincount(who[same], np.minimum(w[same], w[same + 1]), x.num_rows)
            total = np.bincount(who, w, x.num_rows)
            s = met / np.maximum(total - met, 1e-12)
            keep = s >= how.similarity
            yield pa.RecordBatch.from_arrays([x.column("a").filter(pa.array(keep)), x.column("b").filter(pa.array(keep)), pa.array(s[keep])], schema.names)

    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, schema)


def components(edges: DataFrame) -> DataFrame:
    """node and the least node of its component, for all nodes of edges (a, b)."""
    both = materialise(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    labels = materialise(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("label")), "labels")
    while True:
        sent = both.join(labels, both["a"] == labels["node"]).groupBy(F.col("b").alias("node")).agg(F.min("label").alias("sent"))
        lower = labels.join(sent, "node", "left").select("node", "label", F.least("label", F.coalesce("sent", "label")).alias("low"))
        ahead = labels.select(F.col("node").alias("low"), F.col("label").alias("jump"))
        new = materialise(lower.join(ahead, "low", "left").select("node", F.least("low", F.coalesce("jump", "low")).alias("new"), "label"), "labels")
        changed = new.where("new <> label").limit(1).count()
        labels = new.select("node", F.col("new").alias("label"))
        if not changed:
            return labels


def _classes(docs: DataFrame, how: Near) -> tuple[DataFrame, bool]:
    """doc_id, d0, d1, class_id, kept, n_links of every row; do texts share an identifier?"""
    weights = common_shingles(docs, how)
    signed = materialise(signatures(docs, weights, how), "signatures")
    clash = not signed.where("doc_id is not null").groupBy("doc_id").agg((F.min(F.struct("d0", "d1")) != F.max(F.struct("d0", "d1"))).alias("x")).where("x").isEmpty()
    # A node is a text, named by a number of its own: identifiers may be those of several texts.
    nodes = signed.groupBy("d0", "d1").agg(F.min("doc_id").alias("rep"), *[F.min(c).alias(c) for c in (*_BANDS, *_SKETCH)])
    nodes = materialise(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    named = nodes.where("rep is not null")
    source = Texts(docs, named.select("node", "rep", "d0", "d1"), clash)
    rows = materialise(band_rows(named.select("node", *_BANDS), how), "bands")
    pairs = materialise(agreeing(links(rows), named, how), "pairs")
    edges = materialise(verified(pairs, source, weights, how), "verified")
    labels = components(edges)
    hot = rows.where("hot").select("node").distinct().join(named.select("node", *_SKETCH), "node").join(labels, "node", "left")
    hot = materialise(hot.withColumn("label", F.coalesce("label", "node")), "hot")
    if hot.limit(1).count():
        more = materialise(verified(materialise(missed(hot, source, weights, how), "missed"), source, weights, how), "verified")
        edges = edges.unionByName(more)
        labels = components(edges)
    ends = edges.select("a", "b").distinct().select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n_links"))
    heads = labels.join(named.select("node", "rep"), "node").groupBy("label").agg(F.min(F.struct("rep", "node")).alias("head"))
    known = nodes.select("d0", "d1", "node", "rep").join(labels.join(heads, "label").select("node", "head"), "node", "left").join(ends, "node", "left")
    head = F.coalesce("head", F.struct("rep", "node"))
    known = known.select("d0", "d1", head["rep"].alias("class_id"), (head["node"] == F.col("node")).alias("first"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    out = signed.select("doc_id", "d0", "d1").join(known, ["d0", "d1"])
    kept = F.col("first") & F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(False))
    return out.select("doc_id", "d0", "d1", "class_id", kept.alias("kept"), "n_links"), clash


def classes(docs: DataFrame, how: Near = Near()) -> DataFrame:
    """doc_id, class_id (the least doc_id of its class), kept (true for that document), n_links of every row.

    n_links counts the verified links between its text and other texts: all within small bands, what joins the class in hot ones.
    """
    return _classes(docs, how)[0].drop("d0", "d1")


def keep(docs: DataFrame, how: Near = Near()) -> DataFrame:
    """The rows of docs, all columns, that stand for their class; rows without a doc_id stay."""
    said, clash = _classes(docs, how)
    kept = said.where("kept")
    if clash:
        names = {c: F.col(c) for c in docs.columns}
        inner = docs.select(*[v.alias(f"x_{c}") if c in ("d0", "d1") else v for c, v in names.items()])
        rows = with_digest(inner).join(kept.select("doc_id", "d0", "d1"), ["doc_id", "d0", "d1"], "left_semi")
        stay = rows.select(*[F.col(f"x_{c}").alias(c) if c in ("d0", "d1") else F.col(c) for c in docs.columns])
    else:
        stay = docs.join(kept.select("doc_id"), "doc_id", "left_semi").select(*docs.columns)
    return stay.unionByName(docs.where("doc_id is null"))
