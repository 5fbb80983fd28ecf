"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of a text (lengths, character classes, repetition, lines, common words) are taken with numpy on batches.
Trees are fitted on the driver on a bounded sample of labelled rows (`Fit.most_rows`), binned by quantiles, grown level by level
from gradient histograms, and flattened into arrays by heap position, so that a batch walks down all trees at once.

Edge cases: a null or empty text has all statistics 0 and gets a score like any other; without labels, or with one
class only, every score is the share of that class (0.5 without labels); null labels are left out; rows with a null doc_id are scored and
not held out; repeated rows are scored each; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bookloom.llm.common import as_bytes, labelled_sample, span_hashes, text_slices, word_spans
from bookloom.llm.quality_rules import vocabulary
from bookloom.llm.vocab import release


@dataclass(frozen=True)
class Fit:
    """Rows of the sample, trees, depth, bins, learning rate, L2 term, least hessian of a leaf."""

    most_rows: int = 12_000
    trees: int = 80
    depth: int = 5
    bins: int = 64
    rate: float = 0.12
    l2: float = 1.0
    least: float = 5.0


def _mask(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars.encode())] = True
    return out


_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_CLASSES = {
    "upper": _mask(_LETTERS.upper()), "lower": _mask(_LETTERS), "digit": _mask("0123456789"), "stop": _mask(".,;:?"), "shout": _mask("!"),
    "symbol": _mask("#*$%&|<>"), "code": _mask("{}[]()=_/\\@~^+-\"'`"), "beyond": np.arange(256) >= 128, "line": _mask("\n"),
}
FEATURES = [*_CLASSES, "bytes", "words", "word_length", "short", "long", "distinct", "adjacent", "top", "common", "capital", "closed", "windows", "same_lines", "line_bytes"]


def _groups(owner: np.ndarray, keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each owner the number of distinct keys and the count of its most frequent one."""
    if not len(keys):
        return np.zeros(n), np.zeros(n)
    order = np.lexsort((keys, owner))
    o, k = owner[order], keys[order]
    begin = np.concatenate([[0], np.flatnonzero((o[1:] != o[:-1]) | (k[1:] != k[:-1])) + 1])
    most = np.zeros(n)
    np.maximum.at(most, o[begin], np.diff(begin, append=len(o)))
    return np.bincount(o[begin], minlength=n).astype(float), most


def statistics(texts: pa.Array) -> np.ndarray:
    """A row of FEATURES for each text."""
    data, offsets = as_bytes(texts)
    n = len(offsets) - 1
    starts, ends, first = word_spans(data, offsets)
    words = np.diff(first).astype(float)
    owner = np.repeat(np.arange(n), np.diff(first))
    size, per_word = np.maximum(np.diff(offsets), 1).astype(float), np.maximum(words, 1)

    def each(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return np.diff(total[offsets]).astype(float)

    out = {k: each(m[data]) / size for k, m in _CLASSES.items()}
    hashes, length = span_hashes(data, starts, ends), ends - starts
    distinct, most = _groups(owner, hashes, n)
    by_word = lambda x: np.bincount(owner, x, n) / per_word
    same = np.zeros(len(hashes), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    names = [w.encode() for w in vocabulary()]
    flat = np.frombuffer(b"".join(names), np.uint8)
    to = np.cumsum([len(w) for w in names])
    common = np.isin(hashes, span_hashes(flat, np.concatenate([[0], to[:-1]]), to))
    out |= {"bytes": np.log1p(np.diff(offsets)), "words": np.log1p(words), "word_length": by_word(length), "short": by_word(length <= 2), "long": by_word(length >= 14), "distinct": distinct / per_word, "adjacent": by_word(same), "top": most / per_word, "common": by_word(common)}
    out |= {"capital": by_word(_CLASSES["upper"][data[starts]]) if len(starts) else np.zeros(n), "closed": by_word((_CLASSES["stop"] | _CLASSES["shout"])[data[ends - 1]]) if len(starts) else np.zeros(n)}
    if len(hashes) > 2:
        inside = owner[2:] == owner[:-2]
        three = (hashes[:-2] * np.uint64(3) + hashes[1:-1] * np.uint64(0x9E3779B97F4A7C15) + hashes[2:] * np.uint64(0xC2B2AE3D27D4EB4F))[inside]
        windows, _ = _groups(owner[2:][inside], three, n)
        out["windows"] = windows / np.maximum(words - 2, 1)
    else:
        out["windows"] = np.zeros(n)
    breaks = np.flatnonzero(_CLASSES["line"][data])
    line_start = np.union1d(offsets[:-1][np.diff(offsets) > 0], breaks[breaks + 1 < len(data)] + 1) if len(data) else np.zeros(0, np.int64)
    line_owner = np.searchsorted(offsets, line_start, side="right") - 1
    line_end = np.concatenate([line_start[1:], [len(data)]]) if len(line_start) else line_start
    lines = np.bincount(line_owner, minlength=n).astype(float)
    different, _ = _groups(line_owner, span_hashes(data, line_start, line_end), n) if len(line_start) else (np.zeros(n), 0)
    out |= {"same_lines": 1 - different / np.maximum(lines, 1), "line_bytes": np.log1p(np.diff(offsets) / np.maximum(lines, 1))}
    return np.column_stack([out[k] for k in FEATURES])


@dataclass
class Trees:
    """Heap-ordered nodes of all trees: child of i is 2i + 1, or 2i + 2 where x > threshold."""

    base: float
    depth: int
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        if len(self.leaf) and len(x):
            tree, at = np.arange(len(self.leaf)), np.zeros((len(x), len(self.leaf)), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (np.take_along_axis(x, self.feature[tree, at], 1) > self.threshold[tree, at])
            total += self.leaf[tree, at - (2**self.depth - 1)].sum(1)
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, how: Fit = Fit()) -> Trees:
    """Boosted trees for the logistic loss."""
    inner, none = 2**how.depth - 1, Trees(0.0, how.depth, *[np.zeros((0, 1))] * 3)
    if not len(y) or y.min() == y.max():
        none.base = 0.0 if not len(y) else 30.0 * (2 * float(y[0]) - 1)
        return none
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, how.bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)])
    n, m = binned.shape
    base = float(np.log(y.mean() / (1 - y.mean())))
    score, feature, threshold, leaf = np.full(n, base), [], [], []
    flat = binned + np.arange(m) * how.bins
    for _ in range(how.trees):
        p = 1 / (1 + np.exp(-score))
        g, h = p - y, p * (1 - p)
        f, t, at = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(n, np.int64)
        for level in range(how.depth):
            nodes, low = 2**level, 2**level - 1
            key = ((at - low)[:, None] * (m * how.bins) + flat).ravel()
            sums = [np.bincount(key, np.repeat(v, m), nodes * m * how.bins).reshape(nodes, m, how.bins).cumsum(2) for v in (g, h)]
            (gl, hl), (gt, ht) = sums, (s[:, :, -1:] for s in sums)
            gain = gl**2 / (hl + how.l2) + (gt - gl) ** 2 / (ht - hl + how.l2) - gt**2 / (ht + how.l2)
            gain[(hl < how.least) | (ht - hl < how.least)] = -1
            best = gain.reshape(nodes, -1).argmax(1)
            for k in range(nodes):
                j, cut = divmod(int(best[k]), how.bins)
                if gain[k, j, cut] > 1e-6 and cut < len(edges[j]):
                    f[low + k], t[low + k] = j, edges[j][cut]
            at = 2 * at + 1 + (x[np.arange(n), f[at]] > t[at])
        where = at - inner
        value = -how.rate * np.bincount(where, g, inner + 1) / (np.bincount(where, h, inner + 1) + how.l2)
        score += value[where]
        feature.append(f), threshold.append(t), leaf.append(value)
    return Trees(base, how.depth, np.array(feature), np.array(threshold), np.array(leaf))


def train(docs: DataFrame, labels: DataFrame, how: Fit = Fit(), label: str = "quality") -> Trees:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for s in text_slices(batches):
            yield pa.RecordBatch.from_arrays([s.column("y"), pa.array(list(statistics(s.column("text"))), pa.list_(pa.float64()))], ["y", "x"])

    sample = labelled_sample(docs, labels, label, 3, 1, how.most_rows).select("doc_id", "text", "y")
    rows = sample.mapInArrow(run, "y int, x array<double>").toPandas()
    if not len(rows):
        return fit(np.zeros((0, 1)), np.zeros(0), how)
    x, y = np.stack(rows["x"].to_numpy()), rows["y"].to_numpy(float)
    order = np.lexsort([*x.T, y])  # the order in which rows arrive changes nothing
    return fit(x[order], y[order], how)


def score(docs: DataFrame, trees: Trees) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    schema = T.StructType([docs.schema["doc_id"], T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for s in text_slices(batches):
            yield pa.RecordBatch.from_arrays([s.column("doc_id"), pa.array(trees.scores(statistics(s.column("text"))))], ["doc_id", "score"])

    out = docs.select("doc_id", "text").mapInArrow(run, schema)
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep(docs: DataFrame, trees: Trees, threshold: float = 0.5) -> DataFrame:
    """The rows of docs, all columns, whose score is at least the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for s in text_slices(batches):
            yield s.filter(pa.array(trees.scores(statistics(s.column("text"))) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def classify(docs: DataFrame, labels: DataFrame, how: Fit = Fit()) -> DataFrame:
    return score(docs, train(docs, labels, how))
