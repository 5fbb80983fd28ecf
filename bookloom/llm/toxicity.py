"""Toxicity of texts behind a noisy channel.

1. A character trigram model is counted over all texts (one vector of fixed size for each task is summed).
2. Words with digits or marks in the place of letters, with letters repeated, or spelled out in pieces of one or two
   characters with anything between them become a lattice of readings; a Viterbi search under the model restores the
   likeliest text.  So do neighbouring pieces of any length that are a word with odds cut in two or three.
3. Restored words and their beginnings get log odds from a bounded sample of labelled rows; the largest odds in a
   text and how many words have any are weighed by a logistic regression, fitted with the odds of the other half.
4. All texts are restored and scored.  A span is restored only if its letters, with repeats left out and each sign that may
   be left out both read and not, hold those of a word with odds: others cannot be restored to one, so nothing is lost.

Edge cases: a null or empty text has no words and gets the score of a text without any suspect word; without labels
the score is 0 for all; rows with a null doc_id are scored and not held out; repeated rows are scored each; spans of
any length are restored, those over `CACHED` characters anew each time; other columns are left out.
"""

from __future__ import annotations

import operator
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bookloom.llm.common import as_bytes, labelled_sample, materialise, sum_vectors, text_slices
from bookloom.llm.vocab import Cache, release

# Characters that stand for letters in disguised spelling.
READINGS = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l"}
#: Left out or kept as a border: all else that is no letter and no sign.
MAYBE = "!|+("
CACHED = 200
#: Costs (negative log probabilities) of the channel: a sign read as a letter, a separator or a repeated letter left out, a letter kept.
READ, LEFT_OUT, TWICE = 1.0, 0.4, 0.3
_N = 28  # 0 border, 1-26 letters, 27 other
_MARKS = "!\"#$%&()*+,-./:;<=>?[\\]^_`{|}~'"
_WORD = re.compile(r"[^ \t-\r]+")
_SPELLED = re.compile(r"(?<!\w)(?:[\w@$!|+(€£]{1,2}[^\w@$!|+(€£]{1,3}){2,}[\w@$!|+(€£]{1,2}(?!\w)")
_REPEATED = re.compile(r"([^\W\d_])\1")
_DISGUISED = re.compile(r"[^\W\d_].*[\W\d_]|[\W\d_].*[^\W\d_]", re.S)
_RUN = re.compile(r"(.)\1+", re.S)
_OTHER = re.compile(r"[\W\d_]+")
#: A sign beside a letter, of those that are always read.
_SURE = "[" + re.escape("".join(c for c in READINGS if c not in MAYBE)) + "]"
_SIGN = re.compile(f"(?<=[a-z]){_SURE}|{_SURE}(?=[a-z])")
# Signs by the letter that they stand for; i and l are one, as some signs stand for both.
_READ = {ord(k): ("i" if "l" in v else v) for k, v in READINGS.items()} | {ord("l"): "i"}
_LEFT = {k: v for k, v in _READ.items() if chr(k) not in MAYBE}
_CLASS = np.zeros(256, np.int64)
_CLASS[97:123] = _CLASS[65:91] = np.arange(1, 27)
_CLASS[128:] = 27


@dataclass(frozen=True)
class Fit:
    """Rows of the sample, least texts that a feature needs, least odds, most features."""

    most_rows: int = 12_000
    least_texts: int = 4
    least_odds: float = 1.5
    most_features: int = 50_000


def trigram_vector(texts: pa.Array) -> np.ndarray:
    """Counts of three neighbouring character classes; all that is no letter is a border, borders in a row are one."""
    data, offsets = as_bytes(texts)
    c = _CLASS[data]
    border = np.zeros(len(c), bool)
    border[offsets[:-1][offsets[:-1] < len(c)]] = True
    c = np.insert(c, np.flatnonzero(border), 0) if len(c) else c
    c = c[(c != 0) | np.concatenate([[True], c[:-1] != 0])] if len(c) else c
    if len(c) < 3:
        return np.zeros(_N**3, np.int64)
    return np.bincount((c[:-2] * _N + c[1:-1]) * _N + c[2:], minlength=_N**3)


def trigram_counts(docs: DataFrame) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_N**3, np.int64)
        release()
        for s in text_slices(batches):
            total += trigram_vector(s.column("text"))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["v"])

    return sum_vectors(docs.select("text").mapInArrow(run, "v binary"), _N**3)


def model(counts: np.ndarray) -> np.ndarray:
    """Negative log probability of the third class after two others, smoothed by the pair and the single class."""
    c = counts.reshape(_N, _N, _N).astype(float)
    one = (c.sum((0, 1)) + 1) / (c.sum() + _N)
    two = (c.sum(0) + 4 * one) / (c.sum((0, 2))[:, None] + 4)
    return -np.log((c + 4 * two[None]) / (c.sum(2, keepdims=True) + 4))


def _cls(ch: str) -> int:
    return ord(ch) - 96 if "a" <= ch <= "z" else 27 if ch.isalpha() else 0


def restore(noisy: str, cost: list) -> str:
    """The likeliest reading of a lower-case string: Viterbi over (last two classes), cost[a][b][c] from the model."""
    # A reading is (reading before, last letter): states share what they have in common, so time and memory are linear.
    states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
    for i, ch in enumerate(noisy):
        choices: list[tuple[str, float]] = []
        if ch.isalpha():
            choices.append((ch, 0.0))
            if i and noisy[i - 1] == ch:
                choices.append(("", TWICE))
        elif ch in READINGS:
            choices += [(r, READ) for r in READINGS[ch]]
            if i and noisy[i - 1] == ch:
                choices.append(("", TWICE))
        if not choices or ch in MAYBE:
            choices += [("", LEFT_OUT), (" ", 0.0)]
        new: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (total, text) in states.items():
            for out, price in choices:
                if out == "" or (out == " " and b == 0):
                    key, value, then = (a, b), total + price, text if out == "" else (text, out)
                else:
                    c = 0 if out == " " else _cls(out)
                    key, value, then = (b, c), total + price + cost[a][b][c], (text, out)
                if key not in new or value < new[key][0]:
                    new[key] = value, then
        states = new
    text = min(((total + cost[a][b][0] * (b != 0), text) for (a, b), (total, text) in states.items()), key=lambda x: x[0])[1]
    letters = []
    while text is not None:
        text, out = text
        letters.append(out)
    return "".join(reversed(letters)).strip()


class Restorer:
    def __init__(self, cost: np.ndarray):
        self.cost = cost.tolist()
        self.words = Cache(self.read, 100_000)

    def read(self, span: str) -> tuple[str, ...]:
        """The words that a disguised span stands for."""
        return tuple(restore(span, self.cost).split())

    def known(self, span: str) -> tuple[str, ...]:
        """What `read` gives; long spans hardly come again and are not kept."""
        return self.words[span] if len(span) <= CACHED else self.read(span)

    def span(self, span: str, may=lambda _: True) -> tuple[str, ...]:
        """Words of a span without white space, in lower case; `may` tells whether a reading is of use."""
        word = span.strip(_MARKS).lower()
        if word.isalpha() and not _REPEATED.search(word):
            return (word,)
        low = span.lower().rstrip(".,;:?\"')")
        if (_REPEATED.search(low) or _DISGUISED.search(low)) and may(low):
            return (word, *self.known(low))
        return (word,) if word else ()

    def text(self, text: str, may=lambda _: True) -> tuple[list[str], list[tuple[str, ...]]]:
        """The spans of a text, and the words of each stretch that is spelled out in pieces."""
        runs = (" ".join(m.group().lower().split()) for m in _SPELLED.finditer(text))
        return _WORD.findall(text), [self.known(r) for r in runs if may(r)]


def skeletons(text: str, most: int = 8) -> set[str] | None:
    """The letters that a lower-case text can be read as, without repeats: each sign that may be left out is read or left
    out, whatever the others are.  None: more than `most` such signs, so that its reading has to be looked at anyway."""
    signs = sum(map(text.count, MAYBE))
    if not signs:
        return {_RUN.sub(r"\1", _OTHER.sub("", text.translate(_READ)))}
    if signs > most:
        return None
    readings = [text.translate(_LEFT)]
    for _ in range(signs):
        at = next(i for i, c in enumerate(readings[0]) if c in MAYBE)
        readings = [r[:at] + x + r[at + 1 :] for r in readings for x in (_READ[ord(r[at])], " ")]
    return {_RUN.sub(r"\1", _OTHER.sub("", r)) for r in readings}


def features(word: str) -> list[str]:
    """The word, and its beginnings of 4 to 6 letters, marked by their length."""
    return [word, *[f"{k}:{word[:k]}" for k in (4, 5, 6) if len(word) >= k]]


class Scorer:
    """Odds of words; a text's row of numbers; its score."""

    def __init__(self, restorer: Restorer, odds: dict[str, float], weights: np.ndarray | None = None):
        self.restorer, self.odds, self.weights = restorer, odds, weights
        self.found, self.spans, self.begun, self.heads, self.whole, self.read, self.parts = None, None, None, None, None, None, None

    def __getstate__(self) -> dict:
        return {"restorer": self.restorer, "odds": self.odds, "weights": self.weights, **dict.fromkeys(("found", "spans", "begun", "heads", "whole", "read", "parts"))}

    def may(self, span: str) -> bool:
        """Can a reading of the span hold a word with odds, or its beginning?"""
        if self.found is None:
            self.found = ahocorasick.Automaton()
            for f in self.odds:
                for s in skeletons(f[2:] if f[1:2] == ":" and f[0] in "456" else f):
                    if s:
                        self.found.add_word(s, True)
            self.found.make_automaton()
        if not len(self.found):
            return False
        read = skeletons(span)
        return read is None or any(next(self.found.iter(s), None) for s in read)

    def cut(self, pieces: list[str]) -> set[str]:
        """Stretches of two or three lower-case pieces of any length that are a word with odds cut up, with signs in the place of
        letters too (of the signs that may be left out, three at most).  Words in more pieces are spelled out, and found as such."""
        if self.whole is None:
            words = {f for f in self.odds if f.isalpha()}
            self.whole = words | {x[:k] + x[k - 1 :] for x in words for k in range(1, len(x) + 1)}
            self.read = {_RUN.sub(r"\1", x.translate(_READ)) for x in words}
            self.parts = {x[:k] for x in self.whole for k in range(2, len(x) + 1)}
        out: set[str] = set()
        sums = list(map(operator.add, pieces, pieces[1:]))  # all neighbours of a text at once
        hits = self.parts.intersection(sums)
        for i in [i for i, x in enumerate(sums) if x in hits] if hits else ():
            for n in (2, 3):
                if "".join(pieces[i : i + n]) in self.whole:
                    out.add(" ".join(pieces[i : i + n]))
        joined = " ".join(pieces)
        i = begin = 0
        for m in _SIGN.finditer(joined):
            i, begin = i + joined.count(" ", begin, m.start()), m.start()
            for n in (2, 3):
                for k in range(max(0, i - n + 1), min(i, len(pieces) - n) + 1):
                    stretch = " ".join(pieces[k : k + n])
                    if len(stretch) < 64 and stretch not in out and not self.read.isdisjoint(skeletons(stretch, 3) or ()):
                        out.add(stretch)
        return out

    def word(self, w: str) -> float:
        if self.begun is None:  # odds of beginnings, and what the shortest of them begin with
            self.begun = {f[2:]: o for f, o in self.odds.items() if f[1:2] == ":" and f[0] in "456" and len(f) == 2 + int(f[0])}
            self.heads = {f[:4] for f in self.begun}
        o = self.odds.get(w, 0.0)
        return max(o, *[self.begun.get(w[:k], 0.0) for k in (4, 5, 6)]) if w[:4] in self.heads else o

    def odd(self, words: tuple[str, ...]) -> float:
        return max(map(self.word, words), default=0.0)

    def of(self, span: str) -> float:
        word = span.strip(_MARKS).lower()
        return self.word(word) if word.isalpha() and not _REPEATED.search(word) else self.odd(self.restorer.span(span, self.may))

    def rows(self, texts: list[str]) -> np.ndarray:
        if self.spans is None:  # odds of spans
            self.spans = Cache(self.of, 200_000)
        known = self.spans
        out = np.zeros((len(texts), 4))
        for i, text in enumerate(texts):
            spans, spelled = self.restorer.text(text, self.may)
            spelled += map(self.restorer.known, self.cut(text.lower().split()))
            found = [*map(known.__getitem__, set(spans)), *map(self.odd, set(spelled))]
            top = sorted(filter(None, found), reverse=True)
            out[i, : min(3, len(top))] = top[:3]
            out[i, 3] = np.log1p(len(top))
        return out

    def scores(self, texts: list[str]) -> np.ndarray:
        if self.weights is None:
            return np.zeros(len(texts))
        return 1 / (1 + np.exp(-np.clip(self.rows(texts) @ self.weights[1:] + self.weights[0], -30, 30)))


def regression(x: np.ndarray, y: np.ndarray, l2: float = 1.0) -> np.ndarray:
    """Logistic regression by Newton steps; the first weight is the constant."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    pull = np.diag([1e-3, *[l2] * (x.shape[1] - 1)])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= np.linalg.solve((x.T * (p * (1 - p))) @ x + pull, x.T @ (p - y) + pull @ w)
    return w


def train(docs: DataFrame, labels: DataFrame, how: Fit = Fit(), label: str = "toxic") -> Scorer:
    restorer = Restorer(model(trigram_counts(docs)))
    half = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(2)).cast("int").alias("half")
    sample = materialise(labelled_sample(docs, labels, label, 4, 2, how.most_rows).select("text", "y", half), "sample")

    def counting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for s in text_slices(batches):
            seen: Counter = Counter()
            for t, y, h in zip(s.column("text").to_pylist(), s.column("y").to_pylist(), s.column("half").to_pylist()):
                spans, spelled = restorer.text(t or "")
                words = {w for x in set(spans) for w in restorer.span(x)}.union(*spelled)
                seen.update((f, y, h) for f in {f for w in words for f in features(w)})
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen], pa.string()), pa.array([k[1] for k in seen], pa.int32()), pa.array([k[2] for k in seen], pa.int32()), pa.array(list(seen.values()), pa.int64())], ["feature", "y", "half", "n"])

    n = {(r["y"], r["half"]): r["count"] for r in sample.groupBy("y", "half").count().collect()}
    nt, nc = (sum(n.get((y, h), 0) for h in (0, 1)) for y in (1, 0))

    def of(y: int, h: int):
        return F.sum(F.when((F.col("y") == y) & (F.col("half") == h), F.col("n")).otherwise(0))

    counted = sample.mapInArrow(counting, "feature string, y int, half int, n long").groupBy("feature").agg(*[of(y, h).alias(f"n{y}{h}") for y in (0, 1) for h in (0, 1)])
    t, c = F.col("n10") + F.col("n11"), F.col("n00") + F.col("n01")
    whole = F.log((t + 0.5) / (nt + 1)) - F.log((c + 0.5) / (nc + 1))
    # Those of the greatest odds, and those which only a half has them for, are what the scorers below can use.
    strong = counted.where(t >= max(2, how.least_texts // 2)).orderBy(F.desc(whole), "feature").limit(how.most_features)
    seen = {r["feature"]: ((r["n10"], r["n11"]), (r["n00"], r["n01"])) for r in strong.collect()}

    def odds(halves: tuple[int, ...], least: int) -> dict[str, float]:
        nt, nc = (sum(n.get((y, h), 0) for h in halves) for y in (1, 0))
        out = {}
        for f, (t, c) in seen.items():
            t, c = sum(t[h] for h in halves), sum(c[h] for h in halves)
            o = np.log((t + 0.5) / (nt + 1)) - np.log((c + 0.5) / (nc + 1))
            if t >= least and o >= how.least_odds:
                out[f] = float(o)
        return out

    # Each half is weighed by the odds of the other, so that the weights see odds of texts they were not taken from.
    crossed = [Scorer(restorer, odds((1 - h,), max(2, how.least_texts // 2))) for h in (0, 1)]

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for s in text_slices(batches):
            texts, half = [t or "" for t in s.column("text").to_pylist()], s.column("half").to_numpy()
            rows = np.where(half[:, None] == 0, crossed[0].rows(texts), crossed[1].rows(texts))
            yield pa.RecordBatch.from_arrays([s.column("y"), pa.array(list(rows), pa.list_(pa.float64()))], ["y", "x"])

    scorer = Scorer(restorer, odds((0, 1), how.least_texts))
    rows = sample.mapInArrow(weigh, "y int, x array<double>").toPandas()
    if scorer.odds:
        scorer.weights = regression(np.stack(rows["x"].to_numpy()), rows["y"].to_numpy(float))
    return scorer


def score(docs: DataFrame, scorer: Scorer, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    schema = T.StructType([docs.schema["doc_id"], T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for s in text_slices(batches):
            yield pa.RecordBatch.from_arrays([s.column("doc_id"), pa.array(scorer.scores([t or "" for t in s.column("text").to_pylist()]))], ["doc_id", "score"])

    out = docs.select("doc_id", "text").mapInArrow(run, schema)
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep(docs: DataFrame, scorer: Scorer, threshold: float = 0.3) -> DataFrame:
    """The rows of docs, all columns, whose score is under the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for s in text_slices(batches):
            yield s.filter(pa.array(scorer.scores([t or "" for t in s.column("text").to_pylist()]) < threshold))

    return docs.mapInArrow(run, docs.schema)


def classify(docs: DataFrame, labels: DataFrame, how: Fit = Fit(), threshold: float = 0.3) -> DataFrame:
    return score(docs, train(docs, labels, how), threshold)
