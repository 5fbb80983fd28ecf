"""Language identification, word first: a known word scores by its log frequency in each language, an unseen one by
character n-grams, the longest order of which any is known, down to single letters.

Words are runs of letters (with their marks) of the lower-cased NFC text.  All open documents are counted: each task adds
up its words by language, one shuffle makes the table of words, and the n-grams of ` word ` come from that table, weighted
by its counts.  A word is known if it is at least L / most of all words of one of the L languages, and likewise an
n-gram of those of its order: so the model has at most `most` entries an order at every size of corpus, and each entry
is a share, not a count.  A share under a tenth of that limit counts as that tenth.

A text's language is that of the greatest sum over its words, and its score the posterior of that language under equal
priors; of equal sums the language with more words in training comes first, then the name.

Edge cases: null texts and texts without a letter are `und` with score 0, and so is every text if nothing could be
learned; a text of letters never seen in training gets the first language, score 1 / L; a null doc_id is never learned
from, and not held out; texts of any length are read whole; repeated rows are judged each and learned from each;
further columns are left out.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bookloom.llm.common import materialise, text_slices
from bookloom.llm.vocab import once

UNKNOWN = "und"
_ASCII = re.compile("[a-z]+")
_LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*")


def words(text: str) -> list[str]:
    if text.isascii():
        return _ASCII.findall(text.lower())
    return _LETTERS.findall(unicodedata.normalize("NFC", text).lower())


def held_out(modulus: int = 4, remainder: int = 2) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(modulus)) == remainder, F.lit(False))


def _tally(counts: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
    """The counts in batches; they start anew."""
    for lang, found in counts.items():
        pieces, numbers = list(found), list(found.values())
        for i in range(0, len(pieces), 50_000):
            part = pieces[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part)), pa.array(part, pa.string()), pa.array(numbers[i : i + 50_000], pa.int64())], ["lang", "piece", "n"])
    counts.clear()


def count_words(docs: DataFrame, room: int = 400_000) -> DataFrame:
    """lang, piece, n: how often each word stands in the texts of a language; a task holds `room` different words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}
        for s in text_slices(batches):
            for text, lang in zip(s.column("text").to_pylist(), s.column("lang").to_pylist()):
                counts.setdefault(lang, Counter()).update(words(text))
            if sum(map(len, counts.values())) > room:
                yield from _tally(counts)
        yield from _tally(counts)

    rows = docs.where("text is not null and lang is not null").select("text", F.col("lang").cast("string"))
    return rows.mapInArrow(run, "lang string, piece string, n long").groupBy("lang", "piece").agg(F.sum("n").alias("n"))


def grams(word: str, order: int) -> list[str]:
    padded = f" {word} "
    return [padded[i : i + order] for i in range(len(padded) - order + 1)]


def count_grams(counted: DataFrame, orders: int, room: int = 400_000) -> DataFrame:
    """lang, piece, n of the n-grams of 1 to `orders` characters of the counted words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}
        for b in batches:
            for lang, word, n in zip(*(b.column(c).to_pylist() for c in ("lang", "piece", "n"))):
                own = counts.setdefault(lang, Counter())
                for order in range(1, orders + 1):
                    for g in grams(word, order):
                        own[g] += n
                if len(own) > room:
                    yield from _tally(counts)
            if sum(map(len, counts.values())) > room:
                yield from _tally(counts)
        yield from _tally(counts)

    return counted.mapInArrow(run, "lang string, piece string, n long").groupBy("lang", "piece").agg(F.sum("n").alias("n"))


class Model:
    """Languages, and the log shares of known words and n-grams in each."""

    def __init__(self, languages: list[str], orders: int, entries: list[tuple[str, np.ndarray]], of_words: int):
        self.languages, self.orders, self.key = languages, orders, uuid.uuid4().hex
        self.rows = {piece: i for i, (piece, _) in enumerate(entries[:of_words])}
        self.gram_rows = {piece: i + of_words for i, (piece, _) in enumerate(entries[of_words:])}
        self.table = np.array([v for _, v in entries], np.float32).reshape(len(entries), len(languages))


class Scorer(dict):
    """The row of each word in a table that begins with the model's and grows by the values of unseen words; one for each Python worker."""

    def __init__(self, model: Model, room: int = 500_000):
        super().__init__(model.rows)
        self.model, self.room = model, room
        self.table = np.concatenate([model.table, np.zeros((1024, len(model.languages)), np.float32)])
        self.used = len(model.table)

    def unseen(self, word: str) -> np.ndarray | None:
        """The mean of its known n-grams of the longest order that has one; None: no letter of it is known."""
        get = self.model.gram_rows.get
        for order in range(self.model.orders, 0, -1):
            found = [r for g in grams(word, order) if (r := get(g)) is not None]
            if found:
                return np.add.reduce(self.model.table[found]) / np.float32(len(found))
        return None

    def __missing__(self, word: str) -> int:
        if self.used == len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        value = self.unseen(word)
        self.table[self.used] = 0 if value is None else value
        self[word] = self.used
        self.used += 1
        return self.used - 1

    def sums(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The summed values of every text by language, and its number of words."""
        if self.used - len(self.model.table) > self.room:
            self.clear()
            self.update(self.model.rows)
            self.used = len(self.model.table)
        found = [words(t) for t in texts]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        out = np.zeros((len(texts), len(self.model.languages)))
        at = np.fromiter(map(self.__getitem__, chain.from_iterable(found)), np.int64, int(sizes.sum()))
        full = np.flatnonzero(sizes)
        if len(full):
            starts = np.cumsum(sizes) - sizes
            for k in range(len(self.model.languages)):  # one language at a time: memory is that of the words alone
                out[full, k] = np.add.reduceat(self.table[at, k].astype(np.float64), starts[full])
        return out, sizes


def train(docs: DataFrame, most: int = 200_000, orders: int = 5) -> Model | None:
    """The model of documents (text, lang); None if they hold no word.

    The driver gets the languages with their totals, and at most `most` words and `most` n-grams of each order.
    """
    counted = materialise(count_words(docs), "words")
    languages = [(r["lang"], r["n"]) for r in counted.groupBy("lang").agg(F.sum("n").alias("n")).collect()]
    if not languages:
        return None
    names = [lang for lang, _ in sorted(languages, key=lambda x: (-x[1], x[0]))]
    limit = len(names) / most
    place = {lang: i for i, lang in enumerate(names)}
    entries: list[tuple[str, np.ndarray]] = []
    sizes = []
    for pieces, order in ((counted, F.lit(0)), (materialise(count_grams(counted, orders), "grams"), F.length("piece"))):
        each = pieces.withColumn("order", order)
        totals = F.broadcast(each.groupBy("lang", "order").agg(F.sum("n").alias("total")))  # a row a language and order
        shares = each.join(totals, ["lang", "order"]).withColumn("share", F.col("n") / F.col("total"))
        known = shares.groupBy("piece").agg(F.max("share").alias("top"), F.collect_list(F.struct("lang", "share")).alias("shares")).where(F.col("top") >= limit)
        for r in known.select("piece", "shares").orderBy("piece").toArrow().to_pylist():
            values = np.full(len(names), limit / 10)
            for x in r["shares"]:
                values[place[x["lang"]]] = max(x["share"], limit / 10)
            entries.append((r["piece"], np.log(values).astype(np.float32)))
        sizes.append(len(entries))
    return Model(names, orders, entries, sizes[0])


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row."""
    rows = docs.select("doc_id", "text", held_out().alias("held_out"))
    if model is None:
        return rows.select("doc_id", "held_out", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([docs.schema["doc_id"], T.StructField("held_out", T.BooleanType()), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = once(("language", shared.value.key), lambda: Scorer(shared.value))
        names = np.array([*shared.value.languages, UNKNOWN], object)
        for s in text_slices(batches):
            sums, sizes = scorer.sums([t or "" for t in s.column("text").to_pylist()])
            best = sums.argmax(1)
            score = 1 / np.exp(sums - sums.max(1, keepdims=True)).sum(1)
            none = sizes == 0
            best[none], score[none] = len(names) - 1, 0.0
            yield pa.RecordBatch.from_arrays([s.column("doc_id"), s.column("held_out"), pa.array(names[best], pa.string()), pa.array(score)], schema.names)

    return rows.mapInArrow(run, schema)


def identify(docs: DataFrame, most: int = 200_000, orders: int = 5) -> DataFrame:
    """Languages of all documents, learned from those that are not held out."""
    return predict(docs, train(docs.where(F.col("doc_id").isNotNull() & ~held_out()), most, orders))
