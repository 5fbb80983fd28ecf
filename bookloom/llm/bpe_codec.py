"""BPE encoding and decoding with a contiguous rank array.

A text is cut at its special strings and at ASCII white space; each span is normalised (NFC, lower case) and cut
into words as the tokenizer does.  A word of up to `SHORT` symbols holds its part boundaries and the ranks of
adjacent parts in two arrays: the least rank is looked for by a scan, its boundary deleted, and the two ranks beside
it refreshed.  Longer words, where repeated scans would be quadratic, go through the heap of token_counts, which
gives the same merges.  Decoding looks the identifiers up and joins the symbols by spaces, as a tokenizer without a
decoder does.

Edge cases: a null or empty text has no identifiers and decodes to an empty text; repeated rows are encoded each;
further columns of the input are left out.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from bookloom.llm.common import text_slices
from bookloom.llm.token_counts import heap_merge
from bookloom.llm.vocab import WHITE, Cache, Vocabulary, once

SHORT = 200
_SPANS = re.compile(r"[^ \t-\r]+")
# Fixed value: the published pattern of the word-end tokenizer, with white space written out.
_WORDS = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{WHITE}\p{{L}}\p{{N}}]+")


def rank_array_merge(symbols: list[str], ranks: dict[tuple[str, str], int]) -> list[str]:
    part, none = list(symbols), len(ranks)
    rank = [ranks.get(p, none) for p in zip(part, part[1:])]
    while rank and (least := min(rank)) < none:
        i = rank.index(least)
        part[i] += part.pop(i + 1)
        del rank[i]
        if i:
            rank[i - 1] = ranks.get((part[i - 1], part[i]), none)
        if i < len(rank):
            rank[i] = ranks.get((part[i], part[i + 1]), none)
    return part


class Codec:
    def __init__(self, tokenizer: str):
        self.vocabulary = Vocabulary(tokenizer)
        self.cut = re.compile("(" + "|".join(map(re.escape, self.vocabulary.special)) + ")") if self.vocabulary.special else None
        self.words = Cache(self.word, 1_200_000)
        self.spans = Cache(self.span, 250_000)

    def word(self, word: str) -> bytes:
        symbols = self.vocabulary.symbols(word)
        if len(symbols) <= SHORT:
            parts = rank_array_merge(symbols, self.vocabulary.ranks)
        else:
            parts = [s for s in heap_merge(symbols, self.vocabulary.ranks) if s is not None]
        return array("I", [self.vocabulary.ids[s] for s in parts]).tobytes()

    def span(self, span: str) -> tuple[bytes, str]:
        """The identifiers of a span as bytes, and its decoded text with a space before each symbol."""
        found: list[bytes] = []
        plain = span.isascii() and span.isalpha()  # the common case needs neither normal forms nor patterns
        if plain:
            found.append(self.words[span.lower()])
        for part in () if plain else self.cut.split(span) if self.cut else (span,):
            if part in self.vocabulary.special:
                found.append(array("I", [self.vocabulary.special[part]]).tobytes())
            else:
                low = part.lower() if part.isascii() else "".join([c.lower() for c in unicodedata.normalize("NFC", part)])
                found += map(self.words.__getitem__, _WORDS.findall(low))
        raw, texts = b"".join(found), self.vocabulary.texts
        return raw, "".join([" " + texts[i] for i in memoryview(raw).cast("I")])

    def encode_pair(self, text: str) -> tuple[bytes, str]:
        found = [self.spans[s] for s in _SPANS.findall(text)]
        return b"".join([x[0] for x in found]), "".join([x[1] for x in found])[1:]

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(self.encode_pair(text)[0], "<u4")

    def decode(self, ids: np.ndarray) -> str:
        return " ".join(self.vocabulary.texts[int(i)] for i in ids)


def codec(tokenizer: str) -> Codec:
    return once(("codec", tokenizer), lambda: Codec(tokenizer))


def encode_documents(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", real: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256; with `real` also ids (array<int>) and the decoded text."""
    schema = T.StructType([docs.schema["doc_id"], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
    if real:
        schema = schema.add("ids", T.ArrayType(T.IntegerType())).add("decoded", T.StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(tokenizer)
        for s in text_slices(batches):
            got = [c.encode_pair(t or "") for t in s.column("text").to_pylist()]
            columns = [s.column("doc_id"), pa.array([len(i) // 4 for i, _ in got], pa.int64()), pa.array([hashlib.sha256(i).hexdigest() for i, _ in got]), pa.array([hashlib.sha256(d.encode("utf-8")).hexdigest() for _, d in got])]
            if real:
                columns += [pa.array([np.frombuffer(i, "<i4") for i, _ in got], pa.list_(pa.int32())), pa.array([d for _, d in got], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, tokenizer: str = "word_bpe_49k.json") -> DataFrame:
    """doc_id and the text that its `ids` decode to (null ids: an empty text)."""
    schema = T.StructType([encoded.schema["doc_id"], T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(tokenizer)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([c.decode(np.array(i or [], np.int64)) for i in b.column("ids").to_pylist()], pa.string())], schema.names)

    return encoded.select("doc_id", "ids").mapInArrow(run, schema)
