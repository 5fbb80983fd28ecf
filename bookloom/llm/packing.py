"""Lexical retrieval packing: documents that share words are packed into the same windows.

1. Every text is encoded once (library tokenizer, a bounded cache by span of text) and written to the shared folder.
2. Document frequencies of all tokens are summed over all rows (one vector of the vocabulary's size).
3. A text's route is its two tokens of the largest ln(1 + tf) * idf that some other text has too; it spreads over all routes
   whatever the text's length.  Rows are range-partitioned by (route, doc_id): a route that very many rows have is
   cut by doc_id.  A task takes its sorted rows in shards of bounded size, each with an inverted index under BM25 weights.
4. The next unused document of a shard is the seed, all its tokens are the query; its unused neighbours, best first, fill
   the seed's window while they fit, the best that did not is cut at the window's end, and what is left of it is the seed of
   the next window.  The last window of a shard is cut into sequences whose lengths are powers of two, which need no padding.

Neighbours come from the seed's own shard, as the index is sharded; the README says how many of the true ones are there.

Edge cases: a null or empty text is the end token alone; repeated rows are packed each; rows with a null doc_id are
packed too; an empty table has no pieces; a document longer than a window spans several; doc_id is of any atomic type;
other columns are left out.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from bookloom.llm.common import SPACE, as_bytes, mix, scratch_path, sum_vectors, text_slices, tidy
from bookloom.llm.vocab import byte_symbols, locate, once, release

_LETTERS = "[A-Za-zÀ-ÖØ-öø-ÿ]"
_MARKS = r"[!-&(-/:-@\[-`{-~]"  # all of ASCII but the apostrophe, which can begin a piece of its own
#: A span of letters, marks or letters and closing marks: a piece or two.
_PLAIN = re.compile(f"({_LETTERS}*+)({_MARKS}*+)")
#: Bytes in lower case, and those of ASCII's letters and digits.
_LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)
_ALNUM = np.array([chr(b).isalnum() and b < 128 for b in range(256)])
_U = np.uint64


@dataclass(frozen=True)
class Packing:
    """Window length, end token, tokens of a shard, tokens of a partition (least, most), BM25's k1 and b, share of a shard's documents from which a token's weights are kept dense."""

    window: int = 4096
    end_id: int = 2
    shard_tokens: int = 1 << 20
    partition_tokens: tuple[int, int] = (4 << 20, 64 << 20)
    k1: float = 1.2
    b: float = 0.75
    dense: float = 0.15


def _rows(at: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The texts that hold the bytes at these places."""
    return np.unique(np.searchsorted(offsets, at, side="right") - 1)


def _lowered(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The texts' bytes in lower case, but for texts where that may change more than plain letters (wide letters, `<|`)."""
    low = _LOWER[data]
    low[np.flatnonzero((data[:-1] == 0xC3) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1] += 0x20
    wide = np.flatnonzero(data >= 0xC4)
    if len(wide):  # U+2010 to U+2027 are no letters
        second, third = data[np.minimum(wide + 1, len(data) - 1)], data[np.minimum(wide + 2, len(data) - 1)]
        wide = wide[(data[wide] != 0xE2) | (second != 0x80) | (third < 0x90) | (third > 0xA7)]
    for r in _rows(np.concatenate([wide, np.flatnonzero((data[:-1] == 0x3C) & (data[1:] == 0x7C))]), offsets):
        low[offsets[r] : offsets[r + 1]] = data[offsets[r] : offsets[r + 1]]
    return low


def _spans(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The spans between white space, without a comma or stop that closes one after a plain letter or digit (a span of
    its own); and for every text the index of its first span (one more entry at the end)."""
    n = len(data)
    inside, border = ~SPACE[data], np.zeros(n + 1, bool)
    border[offsets] = border[0] = border[n] = True
    begin = inside.copy()
    begin[1:] &= ~inside[:-1] | border[1:n]
    at = np.flatnonzero((data == 0x2C) | (data == 0x2E))
    at = at[~begin[at]]
    at = at[border[at + 1] | ~inside[np.minimum(at + 1, n - 1)]]
    before = data[at - 1]
    begin[at[_ALNUM[before] | (data[at - 2] == 0xC3) & (before >= 0xA0) & (before != 0xB7)]] = True
    kept = data[inside]
    ends = np.append(np.flatnonzero(begin[inside]), len(kept))
    spans = pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(kept)])
    return spans, np.searchsorted(np.flatnonzero(begin), offsets)


def _gather(values: np.ndarray, begin: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The runs of values, one after the other."""
    ends = np.cumsum(lengths)
    return values[np.repeat(begin - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)]


class Encoder:
    """Identifiers of a text as 16-bit numbers, by the library for spans between white space not seen lately.

    Texts come by slices.  A slice is put in lower case where that changes nothing but plain letters, and cut into spans;
    Arrow numbers the distinct ones, and only these are looked up.  New spans of letters, of marks or of letters and closing
    marks go to the library's model together, one to a line: normalising would leave them as they are but for case, splitting
    gives these pieces, and the model takes bytes as their symbols.  Any other span goes to the library whole.
    Of more than most_words spans those stay that several slices had.
    """

    def __init__(self, tokenizer: str, most_words: int = 500_000, longest: int = 40):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(locate(tokenizer))
        if self.library.get_vocab_size() > 1 << 16:
            raise ValueError("identifiers must fit 16 bits")
        self.encode = getattr(self.library, "encode_batch_fast", self.library.encode_batch)
        self.lines = Tokenizer(self.library.model)
        self.lines.pre_tokenizer = pre_tokenizers.Split("\n", "removed")
        self.split = getattr(self.lines, "encode_batch_fast", self.lines.encode_batch)
        suffix, self.symbols = self.library.model.end_of_word_suffix, byte_symbols()
        self.last = np.zeros(1 << 16, bool)  # the identifiers that end a piece
        self.last[[i for s, i in self.library.get_vocab(False).items() if suffix and s.endswith(suffix)]] = True
        self.most, self.longest = most_words, longest
        self.known: dict[bytes, int] = {}
        self.ids, self.begin, self.length, self.slices = np.zeros(0, np.uint16), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _lines(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Identifiers of plain pieces, and how many each has."""
        text = "\n".join(pieces).lower()
        if not text.isascii():
            text = text.encode().decode("latin-1").translate(self.symbols | {10: "\n"})
        ids = np.array(self.split([text], add_special_tokens=False)[0].ids, np.uint16)
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) == len(pieces):
            return ids, np.diff(ends, prepend=0)
        each = [[x.id for x in self.library.model.tokenize(t)] for t in text.split("\n")]
        return np.array([i for e in each for i in e], np.uint16), np.array([len(e) for e in each])

    def _new(self, spans: list[bytes]) -> None:
        """Learn the identifiers of spans."""
        pieces, owner, whole, others = [], [], [], []
        for k, span in enumerate(spans):
            text = span.decode()
            if span.isalpha():  # letters of ASCII alone
                pieces.append(text)
                owner.append(k)
            elif plain := _PLAIN.fullmatch(text):
                for piece in filter(None, plain.groups()):
                    pieces.append(piece)
                    owner.append(k)
            else:
                whole.append(text)
                others.append(k)
        ids, lengths = self._lines(pieces) if pieces else (np.zeros(0, np.uint16), np.zeros(0, np.int64))
        rest = [np.array(e.ids, np.uint16) for e in self.encode(whole, add_special_tokens=False)] if whole else []
        length = np.bincount(owner, lengths, len(spans)).astype(np.int64)
        begin = np.cumsum(length) - length
        length[others] = [len(r) for r in rest]
        begin[others] = len(ids) + np.cumsum(length[others]) - length[others]
        self.known |= zip(spans, range(len(self.begin), len(self.begin) + len(spans)))
        self.begin, self.length = np.concatenate([self.begin, begin + len(self.ids)]), np.concatenate([self.length, length])
        self.ids, self.slices = np.concatenate([self.ids, ids, *rest]), np.concatenate([self.slices, np.zeros(len(spans), np.int64)])

    def _forget(self) -> None:
        """Keep the spans that several slices had; none if they are too many."""
        stay = np.flatnonzero((self.slices > 1) & (self.length <= self.longest))
        stay = stay[: len(stay) if 2 * len(stay) <= self.most else 0]
        number = np.full(len(self.begin), -1)
        number[stay] = np.arange(len(stay))
        self.known = {s: k for s, k in zip(self.known, number.tolist()) if k >= 0}
        self.ids, self.length = _gather(self.ids, self.begin[stay], self.length[stay]), self.length[stay]
        self.begin, self.slices = np.cumsum(self.length) - self.length, np.zeros(len(stay), np.int64)

    def column(self, texts: pa.Array) -> list[bytes]:
        data, offsets = as_bytes(texts)
        if not len(data):
            return [b""] * len(texts)
        spans, first = _spans(_lowered(data, offsets), offsets)
        coded = spans.dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        number = np.fromiter(map(self.known.get, distinct, repeat(-1)), np.int64, len(distinct))
        if len(new := np.flatnonzero(number < 0)):
            number[new] = np.arange(len(self.begin), len(self.begin) + len(new))
            self._new([distinct[k] for k in new.tolist()])
        self.slices[number] += 1
        number = number[coded.indices.to_numpy()]
        lengths = self.length[number]
        ids, ends = _gather(self.ids, self.begin[number], lengths), np.concatenate([[0], np.cumsum(lengths)])[first].tolist()
        if len(self.known) > self.most or len(self.ids) > 8 * self.most:
            self._forget()
        return [ids[a:b].tobytes() for a, b in zip(ends, ends[1:])]

    def texts(self, texts: list[str]) -> list[bytes]:
        return self.column(pa.array(texts, pa.large_string()))


def _counts(arrays: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Array, identifier and how often it occurs there, in this order, for the distinct identifiers of all arrays at once."""
    keys = np.concatenate(arrays).astype(np.int64) | np.repeat(np.arange(len(arrays)) << 16, [len(a) for a in arrays])
    keys.sort()
    at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[at] >> 16, keys[at] & 0xFFFF, np.diff(at, append=len(keys))


def routes(arrays: list[np.ndarray], seen: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """The route of each array; one without a token that others have gets a route by its first token."""
    owner, token, tf = _counts(arrays)
    weight = np.where(seen[token] > 1, np.log1p(tf) * idf[token], 0).astype(np.float32)
    ranked = weight.view(np.uint32).astype(_U) << _U(16) | token.astype(_U)
    begin = np.searchsorted(owner, np.arange(len(arrays)))
    first = np.maximum.reduceat(ranked, begin)
    ranked[ranked == np.repeat(first, np.diff(begin, append=len(ranked)))] = 0
    second = np.maximum.reduceat(ranked, begin)
    return ((mix((first & _U(0xFFFF)) + _U(1)) >> _U(17) << _U(16)) | (second & _U(0xFFFF))).astype(np.int64)


def _documents_with(arrays: list[np.ndarray]) -> np.ndarray:
    """How many of the arrays hold each identifier."""
    return np.bincount(_counts(arrays)[1], minlength=1 << 16)


def encode(docs: DataFrame, tokenizer: str, how: Packing) -> DataFrame:
    """doc_id, ids (16-bit, with the end token), n; a row with `seen` (document frequencies) for each task."""
    schema = T.StructType([docs.schema["doc_id"], T.StructField("ids", T.BinaryType()), T.StructField("n", T.LongType()), T.StructField("seen", T.BinaryType())])
    kind = to_arrow_type(docs.schema["doc_id"].dataType)
    end = np.array([how.end_id], "<u2").tobytes()

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = once(("encoder", tokenizer), lambda: Encoder(tokenizer))
        seen = np.zeros(1 << 16, np.int64)
        for s in text_slices(batches, limit=4 << 20):  # words recur: the larger a slice, the fewer are looked up
            got = [i + end for i in encoder.column(s.column("text"))]
            arrays = [np.frombuffer(i, "<u2") for i in got]
            if arrays:
                seen += _documents_with(arrays)
            yield pa.RecordBatch.from_arrays([s.column("doc_id").cast(kind), pa.array(got, pa.binary()), pa.array([len(a) for a in arrays], pa.int64()), pa.nulls(len(got), pa.binary())], schema.names)
        yield pa.RecordBatch.from_arrays([pa.nulls(1, kind), pa.nulls(1, pa.binary()), pa.array([0], pa.int64()), pa.array([seen.tobytes()], pa.binary())], schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def routed(kept: DataFrame, seen: np.ndarray, idf: np.ndarray) -> DataFrame:
    """kept (doc_id, ids) with the routes."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for s in text_slices(batches, "ids"):
            arrays = [np.frombuffer(i.as_buffer(), "<u2") for i in s.column("ids")]
            yield pa.RecordBatch.from_arrays([*s.columns, pa.array(routes(arrays, seen, idf))], [*s.schema.names, "route"])

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField("route", T.LongType())]))


def frequencies(encoded: DataFrame) -> np.ndarray:
    """Documents that hold each token, over all rows."""
    return sum_vectors(encoded.where("seen is not null").select("seen"), 1 << 16)


class Shard:
    """Documents of a shard and their inverted index under BM25 weights."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean: float, how: Packing):
        self.docs, self.idf, self.how = docs, idf, how
        owner, term, tf = _counts(docs)
        self.terms = np.split(term.astype(np.uint16), np.searchsorted(owner, np.arange(1, len(docs))))
        lengths = np.array([len(d) for d in docs], np.float64)
        weight = idf[term] * tf * (how.k1 + 1) / (tf + how.k1 * (1 - how.b + how.b * lengths[owner] / mean))
        order = np.argsort(term.astype(np.uint16), kind="stable")
        self.owner, self.weight = owner[order].astype(np.int32), weight[order].astype(np.float32)
        self.begin = np.searchsorted(term[order], np.arange((1 << 16) + 1))
        often = np.flatnonzero(np.diff(self.begin) > how.dense * len(docs))
        self.row = np.full(1 << 16, -1)
        self.row[often] = np.arange(len(often))
        self.table = np.zeros((len(often), len(docs)), np.float32)  # weights of the tokens that many documents have
        for k, t in enumerate(often):
            s = slice(self.begin[t], self.begin[t + 1])
            self.table[k, self.owner[s]] = self.weight[s]

    def scores(self, seed: int) -> np.ndarray:
        """BM25 of every document for all tokens of the seed."""
        terms = self.terms[seed].astype(np.int64)
        row = self.row[terms]
        out = self.table[row[row >= 0]].sum(0, dtype=np.float64)
        spans = [slice(self.begin[t], self.begin[t + 1]) for t in terms[row < 0]]
        if spans:
            out += np.bincount(np.concatenate([self.owner[s] for s in spans]), np.concatenate([self.weight[s] for s in spans]), len(self.docs))
        return out

    def neighbours(self, seed: int, unused: np.ndarray) -> np.ndarray:
        """The unused documents that share a token with the seed, best first."""
        scores = np.where(unused, self.scores(seed), 0)
        best = np.flatnonzero(scores > 0)
        return best[np.argsort(-scores[best], kind="stable")]


def pack_shard(docs: list[np.ndarray], idf: np.ndarray, mean: float, how: Packing) -> Iterator[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of every piece of the shard's documents."""
    shard, unused, lengths = Shard(docs, idf, mean, how), np.ones(len(docs), bool), np.array([len(d) for d in docs])
    sequence, filled, pieces = 0, 0, []

    def place(d: int) -> None:
        nonlocal sequence, filled
        unused[d], at = False, 0
        while at < len(docs[d]):
            length = min(len(docs[d]) - at, how.window - filled)
            pieces.append((d, at, length, sequence, filled))
            at, filled = at + length, filled + length
            if filled == how.window:
                sequence, filled = sequence + 1, 0

    for first in range(len(docs)):
        seed = first
        while unused[first] or seed != first:
            if unused[seed]:
                place(seed)
            if not filled:
                break
            near = shard.neighbours(seed, unused)
            over, at = near[lengths[near] > how.window - filled], 0
            while filled and len(fits := np.flatnonzero(lengths[near[at:]] <= how.window - filled)):
                at += int(fits[0]) + 1
                place(int(near[at - 1]))
            if not filled or not len(over):
                break
            seed = int(over[0])
            place(seed)  # cut at the window's end: what is left begins the next window, as its seed
    begun = [p for p in pieces if p[3] == sequence] if filled else []
    yield from pieces[: len(pieces) - len(begun)]
    ends = np.cumsum([1 << k for k in range(filled.bit_length() - 1, -1, -1) if filled >> k & 1]).tolist()
    for d, start, length, _, offset in begun:
        while length:
            k = int(np.searchsorted(ends, offset, side="right"))
            part = min(length, ends[k] - offset)
            yield d, start, part, sequence + k, offset - (ends[k - 1] if k else 0)
            start, length, offset = start + part, length - part, offset + part


def pack(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", how: Packing = Packing()) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece."""
    spark = docs.sparkSession
    rows = encode(docs, tokenizer, how)
    path = scratch_path(spark, "encoded")
    rows.write.option("compression", "zstd").parquet(path)
    encoded = spark.read.schema(rows.schema).parquet(path)
    kept = encoded.where("seen is null").drop("seen")
    n_docs, n_tokens = kept.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    seen = frequencies(encoded)
    idf = np.log1p((n_docs - seen + 0.5) / (seen + 0.5))
    mean = n_tokens / max(1, n_docs)
    least, most = how.partition_tokens
    partitions = max(1, -(-n_tokens // most), min(-(-n_tokens // least), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    schema = T.StructType([docs.schema["doc_id"], *[T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        sequence = TaskContext.get().partitionId() << 32
        names, arrays, size = [], [], 0

        def packed() -> pa.RecordBatch:
            nonlocal sequence
            found = list(pack_shard(arrays, idf, mean, how))
            crc = [zlib.crc32(arrays[d][s : s + n].astype("<u4").tobytes()) for d, s, n, _, _ in found]
            columns = [[s for _, s, _, _, _ in found], [n for _, _, n, _, _ in found], crc, [len(arrays[d]) for d, *_ in found], [sequence + q for _, _, _, q, _ in found], [o for *_, o in found]]
            sequence = columns[4][-1] + 1
            return pa.RecordBatch.from_arrays([pa.array([names[d] for d, *_ in found], kind), *[pa.array(c, pa.int64()) for c in columns]], schema.names)

        kind = None
        for b in batches:
            kind = b.column("doc_id").type
            for name, ids in zip(b.column("doc_id").to_pylist(), b.column("ids").to_pylist()):
                names.append(name)
                arrays.append(np.frombuffer(ids, "<u2"))
                size += len(arrays[-1])
                if size >= how.shard_tokens:
                    yield packed()
                    names, arrays, size = [], [], 0
        if arrays:
            yield packed()

    dealt = routed(kept.select("doc_id", "ids"), seen, idf).repartitionByRange(partitions, "route", F.xxhash64("doc_id")).sortWithinPartitions("route", "doc_id")
    return dealt.select("doc_id", "ids").mapInArrow(run, schema)
