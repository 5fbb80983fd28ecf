"""Cross-tokenizer alignment: the tokens of two tokenizers over the same bytes, and which of their ids go together.

Every byte of space + text gets a label: none, end of an A token, end of a B token, or both.  A regular expression cuts
the labels into spans up to each `both`; a span is a group, and its labels tell how many tokens of A and B it holds.
Two tokens overlap where one of them ends, so each label is a link.

A text is cut before each blank or newline that follows something else than white space: neither tokenizer has a token
over such a place, so pieces are tokenized on their own, by the libraries, and a worker keeps the ids of short ones.  A
vocabulary that allows no such cut takes texts whole.

Pass one writes, for each document, its figures and the linked id pairs with their numbers.  The documents of each pair
are counted by buckets of A ids (a task merges sorted arrays; a bucket has at most BUCKET x ids of B entries).  Of
these counts the most frequent, `most_common` at the most, are sent to all tasks, with the greatest of each A id; what a
document holds beside them goes to the bucket of its A id and is counted there.

Edge cases: null and empty texts, and those whose tokens do not spell space + text, have no tokens: zeros and ''; repeated
rows and ids are documents of their own; a piece of any length is aligned in one pass over its bytes; further columns are
left out.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bookloom.llm.common import materialise, text_slices
from bookloom.llm.vocab import Cache, byte_symbols, locate, once

BUCKET = 256
_LEVELS = 512
_SPANS = re.compile(rb"[^\x03]*\x03")


def _span_sizes(span: bytes) -> int:
    """How many tokens of A and of B end in a span, in the upper and the lower 32 bits."""
    both = span.count(3)
    return (span.count(1) + both) << 32 | span.count(2) + both


class ByteLevel:
    """A byte-level tokenizer: special strings in a text are plain text."""

    def __init__(self, tokenizer: str):
        from tokenizers import Tokenizer

        self.inner = Tokenizer.from_file(locate(tokenizer))
        self.inner.encode_special_tokens = True
        raw = {c: b for b, c in byte_symbols().items()}
        self.size = self.inner.get_vocab_size()
        self.bytes = [b""] * self.size
        for token, i in self.inner.get_vocab().items():
            self.bytes[i] = bytes(raw[c] for c in token) if all(c in raw for c in token) else token.encode()

    def encode(self, text: str) -> list[int]:
        return self.inner.encode_batch_fast([text], add_special_tokens=False)[0].ids


class Pieces:
    """A sentence-piece tokenizer, which sets a space in front of what it gets."""

    def __init__(self, model: str):
        from sentencepiece import SentencePieceProcessor

        self.inner = SentencePieceProcessor(model_file=locate(model))
        self.size = self.inner.get_piece_size()
        names = [self.inner.id_to_piece(i) for i in range(self.size)]
        self.bytes = [bytes([int(p[3:5], 16)]) if self.inner.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
        self.space = self.inner.piece_to_id("▁")
        #: White space inside pieces after something else: no cut before these.
        self.joined = {c for i, p in enumerate(names) if not self.inner.is_byte(i) for c in re.findall(r"(?<=[^▁])\s|(?<=[^▁])▁", p)}
        self.joined |= {"\n"} if any(p.startswith("▁\n") for p in names) else set()

    def encode(self, text: str) -> list[int]:
        """Of a text that begins with a space or a newline."""
        if text[0] != " ":
            return self.inner.encode(text)[1:]  # without the space that it sets in front
        return self.inner.encode(text[1:]) if len(text) > 1 else [self.space]  # an empty text would get no space


class Aligner:
    """Ids of pieces are kept in two generations, so that frequent pieces stay when the rest is forgotten."""

    def __init__(self, a: str, b: str, most: int = 200_000, longest: int = 64):
        self.a, self.b, self.most, self.longest = ByteLevel(a), Pieces(b), most, longest
        free = not {"▁", "\n"} & self.b.joined
        #: A run of white space and what follows; other white space than blanks and newlines belongs to what it follows.
        self.cut = re.compile(r"\s+\S*(?:[^\S \n]\s*\S*)*") if free else re.compile(r".+", re.S)
        self.wide = np.uint32 if self.a.size * self.b.size < 1 << 32 else np.uint64
        self.lengths = [np.array([len(x) for x in t.bytes], np.int64) for t in (self.a, self.b)]
        #: An id written out, with what stands after it: `,` inside a group, `|` after the last of A, `;` after that of B.
        self.written = [f"{i}{end}".encode() for size, last in ((self.a.size, "|"), (self.b.size, ";")) for i in range(size) for end in (",", last)]
        self.known: dict[str, tuple[bytes, bytes] | None] = {}
        self.older: dict[str, tuple[bytes, bytes] | None] = {}
        self.spans = Cache(_span_sizes, 100_000)

    def learn(self, pieces: list[str]) -> None:
        """Ids of new pieces, or None where the tokens do not spell the piece; a hundred kB of them are encoded at once."""
        alone = [p for p in pieces if p.isspace()]  # would join what follows
        batches, held = [[p] for p in alone], 0
        for p in pieces:
            if not p.isspace():
                if not held:
                    batches.append([])
                batches[-1].append(p)
                held += len(p)
                held = 0 if held > 100_000 else held
        for own in batches:
            text = "".join(own)
            ends = np.cumsum(np.fromiter(map(len, map(str.encode, own)), np.int64, len(own)))
            parts = []
            for t, lengths in ((self.a, self.lengths[0]), (self.b, self.lengths[1])):
                ids = t.encode(text)
                if b"".join(map(t.bytes.__getitem__, ids)) != text.encode():
                    break
                ids = np.array(ids, np.uint32)
                at = (4 * np.searchsorted(np.cumsum(lengths[ids]), ends, side="right")).tolist()
                raw = ids.tobytes()
                parts.append([raw[i:j] for i, j in zip([0, *at[:-1]], at)])
            if len(parts) == 2:
                self.known.update(zip(own, zip(*parts)))
            elif len(own) == 1:
                self.known[own[0]] = None
            else:
                for p in own:
                    self.learn([p])

    def ids(self, texts: list[str | None]) -> list[tuple[bytes, bytes] | None]:
        """The ids of A and of B of every text; None: no tokens."""
        if len(self.known) > self.most:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        cut = [self.cut.findall(" " + t) if t else [] for t in texts]
        new = {p for own in cut for p in own} - known.keys()
        known.update((p, older[p]) for p in new & older.keys())
        self.learn(list(new - older.keys()))
        out = []
        for own in cut:
            found = list(map(known.__getitem__, own))
            out.append(tuple(map(b"".join, zip(*found))) if found and None not in found else None)
        for p in new:
            if len(p) > self.longest:
                del known[p]
        return out

    def texts(self, texts: list[str | None]) -> Iterator[tuple[int, int, int, int, bytes, np.ndarray, np.ndarray]]:
        """n_a, n_b, n_groups, n_links, groups written out, link keys in order, their numbers."""
        found = self.ids(texts)
        full = [x for x in found if x]
        none = 0, 0, 0, 0, b"", np.zeros(0, self.wide), np.zeros(0, np.uint32)
        if not full:
            yield from [none] * len(texts)
            return
        a, b = (np.frombuffer(b"".join(x), np.uint32).astype(np.int64) for x in zip(*full))
        ends = [np.cumsum(lengths[ids]) for lengths, ids in zip(self.lengths, (a, b))]
        # The label of each byte: none, end of A, end of B, both.
        labels = np.zeros(ends[0][-1], np.uint8)
        labels[ends[0] - 1] = 1
        labels[ends[1] - 1] += 2
        spans = _SPANS.findall(labels.tobytes().translate(None, b"\x00"))
        sizes = np.fromiter(map(self.spans.__getitem__, spans), np.int64, len(spans))
        of_a, of_b = sizes >> 32, sizes & 0xFFFFFFFF
        # A link for each label: the two tokens that lie over its last byte.
        marks = labels[labels > 0]
        i, j = np.cumsum(marks & 1) - (marks & 1), np.cumsum(marks >> 1) - (marks >> 1)
        links = (a[i] * self.b.size + b[j]).astype(self.wide)
        # Groups written out: the tokens of A of a group, then those of B.
        sums_a, sums_b = np.cumsum(of_a), np.cumsum(of_b)
        codes = np.empty(len(a) + len(b), np.int64)
        last_a, last_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        last_a[sums_a - 1] = last_b[sums_b - 1] = 1
        codes[np.arange(len(a)) + np.repeat(sums_b - of_b, of_a)] = 2 * a + last_a
        codes[np.arange(len(b)) + np.repeat(sums_a, of_b)] = 2 * (self.a.size + b) + last_b
        written = list(map(self.written.__getitem__, codes.tolist()))
        n = np.array([[len(x) // 4 for x in own] for own in full])
        to_a, to_b = np.cumsum(n, axis=0).T
        groups = np.searchsorted(sums_a, to_a) + 1
        ends_of = np.searchsorted(np.flatnonzero(labels), ends[0][to_a - 1] - 1) + 1  # links up to a text's last byte
        at, k = (0, 0, 0, 0), 0
        for own in found:
            if own is None:
                yield none
                continue
            to = int(to_a[k]), int(to_b[k]), int(groups[k]), int(ends_of[k])
            keys, times = np.unique(links[at[3] : to[3]], return_counts=True)
            yield *(y - x for x, y in zip(at, to)), b"".join(written[at[0] + at[1] : to[0] + to[1]])[:-1], keys, times.astype(np.uint32)
            at, k = to, k + 1


def align(docs: DataFrame, a: str, b: str, real: bool = True) -> DataFrame:
    """row, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, links (keys a x size of B + b, ascending) and times (both
    as bytes); with `real` also the groups written out as `a1,a2|b1;a3|b2,b3`."""
    longs = ["n_a", "n_b", "n_groups", "n_links"]
    schema = T.StructType([T.StructField("row", T.LongType()), docs.schema["doc_id"], *[T.StructField(c, T.LongType()) for c in longs], T.StructField("groups_sha256", T.StringType()), T.StructField("links", T.BinaryType()), T.StructField("times", T.BinaryType())])
    if real:
        schema = schema.add("groups", T.StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = once(("align", a, b), lambda: Aligner(a, b))
        for s in text_slices(batches):
            got = list(aligner.texts(s.column("text").to_pylist()))
            columns = [s.column("row"), s.column("doc_id"), *[pa.array([x[i] for x in got], pa.int64()) for i in range(4)]]
            columns.append(pa.array([hashlib.sha256(x[4]).hexdigest() if x[0] else "" for x in got]))
            columns += [pa.array([x[i].tobytes() for x in got], pa.binary()) for i in (5, 6)]
            yield pa.RecordBatch.from_arrays([*columns, *[pa.array([x[4].decode() for x in got])] * real], schema.names)

    return docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text").mapInArrow(run, schema)


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    sums = np.zeros(len(keys), np.int64)
    np.add.at(sums, at, np.concatenate([n for _, n in parts]))
    return keys, sums


def _blobs(keys: np.ndarray, n: np.ndarray, step: int) -> Iterator[tuple[int, bytes, bytes]]:
    """Keys and numbers by bucket."""
    bucket = (keys // keys.dtype.type(step)).astype(np.int64)
    edges = np.flatnonzero(np.diff(bucket, prepend=-1))
    for lo, hi in zip(edges, [*edges[1:], len(keys)]):
        yield int(bucket[lo]), keys[lo:hi].tobytes(), n[lo:hi].tobytes()


def _level(n: np.ndarray) -> np.ndarray:
    return (8 * np.log2(n)).astype(np.int64)


def count_pairs(aligned: DataFrame, of_b: int, wide: type, room: int = 1_000_000) -> DataFrame:
    """bucket, links, n: in how many documents each pair is linked; top: the greatest n of each A id of the bucket; levels: a histogram of n."""
    step = BUCKET * of_b

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0

        def out() -> Iterator[pa.RecordBatch]:
            if parts:
                made = list(_blobs(*_merged(parts), step))
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in made], pa.int32()), *[pa.array([x[i] for x in made], pa.binary()) for i in (1, 2)]], ["bucket", "links", "n"])

        for b in batches:
            for x in b.column(0):
                keys = np.frombuffer(x.as_py(), wide)
                parts.append((keys, np.ones(len(keys), np.int64)))
                held += len(keys)
                if held > room:
                    merged = _merged(parts)
                    parts, held = [merged], len(merged[0])
                    if held > room // 2:  # little repeats here: hand it on
                        yield from out()
                        parts, held = [], 0
        yield from out()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(bucket: int, parts: list) -> pa.RecordBatch:
            keys, n = _merged(parts)
            top = np.zeros(BUCKET, np.int64)
            np.maximum.at(top, (keys // wide(of_b)).astype(np.int64) - bucket * BUCKET, n)
            levels = np.bincount(_level(n), minlength=_LEVELS)
            return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), *[pa.array([x.tobytes()], pa.binary()) for x in (keys, n, top, levels)]], ["bucket", "links", "n", "top", "levels"])

        now, parts = None, []
        for b in batches:
            for bucket, keys, n in zip(b.column("bucket").to_pylist(), b.column("links"), b.column("n")):
                if bucket != now and parts:
                    yield out(now, parts)
                    parts = []
                now = bucket
                parts.append((np.frombuffer(keys.as_py(), wide), np.frombuffer(n.as_py(), np.int64)))
                if sum(len(k) for k, _ in parts[1:]) > max(room, len(parts[0][0])):
                    parts = [_merged(parts)]
        if parts:
            yield out(now, parts)

    rows = aligned.where(F.octet_length("links") > 0).select("links").mapInArrow(add, "bucket int, links binary, n binary")
    return rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(merge, "bucket int, links binary, n binary, top binary, levels binary")


def score(aligned: DataFrame, a: str, b: str, most_common: int = 2_000_000) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of aligned documents (written, so that `row` holds)."""
    aligner = Aligner(a, b)
    of_a, of_b, wide = aligner.a.size, aligner.b.size, aligner.wide
    counts = materialise(count_pairs(aligned, of_b, wide), "pairs")
    best, levels = np.zeros((of_a // BUCKET + 1) * BUCKET, np.int64), np.zeros(_LEVELS, np.int64)
    for r in counts.select("bucket", "top", "levels").toLocalIterator():  # of_a / BUCKET rows
        best[r["bucket"] * BUCKET : (r["bucket"] + 1) * BUCKET] = np.frombuffer(r["top"], np.int64)
        levels += np.frombuffer(r["levels"], np.int64)
    above = np.cumsum(levels[::-1])[::-1]
    least = int(np.argmax(above <= most_common))  # pairs of this level or more are few enough

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, n in zip(batch.column("links"), batch.column("n")):
                keys, n = np.frombuffer(keys.as_py(), wide), np.frombuffer(n.as_py(), np.int64)
                mask = _level(n) >= least
                yield pa.RecordBatch.from_arrays([pa.array([x[mask].tobytes()], pa.binary()) for x in (keys, n)], ["links", "n"])

    found = counts.select("links", "n").mapInArrow(frequent, "links binary, n binary").collect()
    keys, n = (np.concatenate([np.frombuffer(r[c], t) for r in found] or [np.zeros(0, t)]) for c, t in (("links", wide), ("n", np.int64)))
    order = np.argsort(keys)
    shared = aligned.sparkSession.sparkContext.broadcast((keys[order], n[order], best))

    def split(links: bytes, times: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        own, t = np.frombuffer(links, wide), np.frombuffer(times, np.uint32).astype(np.int64)
        known = shared.value[0]
        at = np.minimum(np.searchsorted(known, own), max(0, len(known) - 1))
        return own, t, at, known[at] == own if len(known) else np.zeros(len(own), bool)

    head = [f for f in aligned.schema if f.name not in ("links", "times", "groups")]
    names = [f.name for f in head]

    def common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, many, best = shared.value
        for batch in batches:
            sums = []
            for links, times in zip(batch.column("links"), batch.column("times")):
                own, t, at, hit = split(links.as_py(), times.as_py())
                c, t = many[at[hit]], t[hit]
                sums.append((int(t[c == best[(own[hit] // wide(of_b)).astype(np.int64)]].sum()), int((t * c).sum())))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], *[pa.array([x[i] for x in sums], pa.int64()) for i in (0, 1)]], [*names, "n_best", "count_sum"])

    out = aligned.select(*names, "links", "times").mapInArrow(common, T.StructType([*head, T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType())]))
    if least:
        out = out.join(_rare(aligned, counts, split, best, of_b, wide), "row", "left")
        out = out.withColumns({c: F.col(c) + F.coalesce(f"rare_{c}", F.lit(0)) for c in ("n_best", "count_sum")})
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def _rare(aligned: DataFrame, counts: DataFrame, split, best: np.ndarray, of_b: int, wide: type, room: int = 500_000) -> DataFrame:
    """row, rare_n_best, rare_count_sum: sums over the links whose pair is not among the frequent ones."""
    step = BUCKET * of_b

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def out() -> Iterator[pa.RecordBatch]:
            if held:
                keys, rows, times = (np.concatenate([x[i] for x in held]) for i in range(3))
                order = np.argsort(keys, kind="stable")
                keys, rows, times = keys[order], rows[order], times[order]
                parts = [(*x, times[lo:hi].tobytes()) for x, (lo, hi) in zip(_blobs(keys, rows, step), _edges(keys, step))]
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in parts], pa.int32()), *[pa.array([x[i] for x in parts], pa.binary()) for i in (1, 2, 3)]], ["bucket", "links", "n", "times"])
                held.clear()

        for b in batches:
            for row, links, times in zip(b.column("row").to_pylist(), b.column("links"), b.column("times")):
                own, t, _, hit = split(links.as_py(), times.as_py())
                held.append((own[~hit], np.full((~hit).sum(), row, np.int64), t[~hit]))
                if sum(len(x[0]) for x in held[-1:]) and sum(len(x[0]) for x in held) > room:
                    yield from out()
        yield from out()

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, keys, n = None, None, None
        for b in batches:
            for bucket, kind, links, numbers, times in zip(b.column("bucket").to_pylist(), b.column("kind").to_pylist(), b.column("links"), b.column("n"), b.column("times")):
                if not kind:  # the counts of a bucket come before what is asked of it
                    now, keys, n = bucket, np.frombuffer(links.as_py(), wide), np.frombuffer(numbers.as_py(), np.int64)
                    continue
                asked, rows, t = np.frombuffer(links.as_py(), wide), np.frombuffer(numbers.as_py(), np.int64), np.frombuffer(times.as_py(), np.int64)
                c = n[np.searchsorted(keys, asked)]
                top = c == best[(asked // wide(of_b)).astype(np.int64)]
                each, at = np.unique(rows, return_inverse=True)
                sums = np.zeros((2, len(each)), np.int64)
                np.add.at(sums[0], at, t * top)
                np.add.at(sums[1], at, t * c)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (each, *sums)], ["row", "n_best", "count_sum"])

    asked = aligned.where(F.octet_length("links") > 0).select("row", "links", "times").mapInArrow(ask, "bucket int, links binary, n binary, times binary")
    both = counts.select("bucket", F.lit(0).alias("kind"), "links", "n", F.lit(None).cast("binary").alias("times")).unionByName(asked.withColumn("kind", F.lit(1)))
    parts = both.repartition("bucket").sortWithinPartitions("bucket", "kind").mapInArrow(answer, "row long, n_best long, count_sum long")
    return parts.groupBy("row").agg(F.sum("n_best").alias("rare_n_best"), F.sum("count_sum").alias("rare_count_sum"))


def _edges(keys: np.ndarray, step: int) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff((keys // keys.dtype.type(step)).astype(np.int64), prepend=-1))
    return list(zip(edges, [*edges[1:], len(keys)]))


def align_documents(docs: DataFrame, a: str = "byte_bpe_50k.json", b: str = "piece_bpe_32k.model", most_common: int = 2_000_000) -> DataFrame:
    """The alignment of every document, and how common its links are in the corpus."""
    return score(materialise(align(docs, a, b, real=False), "aligned"), a, b, most_common)
