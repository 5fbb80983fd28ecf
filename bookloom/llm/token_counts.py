"""Token counts by heap-and-linked-list byte-pair merging.

A text is cut at its special strings, then into pieces as a byte-level tokenizer cuts it.  The pairs of a piece
stand in a heap by rank, its symbols in a doubly linked list; the lowest pair is merged until none is left.  The
count of a piece is its initial symbols minus its merges; no identifier is made.  Counts of short pieces are kept
in a bounded cache for each worker.

Edge cases: a null or empty text has 0 bytes and 0 tokens; repeated rows are counted each; a piece of any length
takes n log n steps; further columns of the input are left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bookloom.llm.common import text_slices
from bookloom.llm.vocab import WHITE, Cache, Vocabulary, once

#: Spans that can be cut on their own: the finer pattern never joins characters of two of them.
_SPANS = re.compile(rf" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
# Fixed value: the published pattern of the byte-level tokenizer, with white space written out.
_PIECES = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")


def heap_merge(symbols: list[str], ranks: dict[tuple[str, str], int]) -> list[str | None]:
    """The list after all merges; a symbol that was merged into its left neighbour is None."""
    n, part = len(symbols), list(symbols)
    before, after = list(range(-1, n - 1)), [*range(1, n), -1]
    heap = [(ranks[p], i) for i, p in enumerate(zip(part, part[1:])) if p in ranks]
    heapify(heap)
    while heap:
        rank, i = heappop(heap)
        j = after[i]
        if part[i] is None or j < 0 or ranks.get((part[i], part[j])) != rank:
            continue  # one of the two has been merged since
        part[i], part[j] = part[i] + part[j], None
        after[i] = k = after[j]
        if k >= 0:
            before[k] = i
        for a, b in ((before[i], i), (i, k)):
            if a >= 0 and b >= 0 and (r := ranks.get((part[a], part[b]))) is not None:
                heappush(heap, (r, a))
    return part


class Counter:
    def __init__(self, tokenizer: str):
        self.vocabulary = Vocabulary(tokenizer)
        self.cut = re.compile("|".join(map(re.escape, self.vocabulary.special))) if self.vocabulary.special else None
        self.pieces = Cache(self.piece, 600_000)
        self.spans = Cache(self.span)

    def piece(self, piece: str) -> int:
        symbols = self.vocabulary.symbols(piece)
        return len(symbols) - heap_merge(symbols, self.vocabulary.ranks).count(None)

    def span(self, span: str) -> int:
        return sum(map(self.pieces.__getitem__, _PIECES.findall(span)))

    def count(self, text: str) -> int:
        parts = self.cut.split(text) if self.cut else [text]
        return sum(sum(map(self.spans.__getitem__, _SPANS.findall(p))) for p in parts) + len(parts) - 1


def count_tokens(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = once(("count", tokenizer), lambda: Counter(tokenizer))
        for s in text_slices(batches):
            yield pa.RecordBatch.from_arrays([s.column("doc_id"), pa.array([counter.count(t or "") for t in s.column("text").to_pylist()], pa.int64()), s.column("n_bytes")], ["doc_id", "n_tokens", "n_bytes"])

    rows = docs.select("doc_id", "text", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"))
    out = rows.mapInArrow(run, rows.select("doc_id", F.lit(0).cast("long").alias("n_tokens"), "n_bytes").schema)
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
