"""Helpers that the text operators share: the scratch folder, Arrow slices, words as numpy arrays."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of every contract here: space and U+0009 to U+000D.
SPACE_RE = r"[\x20\x09-\x0D]+"

SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}
_give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc: numpy's and Python's freed memory


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a new temporary one where that is unset (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = tempfile.mkdtemp(prefix="bookloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder."""
    return f"{shared_dir(spark)}/bookloom-{uuid.uuid4().hex}/{name}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it again: cuts lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def modest_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of at most so many rows, for texts of some kB: what a Python worker holds at once stays small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def text_slices(batches: Iterator[pa.RecordBatch], *columns: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in slices of about `limit` bytes in `columns` (`text` if none are named; a longer row stands alone)."""
    for batch in batches:
        sizes = sum(pc.fill_null(pc.binary_length(batch.column(c)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns or ("text",))
        ends = np.cumsum(sizes)
        at, n = 0, len(sizes)
        while at < n:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to
    trim()


def trim() -> None:
    """Give freed memory back to the system: idle Python workers stay for a minute beside those of the next stage."""
    _powers.clear()
    for pool in (pa.default_memory_pool(), pa.system_memory_pool()):
        pool.release_unused()
    if _give_back:
        _give_back(0)


def tidy(run: Callable) -> Callable:
    """run, a function over Arrow batches, which trims when what it held is gone: at the end of its own loop it still holds its last slice."""

    def ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        trim()

    return ended


def as_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts' UTF-8 bytes in one array, and where each text begins (nulls are empty)."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and for every text the index of its first word (one more entry at the end)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~SPACE[data]
    border = np.zeros(n + 1, bool)
    border[offsets] = True
    edge = np.empty(n + 1, bool)
    edge[0] = edge[n] = True
    edge[1:n] = ~inside[:-1]
    starts = np.flatnonzero(inside & (edge[:n] | border[:n]))
    edge[1:n] = ~inside[1:]
    ends = np.flatnonzero(inside & (edge[1:] | border[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    h = h ^ (h >> _U(31))
    h = h * _U(0x7FB5D329728EA185)
    h = h ^ (h >> _U(27))
    h = h * _U(0x81DADEF4BC2DD44D)
    return h ^ (h >> _U(33))


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 16), base, _U)
        steps[0] = 1
        have = np.multiply.accumulate(steps)
        if n <= 1 << 22:
            _powers[base] = have
    return have[:n]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of every span, wherever it stands."""
    n = len(data)
    before = np.zeros(n + 1, _U)
    np.cumsum((data.astype(_U) + _U(1)) * _power(_BASE, n), out=before[1:])
    return mix((before[ends] - before[starts]) * _power(_BASE_INV, max(n, 1))[starts] + (ends - starts).astype(_U))


def sum_vectors(vectors: DataFrame, size: int, parts: int = 16) -> np.ndarray:
    """The sum of a column of int64 vectors of one size (as bytes), a few from each task; `parts` partial sums reach the driver.

    They are shuffled as they come: a sum ahead of that would be a second Python worker beside the one that makes them.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for b in batches:
            for x in b.column(0):
                total += np.frombuffer(x.as_py(), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["v"])

    sums = vectors.repartition(parts).mapInArrow(add, "v binary")
    return sum((np.frombuffer(r[0], np.int64) for r in sums.collect()), np.zeros(size, np.int64))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held_out: int, most: int) -> DataFrame:
    """doc_id, text, y of the documents with at most `most` labelled identifiers whose crc32(doc_id as text) mod `modulus` is not `held_out`.

    The identifiers are the first `most` in the order of a hash, so their table has a proven bound and is broadcast.
    """
    open_ids = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(modulus)) != held_out))
    chosen = open_ids.groupBy("doc_id").agg(F.max(label).cast("int").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")


def id_filter(ids: DataFrame, count: int, bits_each: int = 8, most_bits: int = 1 << 27) -> np.ndarray:
    """A bit map of a hash of every id (long), of at most most_bits / 8 bytes: it passes all ids, and few others while it is sparse."""
    bits = 1 << max(10, min(most_bits, bits_each * max(1, count)).bit_length() - 1)

    @tidy
    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(bits, bool)
        for b in batches:
            seen[_slot(b.column(0), bits)] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(seen).tobytes()], pa.binary())], ["v"])

    @tidy
    def union(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(bits // 8, np.uint8)
        for b in batches:
            for x in b.column(0):
                total |= np.frombuffer(x.as_py(), np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["v"])

    total = np.zeros(bits // 8, np.uint8)
    for r in ids.mapInArrow(mark, "v binary").repartition(4).mapInArrow(union, "v binary").collect():
        total |= np.frombuffer(r[0], np.uint8)
    return total


def _slot(ids: pa.Array, bits: int) -> np.ndarray:
    return (mix(pc.fill_null(ids.cast(pa.int64()), 0).to_numpy(zero_copy_only=False).view(_U)) & _U(bits - 1)).astype(np.int64)


def passed(batch: pa.RecordBatch, column: str, found: np.ndarray) -> pa.RecordBatch:
    """The rows of a batch whose id the bit map passes."""
    at = _slot(batch.column(column), 8 * len(found))
    return batch.filter(pa.array((found[at >> 3] >> (7 - (at & 7)) & 1).astype(bool)))


def passing(rows: DataFrame, column: str, found: np.ndarray) -> DataFrame:
    """The rows whose id the bit map passes."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield passed(b, column, found)

    return rows.mapInArrow(run, rows.schema)
