"""WARC archives with resolved revisits.

Headers alone (identifier, url, digest, size) are shuffled by payload digest: the largest identifier of equal payloads is
the original, every other record is joined to it and becomes a revisit.  Revisits are written from these headers.  All
other pages are responses: a pass over the pages leaves the revisits out and writes the payloads where they lie.  Up to
`most_broadcast` revisits are broadcast for that; beyond, pages and revisits are joined by a shuffle on identifier and digest.

Files hold gzip members, one for each record, with an empty member (`BETWEEN`) after each, which is also the separator
that Spark's text writer puts and its reader splits by: files are read by record, whatever their size.

Edge cases: a null payload is empty; payloads under `least_bytes` are always responses; repeated rows each give a
record, and of rows that share the original's identifier each is a response; a record with a null identifier is
a response and never an original; line ends in a url are written as %0D and %0A; an empty table gives no record.
Identifiers are longs, or texts of numbers; other columns are left out.
"""

from __future__ import annotations

import datetime
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bookloom.llm.common import materialise

END = "\r\n"
#: A gzip member without content.
BETWEEN = bytes.fromhex("1f8b08000000000000ff0300" + "00" * 8)
RECORD = "record_id long, uri string, record_type string, payload_digest string, payload_bytes long, refers_to long, payload binary"
_HEADER = "record_id long, uri string, record_type string, payload_digest string, payload_bytes long, refers_to long, refers_uri string"


def headers(records: DataFrame) -> DataFrame:
    """records: record_id, uri, payload (string or null).  Their headers, without payloads."""
    payload = F.coalesce("payload", F.lit(""))
    return records.select(F.col("record_id").cast("long").alias("record_id"), "uri", F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha1(F.encode(payload, "UTF-8")).alias("payload_digest"))


def revisits(heads: DataFrame, least_bytes: int = 1000) -> DataFrame:
    """The headers of records whose payload an original with a larger identifier has, with refers_to and refers_uri."""
    large = heads.where((F.col("payload_bytes") >= least_bytes) & F.col("record_id").isNotNull())
    same = large.groupBy("payload_digest").agg(F.max(F.struct("record_id", "uri")).alias("original"), F.count(F.lit(1)).alias("n")).where("n > 1")
    found = large.join(same, "payload_digest").where(F.col("original.record_id") != F.col("record_id"))
    return found.select("record_id", "uri", F.lit("revisit").alias("record_type"), "payload_digest", "payload_bytes", F.col("original.record_id").alias("refers_to"), F.col("original.uri").alias("refers_uri"))


def _http(size: Column) -> Column:
    return F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "), size.cast("string"), F.lit(END + END))


def _head(date: str) -> Column:
    """The lines of a record's header but for its type's first lines, which need an identifier of their own."""

    def clean(uri: str) -> Column:
        return F.regexp_replace(F.regexp_replace(F.coalesce(uri, F.lit("")), "\r", "%0D"), "\n", "%0A")

    def line(name: str, value: Column) -> Column:
        return F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(END)), F.lit(""))

    again = F.concat(F.lit(f"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{END}"), line("WARC-Refers-To-Target-URI", clean("refers_uri")), line("Page-Refers-To", F.col("refers_to")))
    return F.concat(
        F.lit(f"WARC-Date: {date}{END}"), line("WARC-Target-URI", clean("uri")), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "payload_digest")), line("Page-ID", F.col("record_id")),
        F.when(F.col("record_type") == "revisit", again).otherwise(F.lit("")), F.lit(f"Content-Type: application/http; msgtype=response{END}"),
    )


def _gzip(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _members(rows: DataFrame) -> DataFrame:
    """rows: record_type, head, block.  A gzip member of each record, as a text of any bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        for b in batches:
            kinds, heads, blocks = (b.column(c) for c in ("record_type", "head", "block"))
            packed: list[bytes] = []
            size = 0
            for i in range(b.num_rows):
                kind, head, block = kinds[i].as_py(), heads[i].as_py(), blocks[i].as_py().encode()
                name = uuid.uuid5(uuid.NAMESPACE_URL, f"{kind} {part} {n} {head}")  # a task that runs again gives the same names
                n += 1
                packed.append(_gzip(b"".join([f"WARC/1.1{END}WARC-Type: {kind}{END}WARC-Record-ID: <urn:uuid:{name}>{END}{head}Content-Length: {len(block)}{END}{END}".encode(), block, b"\r\n\r\n"])))
                size += len(packed[-1])
                if size > 2 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(packed, pa.binary())], ["member"])
                    packed, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(packed, pa.binary())], ["member"])

    return rows.mapInArrow(run, "member binary").select(F.col("member").cast("string").alias("value"))


def write_archives(records: DataFrame, path: str, least_bytes: int = 1000, date: str | None = None, records_per_file: int = 20_000, most_broadcast: int = 2_000_000) -> None:
    """records: record_id, uri, payload.  Two folders under path: responses and revisits."""
    date = date or datetime.datetime.now(datetime.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    again = materialise(revisits(headers(records), least_bytes), "revisits")
    left_out = again.select("record_id", "payload_digest").distinct()
    payload = F.coalesce("payload", F.lit(""))
    pages = headers(records.withColumn("payload", payload)).columns
    whole = records.select(F.col("record_id").cast("long").alias("record_id"), "uri", payload.alias("payload"), F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha1(F.encode(payload, "UTF-8")).alias("payload_digest"))
    few = again.count() <= most_broadcast
    kept = whole.join(F.broadcast(left_out) if few else left_out.hint("merge"), ["record_id", "payload_digest"], "left_anti").select(*pages, "payload")
    kept = kept.withColumns({"record_type": F.lit("response"), "refers_to": F.lit(None).cast("long"), "refers_uri": F.lit(None).cast("string")})
    for rows, block, folder in ((kept, F.concat(_http(F.col("payload_bytes")), "payload"), "responses"), (again, _http(F.col("payload_bytes")), "revisits")):
        members = _members(rows.select("record_type", _head(date).alias("head"), block.alias("block")))
        members.write.option("lineSep", BETWEEN.decode("latin-1")).option("encoding", "ISO-8859-1").option("maxRecordsPerFile", records_per_file).text(f"{path}/{folder}")


def parse(data: bytes) -> tuple:
    """A record in RECORD's order; digest and size of a response are those of its payload, of a revisit those in its headers."""
    cut = data.index(b"\r\n\r\n")
    head = dict(line.split(b": ", 1) for line in data[:cut].split(b"\r\n")[1:])
    begin = cut + 4
    end = begin + int(head[b"Content-Length"])
    inner = data.index(b"\r\n\r\n", begin, end)
    kind, page, refers = head[b"WARC-Type"].decode(), head.get(b"Page-ID"), head.get(b"Page-Refers-To")
    if kind == "revisit":
        http = dict(line.split(b": ", 1) for line in data[begin:inner].split(b"\r\n")[1:])
        digest, size, payload = head[b"WARC-Payload-Digest"].decode().removeprefix("sha1:"), int(http[b"Content-Length"]), None
    else:
        payload = data[inner + 4 : end]
        digest, size = hashlib.sha1(payload).hexdigest(), len(payload)
    return int(page) if page else None, head[b"WARC-Target-URI"].decode(), kind, digest, size, int(refers) if refers else None, payload


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """RECORD's columns of every record."""
    types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
    names = [c.split(" ")[0] for c in RECORD.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            size = 0
            for member in b.column("member"):
                r = parse(zlib.decompress(member.as_py(), 31))
                rows.append(r if payloads else (*r[:6], None))
                size += len(r[6] or b"") if payloads else 0
                if size > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    text = spark.read.schema("value string").option("lineSep", BETWEEN.decode("latin-1")).option("encoding", "ISO-8859-1").option("recursiveFileLookup", True).text(path)
    return text.select(F.col("value").cast("binary").alias("member")).mapInArrow(run, RECORD)
