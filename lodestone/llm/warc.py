"""WARC archives as a chunked record table.

Every record is a run of rows ``record, chunk, last, sha1, data``. The data of
a record's rows, in order of chunk, are the bytes of one WARC/1.1 record; no
row holds more than ``chunk_bytes`` of its payload. ``sha1`` is the digest of
the payload up to and with the row, carried from row to row, so a reader checks
each row as it comes and never holds a whole record. Payloads are cut in the
JVM, so no Python worker holds a whole one either; the source table's own cell
is all there is of it. ``import_stream`` reads any WARC file, plain or gzip,
piece by piece into such rows; ``export`` gives back a file's bytes.

Of records with equal payloads of at least ``dedup_bytes`` bytes, the one with
the smallest page_id is a response and the others are revisits, which name it
by WARC-Refers-To, its target URI and date.

Nulls and edges: a null html is an empty payload; rows that repeat the smallest
page_id are all responses, with one record id; a null page_id is written and
read back as null, and is the smallest only among nulls; a payload of any
length is cut; line breaks in a url become spaces; an empty table gives no
records; columns other than page_id, url and html are not read, so their names
can't clash.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.session import map_arrow
from lodestone.sources.scratch import materialize, scratch_path

CHUNK = 1 << 18
SCHEMA = "record long, chunk int, last boolean, sha1 binary, data binary"
NAMES = ["record", "chunk", "last", "sha1", "data"]
FACTS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = b"\r\n\r\n"
DATE = "1970-01-01T00:00:00Z"
PAGE = re.compile(rb"<urn:lodestone:page:(-?\d+)>")


def _id(page) -> str:
    return f"<urn:lodestone:page:{'' if page is None else page}>"


def _uri(url: str | None) -> str:
    return re.sub(r"[\r\n]+", " ", url or "")


def _header(page, url: str | None, digest: str, size: int, sent: int, refers, refers_url: str | None) -> bytes:
    """WARC and HTTP headers of a record whose payload is ``size`` bytes, of which ``sent`` follow."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers is None else 'revisit'}", f"WARC-Record-ID: {_id(page)}", f"WARC-Target-URI: {_uri(url)}", f"WARC-Date: {DATE}"]
    if refers is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_id(refers)}", f"WARC-Refers-To-Target-URI: {_uri(refers_url)}", f"WARC-Refers-To-Date: {DATE}"]
    lines += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + sent}"]
    return "\r\n".join(lines).encode() + END + http


def _batched(rows: Iterator[tuple], limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.int32(), pa.bool_(), pa.binary(), pa.binary()]
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += len(row[4])
        if size >= limit:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], NAMES)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], NAMES)


def records(pages: DataFrame, dedup_bytes: int = 0, chunk_bytes: int = CHUNK) -> DataFrame:
    """The chunked record table of ``pages(page_id, url, html)``."""
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    source = pages.select(F.col("page_id").cast("long"), "url", payload.alias("payload")).withColumn("sha", F.sha1("payload"))
    known = F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))
    copies = source.where(F.octet_length("payload") >= dedup_bytes).groupBy("sha").agg(F.min(known).alias("first"), F.count("*").alias("n"))
    copies = materialize(copies.where("n > 1").drop("n"), "copies")  # its size is then known to the planner
    refers = F.when(F.octet_length("payload") >= dedup_bytes, F.expr("case when first.page_id < page_id or page_id is null then first end"))
    marked = source.join(copies, "sha", "left").withColumn("refers", refers).withColumn("size", F.octet_length("payload").cast("long"))
    marked = marked.withColumn("sent", F.when(F.col("refers.page_id").isNull(), F.col("size")).otherwise(F.lit(0)))
    chunks = F.greatest(F.ceil(F.col("sent") / chunk_bytes), F.lit(1)).cast("int")
    cut = marked.withColumn("chunk", F.explode(F.sequence(F.lit(0), chunks - 1))).select(
        "page_id", "url", "sha", "size", "sent", "refers.page_id", "refers.url", "chunk", (F.col("chunk") == chunks - 1).alias("last"),
        F.substring("payload", F.col("chunk") * chunk_bytes + 1, F.when(F.col("sent") > 0, chunk_bytes).otherwise(0)).alias("data"),
    ).toDF("page_id", "url", "sha", "size", "sent", "refers", "refers_url", "chunk", "last", "data")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> Iterator[tuple]:
            record, digest, head = (TaskContext.get().partitionId() << 33) - 1, None, b""
            for b in batches:
                for row in zip(*b.columns, strict=True):
                    page, url, sha, size, sent, refers, refers_url, chunk, last, data = (x.as_py() for x in row)
                    if chunk == 0:
                        record, digest = record + 1, hashlib.sha1()
                        head = _header(page, url, base64.b32encode(bytes.fromhex(sha)).decode(), size, sent, refers, refers_url)
                    digest.update(data)
                    yield record, chunk, last, digest.digest(), head + data + (END if last else b"")
                    head = b""

        yield from _batched(made())

    return map_arrow(cut, run, SCHEMA)


def write(pages: DataFrame, path: str, **kwargs) -> None:
    records(pages, **kwargs).write.option("compression", "zstd").parquet(path)


def _value(head: bytes, name: bytes) -> bytes | None:
    found = re.search(rb"(?im)^" + re.escape(name) + rb":[ \t]*(.*?)\r?$", head)
    return found[1] if found else None


def _page(value: bytes | None) -> int | None:
    found = PAGE.search(value or b"")
    return int(found[1]) if found else None


class _Record:
    """Facts of a record, fed row by row."""

    def __init__(self, data: bytes, last: bool):
        warc, _, rest = data.partition(END)
        http, _, _ = rest.partition(END)
        self.type = _value(warc, b"WARC-Type").decode()
        self.page, self.refers = _page(_value(warc, b"WARC-Record-ID")), _page(_value(warc, b"WARC-Refers-To"))
        self.digest = _value(warc, b"WARC-Payload-Digest").decode().removeprefix("sha1:")
        self.size = int(_value(http, b"Content-Length"))
        self.sha, self.seen, self.chunk = hashlib.sha1(), 0, 0
        self.start = len(warc) + len(http) + 2 * len(END)

    def feed(self, chunk: int, last: bool, sha: bytes, data: bytes) -> None:
        if chunk != self.chunk:
            raise ValueError(f"record of page {self.page}: chunk {self.chunk} is missing")
        body = memoryview(data)[self.start if chunk == 0 else 0 : len(data) - len(END) if last else len(data)]
        self.sha.update(body)
        self.seen += len(body)
        self.chunk += 1
        if self.sha.digest() != sha:
            raise ValueError(f"record of page {self.page}: chunk {chunk} is damaged")

    def facts(self) -> tuple:
        if self.type == "response" and (self.seen != self.size or base64.b32encode(self.sha.digest()).decode() != self.digest):
            raise ValueError(f"record of page {self.page}: payload and header differ")
        return self.page, self.size, self.digest, self.type, self.refers


def read(spark: SparkSession, path: str) -> DataFrame:
    """Facts of every record, read from its rows in order with every digest checked."""
    table = spark.read.schema(SCHEMA).parquet(path)
    ordered = table.repartition("record").sortWithinPartitions("record", "chunk")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_record: _Record | None = None
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        for b in batches:
            done = []
            for _, chunk, last, sha, data in zip(*b.columns, strict=True):
                data, last = data.as_py(), last.as_py()
                if chunk.as_py() == 0:
                    open_record = _Record(data, last)
                open_record.feed(chunk.as_py(), last, sha.as_py(), data)
                if last:
                    done.append(open_record.facts())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], [f.split()[0] for f in FACTS.split(", ")])

    return map_arrow(ordered, run, FACTS)


def import_stream(stream: BinaryIO, chunk_bytes: int = CHUNK, first_record: int = 0) -> Iterator[tuple]:
    """Rows of the records of a WARC file, plain or gzip, read piece by piece."""
    head = stream.read(2)
    stream.seek(0)
    source = gzip.GzipFile(fileobj=stream) if head == b"\x1f\x8b" else stream
    record = first_record
    while True:
        line = source.readline()
        while line in (b"\r\n", b"\n"):
            line = source.readline()
        if not line:
            return
        header = line
        while line not in (b"\r\n", b"\n", b""):
            line = source.readline()
            header += line
        left = int(_value(header, b"Content-Length") or 0)
        block = b""
        if b"application/http" in (_value(header, b"Content-Type") or b""):
            while left and not block.endswith(END):
                got = source.readline(left)
                if not got:
                    break
                block += got
                left -= len(got)
        sha, data, chunk = hashlib.sha1(), header.replace(b"\r\n", b"\n").replace(b"\n", b"\r\n") + block, 0
        while left:
            part = source.read(min(left, chunk_bytes))
            if not part:
                raise EOFError("the archive ends inside a record")
            if len(data) + len(part) > chunk_bytes and data:
                yield record, chunk, False, sha.digest(), data
                data, chunk = b"", chunk + 1
            sha.update(part)
            data += part
            left -= len(part)
        yield record, chunk, True, sha.digest(), data + END
        record += 1


def export(table: DataFrame) -> Iterator[bytes]:
    """Bytes of a WARC file of the records of ``table``, for files of a size that one process writes: rows come in order, a partition at a time."""
    for row in table.orderBy("record", "chunk").toLocalIterator():
        yield bytes(row["data"])


def round_trip(pages: DataFrame, **kwargs) -> DataFrame:
    """Write the archives, read them back, and give the facts of every record."""
    path = scratch_path(pages.sparkSession, "warc")
    write(pages, path, **kwargs)
    return read(pages.sparkSession, path)
