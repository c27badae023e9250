"""Archives as files: chunks, headers, import and export."""

from __future__ import annotations

import gzip
import hashlib
import io

import pytest

from lodestone.llm import warc

PAGES = "page_id long, url string, html string, chunk string, data string"


def pages() -> list[tuple]:
    long = "".join(f"<p>line {i} \u00e9</p>\n" for i in range(3000))
    texts = [(5, "http://a.org/5", long), (3, "http://a.org/3", long), (9, "http://b.org/\r\nX: 1", "short"), (None, None, long), (7, "u", None), (8, "u", ""), (9, "v", "other")]
    return [(*t, "x", "y") for t in texts]


def test_rows_are_bounded_and_digests_carried(spark):
    table = warc.records(spark.createDataFrame(pages(), PAGES), chunk_bytes=1000)
    rows = sorted(table.collect(), key=lambda r: (r.record, r.chunk))
    assert max(len(r.data) for r in rows) < 1000 + 700
    responses = 0
    for record in {r.record for r in rows}:
        own = [r for r in rows if r.record == record]
        assert [r.chunk for r in own] == list(range(len(own))) and [r.last for r in own] == [False] * (len(own) - 1) + [True]
        whole = b"".join(bytes(r.data) for r in own)
        warc_head, http, body = whole.removesuffix(warc.END).split(warc.END, 2)
        assert bytes(own[-1].sha1) == hashlib.sha1(body).digest()
        assert f"Content-Length: {len(http) + len(warc.END) + len(body)}".encode() in warc_head
        responses += b"WARC-Type: response" in warc_head
        if b"WARC-Type: revisit" in warc_head:
            first, url = (b"7", b"u") if b"<urn:lodestone:page:8>" in warc_head else (b"3", b"http://a.org/3")
            assert b"WARC-Refers-To: <urn:lodestone:page:" + first + b">" in warc_head and b"WARC-Refers-To-Target-URI: " + url in warc_head and body == b""
    assert responses == 4  # page 3, both rows of page 9, page 7


@pytest.mark.parametrize("packed", [False, True])
def test_files_go_out_and_come_in(spark, packed):
    table = warc.records(spark.createDataFrame(pages(), PAGES), chunk_bytes=1000)
    data = b"".join(warc.export(table))
    source = gzip.compress(data) if packed else data
    rows = list(warc.import_stream(io.BytesIO(source), chunk_bytes=700))
    assert b"".join(r[4] for r in rows) == data
    assert max(len(r[4]) for r in rows) < 700 + 700
    assert {r[3] for r in rows if r[2]} >= {bytes(r.sha1) for r in table.where("last").collect()}


def test_a_cut_file_is_an_error():
    head = b"WARC/1.1\r\nContent-Type: text/plain\r\nContent-Length: 10\r\n\r\n"
    with pytest.raises(EOFError):
        list(warc.import_stream(io.BytesIO(head + b"abc")))
    rows = list(warc.import_stream(io.BytesIO(head + b"0123456789" + warc.END), chunk_bytes=4))
    assert b"".join(r[4] for r in rows) == head + b"0123456789" + warc.END


def test_damage_is_found(spark):
    from pyspark.errors import PySparkException
    from pyspark.sql import functions as F

    from lodestone.sources.scratch import scratch_path

    path = scratch_path(spark, "warc")
    table = warc.records(spark.createDataFrame(pages(), PAGES), chunk_bytes=1000)
    table.withColumn("data", F.when(F.col("chunk") == 2, F.concat(F.col("data"), F.lit(b"!"))).otherwise(F.col("data"))).write.parquet(path)
    with pytest.raises(PySparkException, match="damaged"):
        warc.read(spark, path).collect()
