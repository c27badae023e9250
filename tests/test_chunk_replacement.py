"""Versions of a keyed table, and chunks that are replaced whole or not at all."""

from __future__ import annotations

import pytest

from lodestone.operators.chunk_replacement import checked_requests, replace_chunks
from lodestone.sources.versioned import ConflictError, VersionedTable

SCHEMA = "source_type string, source_id long, chunk_index int, text string, source_fingerprint string"
PRINT = "0" * 63 + "a"


def rows_of(df):
    return sorted(map(tuple, df.collect()))


@pytest.fixture
def store(spark, tmp_path):
    schema = spark.createDataFrame([], SCHEMA).schema
    return VersionedTable(spark, f"file://{tmp_path}/t", schema, ["source_type", "source_id"], buckets=4)


def chunks(spark, *rows):
    return spark.createDataFrame([("project_document", i, k, t, "old") for i, k, t in rows], SCHEMA)


def test_versions(spark, store):
    assert store.version() == 0 and store.read().isEmpty()
    first = chunks(spark, *[(i, k, f"{i}.{k}") for i in range(20) for k in range(2)])
    assert store.upsert(first) == 1
    assert store.upsert(chunks(spark, (3, 0, "new"), (99, 0, "more"))) == 2
    assert store.delete(chunks(spark, (5, 0, ""))) == 3
    expected = {(i, k): f"{i}.{k}" for i in range(20) for k in range(2) if i not in (3, 5)} | {(3, 0): "new", (99, 0): "more"}
    assert {(r.source_id, r.chunk_index): r.text for r in store.read().collect()} == expected
    assert rows_of(store.read(1)) == rows_of(first) and store.read(2).count() == 40
    with pytest.raises(ConflictError):
        store.replace(first, first, base=2)
    assert store.version() == 3 and store.read().count() == len(expected)
    store.vacuum()
    assert {(r.source_id, r.chunk_index): r.text for r in store.read().collect()} == expected
    assert store.delete(first.unionByName(chunks(spark, (99, 0, "")))) == 4 and store.read().isEmpty()


def test_a_writer_that_fails_changes_nothing(spark, store):
    store.upsert(chunks(spark, (1, 0, "a")))
    broken = chunks(spark, (1, 0, "b")).selectExpr("source_type", "source_id", "cast(raise_error('broken') as int) as chunk_index", "text", "source_fingerprint")
    with pytest.raises(Exception, match="broken"):
        store.upsert(broken)
    assert store.version() == 1 and [r.text for r in store.read().collect()] == ["a"]


REQUESTS = "source_type string, source_id long, fingerprint string, revision long, chunks int"
SOURCES = "source_type string, source_id long, revision long"


def test_only_sound_requests_go_through(spark, store):
    store.upsert(chunks(spark, *[(i, 0, f"old {i}") for i in range(1, 12)]))
    doc = "project_document"
    requests = [
        (doc, 1, PRINT, 7, 2), (doc, 2, PRINT, 6, 1), (doc, 3, PRINT, 7, 2), (doc, 4, PRINT, 7, 2), (doc, 5, PRINT, 7, 3), (doc, 6, "A" * 64, 7, 1), (doc, 7, PRINT, 7, 0),
        (doc, 8, PRINT, None, 1), ("note", 9, PRINT, 7, 1), (doc, 77, PRINT, 7, 1), (doc, 10, PRINT, 7, 1), (doc, 10, PRINT, 7, 1), (doc, None, PRINT, 7, 0), (doc, 12, PRINT, 7, -1),
    ]
    new = [(doc, i, k, f"new {i}.{k}") for i, ks in {1: [0, 1], 2: [0], 3: [0, 2], 4: [1, 1], 5: [0, 1], 6: [0], 8: [0], 77: [0], 10: [0]}.items() for k in ks]
    rows, sources = spark.createDataFrame(new, "source_type string, source_id long, chunk_index int, text string"), spark.createDataFrame([(doc, i, 7) for i in range(1, 13)], SOURCES)
    codes = replace_chunks(store, spark.createDataFrame(requests, REQUESTS), rows, sources)
    got = {(r.source_type, r.source_id): r.code for r in codes.collect()}
    assert {i: got[doc, i] for i in (1, 2, 3, 4, 5, 6, 7, 8, 77, 10, None, 12)} == {1: None, 2: "40001", 3: "23514", 4: "23514", 5: "23514", 6: "23514", 7: None, 8: "23514", 77: "23503", 10: "23514", None: "23502", 12: "23514"}
    assert got["note", 9] == "23514"
    left = {(r.source_id, r.chunk_index): (r.text, r.source_fingerprint) for r in store.read().collect()}
    assert left == {(1, 0): ("new 1.0", PRINT), (1, 1): ("new 1.1", PRINT)} | {(i, 0): (f"old {i}", "old") for i in range(2, 12) if i != 7}
    assert checked_requests(spark.createDataFrame([], REQUESTS), rows, sources).isEmpty()
