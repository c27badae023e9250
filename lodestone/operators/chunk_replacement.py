"""Replacing the chunks of documents: each request is checked whole, and only sound ones change the stored chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.sources.versioned import VersionedTable

KEY = ["source_type", "source_id"]
# Kinds of sources and the codes of what is wrong with a request.
SOURCES = ["project_document", "service_document"]
INVALID, MISSING, UNKNOWN, CHANGED = "23514", "23502", "23503", "40001"


def checked_requests(requests: DataFrame, rows: DataFrame, sources: DataFrame) -> DataFrame:
    """``source_type, source_id, code``: null where a request may go through, else what is wrong first.

    requests: ``source_type, source_id, fingerprint, revision, chunks``; rows:
    the new chunks with ``chunk_index``; sources: ``source_type, source_id,
    revision`` of the documents there are. A request is sound if its source
    exists at the revision that it was made from, it has as many chunks as it
    says, and their indexes are 0, 1, 2 ... without a gap or a repeat.

    Nulls and edges: a null id, fingerprint, revision or count is wrong; so are two requests for one source; no chunks are sound if none are said.
    """
    facts = rows.groupBy(*KEY).agg(F.count("*").alias("_n"), F.count("chunk_index").alias("_named"), F.countDistinct("chunk_index").alias("_distinct"), F.min("chunk_index").alias("_first"), F.max("chunk_index").alias("_last"))
    there = sources.select(*KEY, F.col("revision").alias("_revision"))
    twice = requests.groupBy(*KEY).agg(F.count("*").alias("_requests"))
    joined = requests.join(facts, KEY, "left").join(there, KEY, "left").join(twice, KEY, "left")
    n = F.coalesce("_n", F.lit(0))
    gapless = (n == 0) | ((F.col("_named") == n) & (F.col("_distinct") == n) & (F.col("_first") == 0) & (F.col("_last") == n - 1))
    bad = ~F.coalesce(F.col("source_type").isin(SOURCES), F.lit(False))
    code = F.when(bad, INVALID).when(F.col("source_id").isNull(), MISSING).when(~F.coalesce(F.col("fingerprint").rlike("^[0-9a-f]{64}$"), F.lit(False)), INVALID)
    code = code.when(~F.coalesce((F.col("revision") >= 0) & (F.col("chunks") >= 0), F.lit(False)), INVALID).when((F.col("_requests") > 1) | (n != F.col("chunks")), INVALID)
    code = code.when(F.col("_revision").isNull(), UNKNOWN).when(F.col("_revision") != F.col("revision"), CHANGED).when(~gapless, INVALID)
    return joined.select(*KEY, code.alias("code"))


def replace_chunks(store: VersionedTable, requests: DataFrame, rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Replace the stored chunks of all sound requests in one version; returns ``checked_requests``.

    Sources whose request is not sound keep their old chunks. Readers see all of
    the change or nothing. If another writer commits in between, nothing is
    changed and ``ConflictError`` is raised.
    """
    base = store.version()
    checked = checked_requests(requests, rows, sources)
    sound = checked.where("code is null").select(*KEY)
    fresh = rows.join(sound, KEY, "left_semi").join(requests.select(*KEY, F.col("fingerprint").alias("source_fingerprint")), KEY)
    store.replace(sound, fresh.select(*store.schema.fieldNames()), base)
    return checked
