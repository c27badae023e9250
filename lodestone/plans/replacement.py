"""Chunks replaced by requests, as they stand in the store afterwards."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators.chunk_replacement import replace_chunks
from lodestone.plans.registry import fixture, query
from lodestone.sources.scratch import scratch_path
from lodestone.sources.versioned import VersionedTable

REPLACED = """with codes as (
  select r.source_type, r.source_id, case when r.source_type not in ('project_document', 'service_document') then '23514' when not regexp_matches(r.fingerprint, '^[0-9a-f]{64}$') then '23514' when r.chunks < 0 or coalesce(n, 0) <> r.chunks then '23514'
    when s.revision is null then '23503' when s.revision <> r.revision then '40001' when n > 0 and not (d = n and lo = 0 and hi = n - 1) then '23514' end as code, r.fingerprint
  from chunk_requests r left join (select source_type, source_id, count(*) as n, count(distinct chunk_index) as d, min(chunk_index) as lo, max(chunk_index) as hi from chunk_rows group by 1, 2) using (source_type, source_id)
  left join chunk_sources s using (source_type, source_id)
), kept as (
  select source_type, source_id, chunk_index, text, 'first' as source_fingerprint from chunk_first anti join (select * from codes where code is null) using (source_type, source_id)
  union all select source_type, source_id, chunk_index, text, fingerprint from chunk_rows join codes using (source_type, source_id) where code is null
)
select source_type, source_id, count(*) as chunks, md5(string_agg(text, '|' order by chunk_index)) as text_md5, min(source_fingerprint) as fingerprint, any_value(code) as code from kept left join codes using (source_type, source_id) group by 1, 2"""


@query(REPLACED, ("chunk_first", "chunk_rows", "chunk_requests", "chunk_sources"))
def replaced_chunks(spark, d):
    """The chunks of every source after a batch of requests, sound and unsound, with the code of its request."""
    first, rows, requests, sources = (fixture(spark, d, n) for n in ("chunk_first", "chunk_rows", "chunk_requests", "chunk_sources"))
    first = first.withColumn("source_fingerprint", F.lit("first"))
    store = VersionedTable(spark, scratch_path(spark, "chunks"), first.schema, ["source_type", "source_id"], buckets=16)
    store.upsert(first)
    codes = replace_chunks(store, requests, rows, sources)
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "text"))), lambda x: x["text"]), "|")
    found = store.read().groupBy("source_type", "source_id").agg(F.count("*").alias("chunks"), F.md5(texts).alias("text_md5"), F.min("source_fingerprint").alias("fingerprint"))
    return found.join(codes, ["source_type", "source_id"], "left")
