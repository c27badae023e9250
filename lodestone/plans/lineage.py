"""Lineage and currentness queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import lineage as L
from lodestone.plans.registry import fixture, query
from lodestone.sources.tables import table

LATEST = """
    newest as (select * from (select *, row_number() over (partition by project_id, artifact_type order by version desc, created_at desc, id desc) as rn from artifacts) where rn = 1),
    state as (select a.*, a.id = n.id as is_latest, a.source_revision is not distinct from r.source_revision and a.library_revision is not distinct from r.library_revision as inputs_match
      from artifacts a join newest n using (project_id, artifact_type) left join revisions r on r.project_id = a.project_id)"""
BOTH = ("artifacts", "revisions")


def _both(spark, d):
    return fixture(spark, d, "artifacts"), fixture(spark, d, "revisions")


@query(f"with {LATEST} select project_id, artifact_type, id, version from newest", BOTH)
def latest_artifact_per_type(spark, d):
    return L.latest(fixture(spark, d, "artifacts")).select("project_id", "artifact_type", "id", "version")


@query(f"with {LATEST} select id, project_id, artifact_type, version, is_latest, inputs_match, is_latest and inputs_match as is_current from state", BOTH)
def artifact_currentness(spark, d):
    return L.with_currentness(*_both(spark, d)).select("id", "project_id", "artifact_type", "version", "is_latest", "inputs_match", "is_current")


@query(
    f"""with {LATEST}, ranked as (select *, row_number() over (partition by project_id order by created_at desc, id) as k from state where is_latest and inputs_match)
    select project_id, string_agg(id || ':' || artifact_type || ':' || version, ';' order by created_at desc, id) as manifest from ranked where k <= 4 group by project_id""",
    BOTH,
)
def knowledge_manifest_topk(spark, d):
    found = L.knowledge_manifest(*_both(spark, d))
    line = F.transform("manifest", lambda e: F.concat_ws(":", e["id"], e["artifact_type"], e["version"]))
    return found.select("project_id", F.array_join(line, ";").alias("manifest"))


@query(
    f"""with {LATEST} select project_id, string_agg(artifact_type || ':' || id || ':' || version || ':' || inputs_match, ';' order by artifact_type) as types from state where is_latest group by project_id""",
    BOTH,
)
def authority_summary(spark, d):
    line = F.transform("types", lambda e: F.concat_ws(":", e["artifact_type"], e["id"], e["version"], e["source_is_current"]))
    return L.authority(*_both(spark, d)).select("project_id", F.array_join(line, ";").alias("types"))


@query(
    f"""with {LATEST}, own as (select project_id, list(id order by id) as now from state where is_latest and inputs_match group by 1),
    recorded as (select project_id, list(id order by id) as then_ids from newest where source_revision = 0 group by 1)
    select coalesce(own.project_id, recorded.project_id) as project_id, now is not distinct from then_ids as matches from own full join recorded on own.project_id = recorded.project_id""",
    BOTH,
)
def manifest_currentness(spark, d):
    artifacts, revisions = _both(spark, d)
    now = L.with_currentness(artifacts, revisions).where("is_current").groupBy("project_id").agg(F.collect_list("id").alias("now"))
    recorded = L.latest(artifacts).where("source_revision = 0").groupBy("project_id").agg(F.collect_list("id").alias("then_ids"))
    return now.join(recorded, "project_id", "full").select("project_id", L.manifest_matches(F.col("then_ids"), F.col("now")).alias("matches"))


@query(
    """select project_id, source_revision + coalesce(n, 0) as source_revision, coalesce(n, 0) as steps from revisions
    left join (select o_custkey as project_id, count(*) as n from orders join lineitem on l_orderkey = o_orderkey where l_returnflag = 'R' group by 1) using (project_id)""",
    ("revisions",),
)
def revision_propagation(spark, d):
    lines = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    changes = table(spark, d, "orders").join(lines, "o_orderkey").select(F.col("o_custkey").alias("project_id"))
    return L.propagate(fixture(spark, d, "revisions"), changes)


@query(f"with {LATEST} select id, project_id from newest where project_id not in (select o_custkey from orders where o_orderstatus = 'P')", BOTH)
def surviving_derived(spark, d):
    changed = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("project_id"))
    return L.surviving(L.latest(fixture(spark, d, "artifacts")), changed).select("id", "project_id")


@query("select project_id, artifact_type, max(version) + 1 as next_version from artifacts group by all", ("artifacts",))
def version_allocator(spark, d):
    return L.next_versions(fixture(spark, d, "artifacts"))


@query(
    f"""with {LATEST}, edits as (select l_orderkey * 10 + l_linenumber as edit_id, l_orderkey + case when l_linenumber = 7 then 10000000 else 0 end as parent_id from lineitem)
    select edit_id, parent_id, case when is_latest is null then 'parent_missing' when not is_latest then 'parent_not_latest' when not inputs_match then 'parent_stale' end as code from edits left join state on id = parent_id""",
    BOTH,
)
def version_guards(spark, d):
    edits = table(spark, d, "lineitem").select(
        F.expr("l_orderkey * 10 + l_linenumber").alias("edit_id"), F.expr("l_orderkey + case when l_linenumber = 7 then 10000000 else 0 end").alias("parent_id")
    )
    return L.version_guard(edits, *_both(spark, d))


@query(
    """with h as (select conv_id, turn, text, lag(text) over (partition by conv_id, role order by turn, text) as previous from conversations)
    select conv_id, turn, md5(text) as text_md5, md5(previous) as previous_md5 from h where previous is not null and previous <> '' and previous is distinct from text"""
)
def section_history(spark, d):
    found = L.history(table(spark, d, "conversations"), ["conv_id", "role"], ["turn", "text"], "text")
    return found.select("conv_id", "turn", F.md5("text").alias("text_md5"), F.md5("previous").alias("previous_md5"))


@query(
    """select s_nationkey as project_id, c as role_count, first_id, demoted from (
      select s_nationkey, count(*) as c, min(s_suppkey) as first_id, count(*) - 1 as demoted from supplier group by 1)"""
)
def primary_demotion(spark, d):
    """One primary a role: all but the first of each group are demoted."""
    grouped = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("project_id"))
    return grouped.agg(F.count("*").alias("role_count"), F.min("s_suppkey").alias("first_id"), (F.count("*") - 1).alias("demoted"))


@query("select doc_id, sha256(coalesce(source, '') || chr(31) || coalesce(lang, '') || chr(31) || coalesce(text, '')) as snapshot from documents")
def source_snapshot_hash(spark, d):
    """Snapshot hash: SHA-256 of the fields joined by a separator that no field has."""
    fields = F.concat_ws("\x1f", *[F.coalesce(c, F.lit("")) for c in ("source", "lang", "text")])
    return table(spark, d, "documents").select("doc_id", F.sha2(fields, 256).alias("snapshot"))
