"""Currentness of evaluations, knowledge manifests and summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import currentness as C
from lodestone.plans.registry import fixture, query

LATEST = """latest as (select * exclude (rn) from (select *, row_number() over (partition by project_id, artifact_type order by version desc, created_at desc, id desc) as rn from generated) where rn = 1)"""
DEP = """dep as (select * exclude (rn) from (select e.*, row_number() over (partition by e.project_id order by e.updated_at desc, e.id desc) as rn from evaluations e
  where mode <> 'generated_artifact' or exists (select 1 from generated g where g.id = e.evaluated_id and g.project_id = e.project_id)) where rn = 1)"""
CAND = """cand as (select l.* from latest l join revisions r on l.project_id = r.project_id and l.source_revision = r.source_revision and l.library_revision = r.library_revision left join dep d on d.project_id = l.project_id
  where not l.used_evaluation or d.evaluated_id = l.id or (l.input_evaluation_id = d.id and l.input_evaluation_at = d.updated_at and l.input_evaluation_hash = d.content_hash))"""
MANIFEST = """own as (select distinct project_id, artifact_type as target from generated),
  taken as (select * from (select o.project_id, o.target, c.id, row_number() over (partition by o.project_id, o.target order by c.created_at desc, c.id desc) as place from own o join cand c on c.project_id = o.project_id and c.artifact_type <> o.target)
    where place <= case when target = 'gjennomforing_og_risiko' then 2 else 4 end),
  man as (select o.project_id, o.target as artifact_type, coalesce(string_agg(t.id::varchar, ',' order by place), '') as manifest from own o left join taken t on t.project_id = o.project_id and t.target = o.target group by 1, 2)"""
KNOWN = """known as (select l.id, coalesce(string_agg(t.id::varchar, ',' order by t.place) filter ((l.id + t.id) % 11 <> 0), '') = m.manifest as current
  from latest l join man m on m.project_id = l.project_id and m.artifact_type = l.artifact_type left join taken t on t.project_id = l.project_id and t.target = l.artifact_type group by l.id, m.manifest)"""
SUMMARY = """summary as (select * exclude (rn) from (select s.*, row_number() over (partition by s.project_id order by s.updated_at desc, s.id desc) as rn from summaries s
  join dep d on d.project_id = s.project_id and d.id = s.input_id and d.updated_at = s.input_at and d.content_hash = s.input_hash where verified) where rn = 1)"""


def _dependencies(spark, d):
    return C.evaluation_dependencies(fixture(spark, d, "evaluations"), fixture(spark, d, "generated"))


def _manifests(spark, d):
    generated = fixture(spark, d, "generated")
    candidates = C.knowledge_candidates(generated, fixture(spark, d, "revisions"), _dependencies(spark, d))
    return C.base_manifests(candidates, generated.select("project_id", "artifact_type"))


def _knowledge(spark, d):
    """Recorded manifests of the latest artifacts: today's, less some entries."""
    latest, manifests = C.latest_artifacts(fixture(spark, d, "generated")), _manifests(spark, d)
    entries = latest.select(F.col("id").alias("artifact_id"), "project_id", "artifact_type").join(manifests, ["project_id", "artifact_type"])
    recorded = entries.select("artifact_id", F.posexplode("manifest").alias("ordinal", "e")).select("artifact_id", "ordinal", "e.*").where("(artifact_id + id) % 11 <> 0")
    return C.knowledge_current(latest, recorded, manifests)


@query(f"with {DEP} select project_id, id, updated_at, mode, content_hash from dep", ("generated", "evaluations"))
def evaluation_dependency(spark, d):
    return _dependencies(spark, d).select("project_id", "id", "updated_at", "mode", "content_hash")


@query(f"with {LATEST}, {DEP}, {CAND} select project_id, artifact_type, id, version from cand", ("generated", "evaluations", "revisions"))
def knowledge_candidates(spark, d):
    found = C.knowledge_candidates(fixture(spark, d, "generated"), fixture(spark, d, "revisions"), _dependencies(spark, d))
    return found.select("project_id", "artifact_type", "id", "version")


@query(f"with {LATEST}, {DEP}, {CAND}, {MANIFEST} select project_id, artifact_type, manifest from man", ("generated", "evaluations", "revisions"))
def base_manifest(spark, d):
    ids = F.array_join(F.transform("manifest", lambda e: e["id"].cast("string")), ",")
    return _manifests(spark, d).select("project_id", "artifact_type", ids.alias("manifest"))


@query(f"with {LATEST}, {DEP}, {CAND}, {MANIFEST}, {KNOWN} select id, current from known", ("generated", "evaluations", "revisions"))
def knowledge_currentness(spark, d):
    return _knowledge(spark, d)


@query(
    f"with {LATEST}, {DEP}, {CAND}, {MANIFEST}, {KNOWN} select c.project_id, c.artifact_type, c.id from cand c join known k on k.id = c.id where k.current",
    ("generated", "evaluations", "revisions"),
)
def knowledge_manifest_current(spark, d):
    """Candidates that may stand in a manifest: those whose own knowledge is current."""
    found = C.knowledge_candidates(fixture(spark, d, "generated"), fixture(spark, d, "revisions"), _dependencies(spark, d))
    return found.join(_knowledge(spark, d).where("current").select("id"), "id", "left_semi").select("project_id", "artifact_type", "id")


@query(
    f"""with {LATEST}, {DEP}, {CAND}, {MANIFEST}, {KNOWN} select e.project_id, e.id, case mode when 'document_only' then true when 'generated_artifact' then exists (
      select 1 from latest l join revisions r on r.project_id = l.project_id and r.source_revision = l.source_revision and r.library_revision = l.library_revision join known k on k.id = l.id and k.current
      where l.artifact_type = 'losningsutkast' and l.id = e.evaluated_id and l.project_id = e.project_id) else false end as current from evaluations e""",
    ("generated", "evaluations", "revisions"),
)
def evaluation_currentness(spark, d):
    return C.evaluation_current(fixture(spark, d, "evaluations"), fixture(spark, d, "generated"), fixture(spark, d, "revisions"), _knowledge(spark, d))


@query(f"with {DEP}, {SUMMARY} select project_id, id, updated_at from summary", ("generated", "evaluations", "summaries"))
def current_summary(spark, d):
    return C.current_summaries(fixture(spark, d, "summaries"), _dependencies(spark, d)).select("project_id", "id", "updated_at")


@query(
    f"""with {DEP}, {SUMMARY} select d.project_id, '{{"evaluation":{{"id":' || d.id || ',"mode":"' || d.mode || '","content_hash":"' || d.content_hash || '"}},"summary_id":' || coalesce(s.id::varchar, 'null') || '}}' as snapshot
    from dep d left join summary s on s.project_id = d.project_id""",
    ("generated", "evaluations", "summaries"),
)
def derived_snapshot(spark, d):
    return C.derived_snapshots(_dependencies(spark, d), fixture(spark, d, "summaries"))


@query(
    """with r as (select user_id as project_id, row_number() over (partition by user_id order by event_id) as attempt, event_id % 3 as before, event_id % 2 as after from events),
    f as (select *, row_number() over (partition by project_id order by attempt) as k from r where before = after and attempt <= 3)
    select p.project_id, f.attempt, f.after as revision, f.project_id is not null as ok from (select distinct project_id from r) p left join f on f.project_id = p.project_id and k = 1"""
)
def stable_snapshot(spark, d):
    """Reads of a revision before and after a snapshot, at most three tries."""
    from pyspark.sql import Window

    from lodestone.sources.tables import table

    events = table(spark, d, "events").select("user_id", "event_id")
    attempt = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    reads = events.select(F.col("user_id").alias("project_id"), attempt.alias("attempt"), (F.col("event_id") % 3).alias("before"), (F.col("event_id") % 2).alias("after"))
    return C.stable_reads(reads)
