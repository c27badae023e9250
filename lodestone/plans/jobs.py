"""Job-queue queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import jobs as J
from lodestone.plans.registry import fixture, query
from lodestone.sources.tables import table

AS_OF = "1997-06-01 00:00:00"


@query(
    f"""select id, was_stale, case when was_stale then 'queued' else status end as status from (
      select *, status = 'running' and (locked_at is null or locked_at < timestamp '{AS_OF}' - interval '15' minute) as was_stale from jobs)""",
    ("jobs",),
)
def stale_lease_reset(spark, d):
    return J.reset_stale(fixture(spark, d, "jobs"), AS_OF).select("id", "was_stale", "status")


@query("select project_id, kind, max(id) as id from jobs where status in ('queued', 'running') group by all", ("jobs",))
def latest_submission(spark, d):
    return J.latest_submission(fixture(spark, d, "jobs"), ["project_id", "kind"]).select("project_id", "kind", "id")


@query("select project_id, kind, min(id) as id from jobs group by all", ("jobs",))
def idempotent_enqueue(spark, d):
    return J.first_by_key(fixture(spark, d, "jobs"), ["project_id", "kind"], "submission_sequence").select("project_id", "kind", "id")


@query("select id, kind from jobs where status = 'queued' order by submission_sequence limit 3", ("jobs",))
def queue_claim(spark, d):
    return J.claim(fixture(spark, d, "jobs")).select("id", "kind")


@query(
    """select l_orderkey as job_id, l_linenumber as token from lineitem join orders on o_orderkey = l_orderkey where o_orderstatus = 'P' and l_linenumber = o_orderkey % 3 + 1"""
)
def lease_fencing(spark, d):
    jobs = fixture(spark, d, "jobs").withColumn("token", F.expr("id % 3 + 1"))
    writes = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").cast("long").alias("token"))
    return J.fenced(writes, jobs).select("job_id", F.col("token").cast("int").alias("token"))


@query(
    """select id, case status when 'completed' then 'job.completed' else 'job.open' end as action, case when locked_at is null then null else kind end as kind from jobs""",
    ("jobs",),
)
def terminal_audit_json(spark, d):
    jobs = fixture(spark, d, "jobs")
    record = J.terminal_record(F.col("status"), kind=F.when(F.col("locked_at").isNotNull(), F.col("kind")))
    return jobs.select("id", F.get_json_object(record, "$.action").alias("action"), F.get_json_object(record, "$.kind").alias("kind"))


@query(
    """select event_id, user_id, event_type, before from (select *, lag(event_type) over (partition by user_id order by ts, event_id) as before from events) where before is distinct from event_type"""
)
def status_change_feed(spark, d):
    found = J.status_changes(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], "event_type")
    return found.select("event_id", "user_id", "event_type", "before")


@query("select event_id, try_cast(json_extract_string(props, '$.k') as bigint) > 50 as deferred from events")
def retry_deferral(spark, d):
    """Whether a retry mark in the metadata lies beyond the present one."""
    return table(spark, d, "events").select("event_id", (F.get_json_object("props", "$.k").try_cast("bigint") > 50).alias("deferred"))
