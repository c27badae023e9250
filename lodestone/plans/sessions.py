"""Chat sessions, job cutover and access outcomes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.operators import access as A
from lodestone.plans.registry import fixture, query
from lodestone.sources.tables import table


@query(
    """with s as (select c_custkey as id, c_custkey % 5 as n, c_custkey % 30 as made, c_custkey % 30 + 1 as seen, 'kept' as preview, c_custkey % 9 = 0 as archived, c_custkey % 4 = 0 as pinned from customer where c_custkey % 2 = 0),
    m as (select conv_id as id, count(*) as n, min(turn) as made, max(turn) + 20 as seen, 'said' as preview from conversations group by 1)
    select coalesce(s.id, m.id) as id, greatest(coalesce(s.n, 0), coalesce(m.n, 0)) as messages, least(coalesce(s.made, m.made), coalesce(m.made, s.made)) as created, greatest(coalesce(s.seen, m.seen), coalesce(m.seen, s.seen)) as updated,
      case when s.id is null or m.seen >= s.seen then m.preview else s.preview end as preview, coalesce(pinned, false) as pinned from s full join m on s.id = m.id where not coalesce(archived, false)"""
)
def merged_sessions(spark, d):
    """Stored sessions and those that messages tell of, as one list without what is archived."""
    s = table(spark, d, "customer").where("c_custkey % 2 = 0").selectExpr("c_custkey as id", "c_custkey % 5 as n", "c_custkey % 30 as made", "c_custkey % 30 + 1 as seen", "'kept' as preview", "c_custkey % 9 = 0 as archived", "c_custkey % 4 = 0 as pinned")
    m = table(spark, d, "conversations").groupBy(F.col("conv_id").alias("id")).agg(F.count("*").alias("n2"), F.min("turn").alias("made2"), (F.max("turn") + 20).alias("seen2"), F.lit("said").alias("preview2"))
    both = s.withColumn("stored", F.lit(True)).join(m, "id", "full").where("not coalesce(archived, false)")
    preview = F.when(F.col("stored").isNull() | (F.col("seen2") >= F.col("seen")), F.col("preview2")).otherwise(F.col("preview"))
    return both.select(
        "id", F.greatest(F.coalesce("n", F.lit(0)), F.coalesce("n2", F.lit(0))).alias("messages"), F.least("made", "made2").alias("created"), F.greatest("seen", "seen2").alias("updated"), preview.alias("preview"), F.coalesce("pinned", F.lit(False)).alias("pinned")
    )


@query("select * from (select conv_id, turn, row_number() over (partition by conv_id order by turn desc, role, text) as back from conversations) where back <= 3")
def last_messages(spark, d):
    back = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn"), "role", "text"))
    return table(spark, d, "conversations").withColumn("back", back).where("back <= 3").select("conv_id", "turn", "back")


@query(
    "select id, case when status = 'running' then 'queued' else status end as status, case when status in ('running', 'queued') then null else locked_at end as locked_at, status = 'running' as requeued from jobs",
    ("jobs",),
)
def cutover_requeue(spark, d):
    """With claims closed, running jobs go back to the queue and queued ones hold no lease."""
    status = F.col("status")
    return fixture(spark, d, "jobs").select("id", F.when(status == "running", "queued").otherwise(status).alias("status"), F.when(~status.isin("running", "queued"), F.col("locked_at")).alias("locked_at"), (status == "running").alias("requeued"))


@query(
    """select c_custkey, coalesce(least >= 1, false) or admin as read, coalesce(least >= 2, false) or admin as download, coalesce(least >= 3, false) as write, coalesce(least >= 4, false) or admin as share, coalesce(least >= 4, false) as remove
    from (select c_custkey, c_custkey % 50 = 0 as admin, case c_nationkey % 5 when 0 then 1 when 1 then 2 when 2 then 3 when 3 then 4 end as least from customer)"""
)
def role_decisions(spark, d):
    role = F.expr("case c_nationkey % 5 when 0 then 'restricted_viewer' when 1 then 'viewer' when 2 then 'editor' when 3 then 'owner' end")
    admin = F.expr("c_custkey % 50 = 0")
    named = {"read": "project.read", "download": "document.download", "write": "artifact.write", "share": "project.share", "remove": "project.delete"}
    return table(spark, d, "customer").select("c_custkey", *[A.may(role, p, admin).alias(n) for n, p in named.items()])


@query(
    """with gone as (select principal_id, project_id from memberships where principal_id % 3 = 0 group by 1, 2), live as (select principal_id, project_id from memberships where revoked_at is null and (expires_at is null or expires_at > timestamp '2024-06-01') group by 1, 2),
    other as (select distinct m.principal_id, g.project_id from group_members m join group_grants g using (group_id) union select owner_id, project_id from projects),
    p as (select principal_id, count(*) as projects from other group by 1)
    select g.principal_id, g.project_id, exists (select 1 from other o where o.principal_id = g.principal_id and o.project_id = g.project_id) as keeps_project, exists (select 1 from p where p.principal_id = g.principal_id) as keeps_any from gone g""",
    ("memberships", "group_members", "group_grants", "projects"),
)
def revoke_outcomes(spark, d):
    """For each access that is taken away, whether its holder still reaches the project, or any, by a group or as owner."""
    gone = fixture(spark, d, "memberships").where("principal_id % 3 = 0").select("principal_id", "project_id").distinct()
    members, grants = fixture(spark, d, "group_members"), fixture(spark, d, "group_grants")
    owned = fixture(spark, d, "projects").select(F.col("owner_id").alias("principal_id"), "project_id")
    same = A.reached(gone, members, grants).unionByName(owned).distinct().withColumn("keeps_project", F.lit(True))
    grouped = members.join(grants.select("group_id").distinct(), "group_id", "left_semi").select("principal_id")
    some = grouped.unionByName(owned.select("principal_id")).distinct().withColumn("keeps_any", F.lit(True))
    return gone.join(same, ["principal_id", "project_id"], "left").join(some, "principal_id", "left").na.fill(False, ["keeps_project", "keeps_any"])


@query("select event_type, true as close from events group by 1")
def approximate_users(spark, d):
    """Distinct users by sketch, and whether that is within a tenth of the exact number."""
    events = table(spark, d, "events").select("event_type", "user_id")
    sketch = events.groupBy("event_type").agg(F.approx_count_distinct("user_id", 0.02).alias("a"), F.lit(0).cast("long").alias("e"))
    exact = events.distinct().groupBy("event_type").agg(F.lit(0).cast("long").alias("a"), F.count("user_id").alias("e"))
    # Together they would keep a sketch for every pair of type and user.
    found = sketch.unionByName(exact).groupBy("event_type").agg(F.max("a").alias("a"), F.max("e").alias("e"))
    return found.select("event_type", (F.abs(F.col("a") - F.col("e")) <= 0.1 * F.col("e")).alias("close"))
