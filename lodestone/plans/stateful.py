"""Stateful queries over events, as batch folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.plans.registry import query
from lodestone.sources.tables import table
from lodestone.streaming import breaker, limits

FOLD = """with recursive e as (select user_id, event_id, epoch_us(ts) as t, row_number() over (partition by user_id order by ts, event_id) as k from events),
    f as (select user_id, event_id, k, t as start, 1 as count, true as allowed from e where k = 1
      union all select e.user_id, e.event_id, e.k, case when e.t >= f.start + 86400000000 then e.t else f.start end,
        case when e.t >= f.start + 86400000000 then 1 when f.count >= 2 then {denied} else f.count + 1 end, case when e.t >= f.start + 86400000000 then true else f.count < 2 end
      from f join e on e.user_id = f.user_id and e.k = f.k + 1)
    select user_id, event_id, count, allowed from f"""


@query(FOLD.format(denied="f.count + 1"))
def rate_limit_fixed_window(spark, d):
    return limits.decide(table(spark, d, "events"), 86400, 2).select("user_id", "event_id", F.col("count").cast("int").alias("count"), "allowed")


@query(FOLD.format(denied="f.count"))
def rate_limit_denied_free(spark, d):
    return limits.decide(table(spark, d, "events"), 86400, 2, count_denied=False).select("user_id", "event_id", F.col("count").cast("int").alias("count"), "allowed")


@query()
def circuit_breaker(spark, d):
    calls = table(spark, d, "events").select(F.col("user_id").cast("string").alias("service"), F.col("event_id").alias("call_id"), "ts", (F.col("event_type") != "error").alias("ok"))
    return breaker.run_breaker(calls, threshold=1, base=3600.0, most=86400.0)


@query("select time_bucket(interval '1 hour', ts) as start, event_type, count(*) as n from events group by all")
def windowed_event_counts(spark, d):
    return limits.windowed_counts(table(spark, d, "events")).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query(
    """with g as (select user_id, ts, event_id, coalesce(ts - lag(ts) over (partition by user_id order by ts, event_id) > interval '12 hours', true)::int as new from events), s as (select *, sum(new) over (partition by user_id order by ts, event_id) as session from g)
    select user_id, session, count(*) as events, epoch_us(max(ts)) - epoch_us(min(ts)) as length_us from s group by 1, 2"""
)
def sessions(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = table(spark, d, "events").select("user_id", "ts", "event_id", us.alias("us"))
    new = F.coalesce((F.col("us") - F.lag("us").over(w)) > 12 * 3600 * 1000000, F.lit(True)).cast("int")
    numbered = rows.withColumn("new", new).withColumn("session", F.sum("new").over(w))
    return numbered.groupBy("user_id", "session").agg(F.count("*").alias("events"), (F.max("us") - F.min("us")).alias("length_us"))
