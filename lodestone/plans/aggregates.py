"""Aggregation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import aggregates as G
from lodestone.plans.registry import fixture, query
from lodestone.sources.tables import table


@query(
    """select l_orderkey, n, distinct_n, low, high, n = distinct_n and low = 0 and high = n - 1 as contiguous from (
      select l_orderkey, count(*) as n, count(distinct l_linenumber - 1) as distinct_n, min(l_linenumber - 1) as low, max(l_linenumber - 1) as high from lineitem group by 1)"""
)
def contiguity_check(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", (F.col("l_linenumber") - 1).alias("i"))
    return G.contiguity(rows, ["l_orderkey"], "i")


@query(
    """select l_orderkey, count(*) as n, bool_and(coalesce(l_quantity > 2 and l_shipdate is not null, false)) as complete from lineitem group by 1"""
)
def completeness_check(spark, d):
    ok = F.coalesce((F.col("l_quantity") > 2) & F.col("l_shipdate").isNotNull(), F.lit(False))
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.bool_and(ok).alias("complete"))


@query(
    """select user_id, string_agg(event_type, ',' order by ts, event_id) as path, string_agg(distinct event_type, ',' order by event_type) as kinds,
      coalesce(string_agg(cast(event_id as varchar), ',' order by event_id) filter (where event_type = 'error'), '') as errors from events group by 1"""
)
def ordered_collects(spark, d):
    e = table(spark, d, "events")
    path = F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))), lambda x: x["event_type"])
    errors = F.array_sort(F.collect_list(F.when(F.col("event_type") == "error", F.col("event_id"))))
    return e.groupBy("user_id").agg(
        F.array_join(path, ",").alias("path"), F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("kinds"), F.array_join(errors, ",").alias("errors")
    )


@query(
    """select word, first_seen from (select w as word, min(doc_id * 100000 + i) as first_seen from (
      select doc_id, unnest(range(1, len(ws) + 1)) as i, unnest(ws) as w from (select doc_id, regexp_extract_all(lower(source || ' ' || lang), '[a-z0-9]+') as ws from documents)) group by 1) order by first_seen limit 96"""
)
def ordered_keyword_merge(spark, d):
    """First-seen order of keywords, at most 96."""
    docs = table(spark, d, "documents").select("doc_id", F.posexplode(F.regexp_extract_all(F.lower(F.concat_ws(" ", "source", "lang")), F.lit("[a-z0-9]+"), 0)).alias("i", "word"))
    seen = docs.groupBy("word").agg(F.min(F.expr("doc_id * 100000 + i + 1")).alias("first_seen"))
    return seen.orderBy("first_seen").limit(96)


@query(
    """select lang, word, n from (select lang, word, n, row_number() over (partition by lang order by n desc, word) as k from (
      select lang, word, count(*) as n from (select lang, unnest(regexp_extract_all(lower(text), '[a-z]{4,}')) as word from documents) group by 1, 2)) where k <= 64"""
)
def keyword_top_n(spark, d):
    """The 64 most frequent words of each language; counts come first, so what is ranked is the vocabulary."""
    from pyspark.sql import Window

    words = table(spark, d, "documents").select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), 0)).alias("word"))
    counts = words.groupBy("lang", "word").agg(F.count("*").alias("n"))
    k = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    return counts.withColumn("k", k).where("k <= 64").drop("k")


@query(
    """with e as (select event_type, cast(floor(value * 10) as bigint) as v from events where value is not null),
    c as (select event_type, v, count(*) as n from e group by 1, 2), p as (select *, sum(n) over (partition by event_type order by v) as upto, sum(n) over (partition by event_type) as total from c)
    select event_type, min(case when upto * 100 >= total * 50 then v end) as p50, min(case when upto * 100 >= total * 90 then v end) as p90, min(case when upto * 100 >= total * 99 then v end) as p99 from p group by 1"""
)
def latency_percentiles(spark, d):
    values = table(spark, d, "events").select("event_type", F.floor(F.col("value") * 10).alias("v"))
    return G.nearest_rank(values, ["event_type"], "v", [50, 90, 99])


@query(
    """select event_type, count(*) as n, round(avg(value), 6) as mean, max(value) as high, round(case when count(*) < 2 then 0 else stddev_pop(value) end, 6) as spread,
      (list_sort(list(value)))[least(cast(floor(count(*) * 0.5) as bigint) + 1, count(*))] as upper_median, (list_sort(list(value)))[least(cast(floor(count(*) * 0.9::double) as bigint) + 1, count(*))] as p90 from events where value is not null group by 1"""
)
def timing_summary(spark, d):
    e = table(spark, d, "events").where("value is not null").select("event_type", "value")
    spread = F.when(F.count("*") < 2, 0.0).otherwise(F.stddev_pop("value"))
    sums = e.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.max("value").alias("high"), F.round(spread, 6).alias("spread"))
    return sums.join(G.index_percentiles(e, ["event_type"], "value", {"upper_median": 0.5, "p90": 0.9}), "event_type")


@query(
    """with r as (select sha256(case when n_nationkey is null then '00' else '01' || sha256(cast(n_nationkey as varchar)) end || case when n_name is null then '00' else '01' || sha256(n_name) end || case when n_regionkey is null then '00' else '01' || sha256(cast(n_regionkey as varchar)) end) as h from nation)
    select count(*) as rows, cast(sum(('0x' || substr(h, 1, 12))::bigint) as decimal(38, 0)) as digest0, cast(sum(('0x' || substr(h, 13, 12))::bigint) as decimal(38, 0)) as digest1 from r"""
)
def table_digest(spark, d):
    return G.table_digest(table(spark, d, "nation"), ["n_nationkey", "n_name", "n_regionkey"])


@query(
    """with s as (select s_nationkey, s_suppkey, s_acctbal + 2000 as w from supplier), r as (select *, cast(floor(w * 100 / sum(w) over (partition by s_nationkey) + 0.5) as bigint) as share, row_number() over (partition by s_nationkey order by s_suppkey) - 1 as place from s),
    t as (select *, 100 - sum(share) over (partition by s_nationkey) as off from r)
    select s_nationkey, s_suppkey, cast(share + case when place < abs(off) then sign(off) else 0 end as bigint) as share from t"""
)
def percent_to_hundred(spark, d):
    weights = table(spark, d, "supplier").select("s_nationkey", "s_suppkey", (F.col("s_acctbal") + 2000).alias("w"))
    return G.to_hundred(weights, ["s_nationkey"], "w", ["s_suppkey"]).drop("w")


@query(
    """with e as (select l_partkey as k, count(*) as e from lineitem where l_returnflag = 'R' group by 1), a as (select l_partkey as k, count(*) as a from lineitem where l_returnflag = 'A' group by 1)
    select k, e - coalesce(a, 0) as missing from e left join a using (k) where e > coalesce(a, 0)"""
)
def multiset_deficit(spark, d):
    lines = table(spark, d, "lineitem").select(F.col("l_partkey").alias("k"), "l_returnflag")
    return G.multiset_deficit(lines.where("l_returnflag = 'R'"), lines.where("l_returnflag = 'A'"), "k")


@query(
    """select conv_id, count(*) as messages, min(turn) as first_turn, max(turn) as last_turn, md5(max_by(text, (turn, text))) as preview_md5, count(*) filter (where role = 'user') as asked from conversations group by 1"""
)
def chat_session_rollup(spark, d):
    return table(spark, d, "conversations").groupBy("conv_id").agg(
        F.count("*").alias("messages"),
        F.min("turn").alias("first_turn"),
        F.max("turn").alias("last_turn"),
        F.md5(F.max_by("text", F.struct("turn", "text"))).alias("preview_md5"),
        F.count(F.when(F.col("role") == "user", 1)).alias("asked"),
    )


@query(
    """select o_orderpriority, count(*) filter (where s > 0) as wins, count(*) filter (where s < 0) as losses, count(*) filter (where s = 0) as ties, round(avg(s), 4) as mean_delta from (
      select o_orderpriority, round(sum(l_discount) * 100) - round(sum(l_tax) * 100) as s from orders join lineitem on l_orderkey = o_orderkey group by o_orderkey, o_orderpriority) group by 1"""
)
def win_loss(spark, d):
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg((F.round(F.sum("l_discount") * 100) - F.round(F.sum("l_tax") * 100)).alias("s"))
    s = F.col("s")
    return table(spark, d, "orders").join(lines, "o_orderkey").groupBy("o_orderpriority").agg(
        F.count(F.when(s > 0, 1)).alias("wins"), F.count(F.when(s < 0, 1)).alias("losses"), F.count(F.when(s == 0, 1)).alias("ties"), F.round(F.avg(s), 4).alias("mean_delta")
    )


@query(
    """select l_returnflag, l_linestatus, sum(l_quantity) as sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, count(*) as n from lineitem group by all"""
)
def pricing_summary(spark, d):
    revenue = F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")))
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(revenue, 2).alias("revenue"), F.count("*").alias("n"))


@query("select project_id, '{' || string_agg('\"' || id || '\":' || case when status = 'queued' then 'true' else 'false' end, ',' order by cast(id as varchar)) || '}' as states from jobs group by 1", ("jobs",))
def state_object(spark, d):
    """An object of id and flag a project."""
    entry = F.struct(F.col("id").cast("string").alias("k"), (F.col("status") == "queued").alias("v"))
    return fixture(spark, d, "jobs").groupBy("project_id").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(entry)))).alias("states"))
