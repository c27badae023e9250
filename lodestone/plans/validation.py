"""Validation queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators import validation as V
from lodestone.plans.registry import query
from lodestone.sources.tables import table


@query(
    """select 'lineitem_discount' as rule, l_orderkey || '-' || l_linenumber as key from lineitem where l_discount > 0.09
    union all select 'order_status', cast(o_orderkey as varchar) from orders where o_orderstatus not in ('F', 'O')
    union all select 'customer_nation_unique', c_nationkey || '|' || c_mktsegment from customer group by c_nationkey, c_mktsegment having count(*) > 1
    union all select 'event_user', cast(user_id as varchar) from events where user_id is not null and user_id not in (select c_custkey from customer)
    union all select 'order_customer', cast(o_custkey as varchar) from orders where o_custkey not in (select c_custkey from customer)"""
)
def constraint_violations(spark, d):
    lines, orders, customer, events = (table(spark, d, t) for t in ("lineitem", "orders", "customer", "events"))
    parts = [
        V.check(lines, "lineitem_discount", F.concat_ws("-", "l_orderkey", "l_linenumber"), F.col("l_discount") <= 0.09),
        V.check(orders, "order_status", F.col("o_orderkey"), F.col("o_orderstatus").isin("F", "O")),
        V.unique(customer, "customer_nation_unique", ["c_nationkey", "c_mktsegment"]),
        V.references(events, "event_user", "user_id", customer, "c_custkey"),
        V.references(orders, "order_customer", "o_custkey", customer, "c_custkey"),
    ]
    return reduce(DataFrame.unionByName, parts)


@query("""select n_nationkey, sha256('{"n_name":"' || n_name || '","n_regionkey":' || n_regionkey || '}') as digest from nation""")
def row_manifest(spark, d):
    return table(spark, d, "nation").select("n_nationkey", V.manifest(None, ["n_name", "n_regionkey"]).alias("digest"))


@query("select k from (select distinct o_custkey as k from orders where o_orderstatus = 'F') except select o_custkey from orders where o_orderstatus = 'O'")
def scope_completeness(spark, d):
    orders = table(spark, d, "orders")
    return orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k")).distinct().exceptAll(orders.where("o_orderstatus = 'O'").select("o_custkey").distinct())


@query(
    r"""select doc_id, case when trim(text) = '' then 'empty' when length(text) < 80 then 'short' when regexp_matches(text, '[#*$%&]{3}') then 'symbols' else 'ready' end as readiness from documents"""
)
def readiness(spark, d):
    text = F.col("text")
    state = F.when(F.trim(text) == "", "empty").when(F.length(text) < 80, "short").when(text.rlike("[#*$%&]{3}"), "symbols").otherwise("ready")
    return table(spark, d, "documents").select("doc_id", state.alias("readiness"))


@query("select event_id, least(100, greatest(0, try_cast(json_extract_string(props, '$.k') as int))) as k, try_cast(json_extract_string(props, '$.k') as int) is null as dropped from events")
def metadata_bounds(spark, d):
    k = F.get_json_object("props", "$.k").try_cast("int")
    return table(spark, d, "events").select("event_id", F.when(k.isNotNull(), F.least(F.lit(100), F.greatest(F.lit(0), k))).alias("k"), k.isNull().alias("dropped"))
