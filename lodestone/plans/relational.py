"""Filters, joins, windows, sorting and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.plans.registry import query
from lodestone.sources.tables import table


@query(
    """select o_orderkey, o_totalprice from orders where (o_orderstatus in ('O', 'P') or o_orderpriority ilike '%urgent%') and o_totalprice >= 1000 and o_custkey is not null"""
)
def filtered_scan(spark, d):
    orders = table(spark, d, "orders")
    wanted = F.col("o_orderstatus").isin("O", "P") | F.col("o_orderpriority").ilike("%urgent%")
    return orders.where(wanted & (F.col("o_totalprice") >= 1000) & F.col("o_custkey").isNotNull()).select("o_orderkey", "o_totalprice")


@query(
    """select doc_id, lang, source from documents where (source = 'src1' or (source is null or source in ('src2', 'src3')) and source in ('src2', 'src9'))"""
)
def scoped_union_filter(spark, d):
    source = F.col("source")
    scope = (source == "src1") | ((source.isNull() | source.isin("src2", "src3")) & source.isin("src2", "src9"))
    return table(spark, d, "documents").where(scope).select("doc_id", "lang", "source")


@query(
    """select a.o_orderkey, a.o_orderstatus is distinct from b.o_orderstatus as status_changed, (a.o_orderstatus, a.o_orderpriority) is distinct from (b.o_orderstatus, b.o_orderpriority) as row_changed
    from orders a join orders b on b.o_orderkey = a.o_orderkey + 1"""
)
def row_change_detection(spark, d):
    a = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    b = a.select((F.col("o_orderkey") - 1).alias("o_orderkey"), F.col("o_orderstatus").alias("s"), F.col("o_orderpriority").alias("p"))
    joined = a.join(b, "o_orderkey")
    changed = ~F.struct("o_orderstatus", "o_orderpriority").eqNullSafe(F.struct(F.col("s").alias("o_orderstatus"), F.col("p").alias("o_orderpriority")))
    return joined.select("o_orderkey", (~F.col("o_orderstatus").eqNullSafe(F.col("s"))).alias("status_changed"), changed.alias("row_changed"))


@query(
    """select c_custkey, exists (select 1 from orders where o_custkey = c_custkey) as has_orders from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'P')"""
)
def semi_and_anti(spark, d):
    customer, orders = table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders")
    pending = orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    some = orders.select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("has_orders", F.lit(True))
    return customer.join(pending, "c_custkey", "left_anti").join(some, "c_custkey", "left").na.fill({"has_orders": False})


@query(
    """select event_id, match_class, c_custkey from (select event_id, match_class, c_custkey, row_number() over (partition by event_id order by match_class, c_custkey) as rn from (
      select event_id, 1 as match_class, c_custkey from events join customer on c_custkey = user_id where c_nationkey < 5
      union all select event_id, 2, c_custkey from events join customer on c_custkey = user_id + 1
      union all select event_id, 3, c_custkey from events join customer on c_custkey = event_id)) where rn = 1"""
)
def priority_key_join(spark, d):
    """A join on any of three keys, the first that matches winning: three equi-joins, never an OR."""
    events = table(spark, d, "events").select("event_id", "user_id")
    customer = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    ways = [
        events.join(customer.where("c_nationkey < 5"), F.col("user_id") == F.col("c_custkey")),
        events.join(customer, F.col("user_id") + 1 == F.col("c_custkey")),
        events.join(customer, F.col("event_id") == F.col("c_custkey")),
    ]
    union = None
    for i, way in enumerate(ways, 1):
        part = way.select("event_id", F.lit(i).alias("match_class"), "c_custkey")
        union = part if union is None else union.unionByName(part)
    return union.groupBy("event_id").agg(F.min(F.struct("match_class", "c_custkey")).alias("m")).select("event_id", "m.*")


@query(
    """select coalesce(a.name, b.name) as name, case when b.name is null then 'source_only' when a.name is null then 'target_only' when a.n <> b.n then 'differs' else 'equal' end as status
    from (select event_type as name, count(*) as n from events group by 1) a full join (select case event_type when 'error' then 'fault' else event_type end as name, count(*) as n from events where event_id % 2 = 0 or event_type = 'view' group by 1) b on a.name = b.name"""
)
def inventory_compare(spark, d):
    events = table(spark, d, "events")
    a = events.groupBy(F.col("event_type").alias("name")).agg(F.count("*").alias("n"))
    renamed = F.when(F.col("event_type") == "error", "fault").otherwise(F.col("event_type"))
    b = events.where("event_id % 2 = 0 or event_type = 'view'").groupBy(renamed.alias("name")).agg(F.count("*").alias("m"))
    status = F.when(F.col("m").isNull(), "source_only").when(F.col("n").isNull(), "target_only").when(F.col("n") != F.col("m"), "differs").otherwise("equal")
    return a.join(b, "name", "full").select("name", status.alias("status"))


@query(
    """select conv_id, turn, role, row_number() over w as position, count(*) over (partition by conv_id, role order by turn, text rows unbounded preceding) as role_turn,
      last_value(case when role = 'user' then turn end ignore nulls) over w as last_user_turn, lead(turn) over w as next_turn
    from conversations window w as (partition by conv_id order by turn, role, text)"""
)
def conversation_windows(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    own = Window.partitionBy("conv_id", "role").orderBy("turn", "text").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, d, "conversations").select(
        "conv_id",
        "turn",
        "role",
        F.row_number().over(w).alias("position"),
        F.count("*").over(own).alias("role_turn"),
        F.last(F.when(F.col("role") == "user", F.col("turn")), ignorenulls=True).over(upto).alias("last_user_turn"),
        F.lead("turn").over(w).alias("next_turn"),
    )


@query(
    """select c_custkey, c_nationkey, is_admin from (select c_custkey, c_nationkey, row_number() over (partition by c_nationkey order by (c_mktsegment = 'BUILDING') desc, c_acctbal desc, c_custkey) = 1 as is_admin from customer)"""
)
def admin_election(spark, d):
    w = Window.partitionBy("c_nationkey").orderBy((F.col("c_mktsegment") == "BUILDING").desc(), F.desc("c_acctbal"), "c_custkey")
    return table(spark, d, "customer").select("c_custkey", "c_nationkey", (F.row_number().over(w) == 1).alias("is_admin"))


@query(
    """select event_id, user_id from (select *, row_number() over (partition by event_type order by value desc, event_id) as k, row_number() over (order by value desc, event_id) as g from events) where k <= 6 or g <= 40"""
)
def reserve_then_fill(spark, d):
    """At least six of each type, then the best of all: two bounded top-k lists joined to their union."""
    events = table(spark, d, "events").select("event_id", "user_id", "event_type", "value")
    best = events.orderBy(F.desc("value"), "event_id").limit(40)
    w = Window.partitionBy("event_type").orderBy(F.desc("value"), "event_id")
    reserved = events.withColumn("k", F.row_number().over(w)).where("k <= 6").drop("k")
    return best.unionByName(reserved).select("event_id", "user_id").distinct()


@query("select o_orderkey, o_totalprice from orders order by o_totalprice desc nulls last, o_orderkey limit 20 offset 40")
def paged_listing(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc_nulls_last("o_totalprice"), "o_orderkey").offset(40).limit(20)


@query(
    """(select c_nationkey as k from customer intersect select s_nationkey from supplier) union all (select n_nationkey + 100 from nation except select s_nationkey + 100 from supplier)"""
)
def set_operations(spark, d):
    customer, supplier, nation = (table(spark, d, t) for t in ("customer", "supplier", "nation"))
    both = customer.select(F.col("c_nationkey").alias("k")).intersect(supplier.select("s_nationkey"))
    only = nation.select((F.col("n_nationkey") + 100).alias("k")).exceptAll(supplier.select(F.col("s_nationkey") + 100).distinct())
    return both.unionByName(only)


@query(
    """select p_name, case when n = 1 then p_name else p_name || ' ' || n end as unique_name from (select p_partkey, p_name, row_number() over (partition by lower(p_name) order by p_partkey) as n from part)"""
)
def name_dedupe(spark, d):
    """Repeated names get a number after them."""
    w = Window.partitionBy(F.lower("p_name")).orderBy("p_partkey")
    n = F.row_number().over(w)
    return table(spark, d, "part").select("p_name", F.when(n == 1, F.col("p_name")).otherwise(F.concat_ws(" ", "p_name", n)).alias("unique_name"))


@query(
    """select project_id, name, coalesce(orders, 0) as orders, coalesce(lines, 0) as lines from (select c_custkey as project_id, c_name as name from customer)
    left join (select o_custkey as project_id, count(*) as orders from orders group by 1) using (project_id)
    left join (select o_custkey as project_id, count(*) as lines from lineitem join orders on o_orderkey = l_orderkey group by 1) using (project_id)"""
)
def project_overview_counts(spark, d):
    orders = table(spark, d, "orders")
    counts = orders.groupBy(F.col("o_custkey").alias("project_id")).agg(F.count("*").alias("orders"))
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    lines = orders.join(lines, "o_orderkey").groupBy(F.col("o_custkey").alias("project_id")).agg(F.sum("n").alias("lines"))
    people = table(spark, d, "customer").select(F.col("c_custkey").alias("project_id"), F.col("c_name").alias("name"))
    return people.join(counts, "project_id", "left").join(lines, "project_id", "left").na.fill({"orders": 0, "lines": 0})
