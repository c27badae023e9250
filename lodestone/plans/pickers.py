"""Which documents, services and facts are taken up."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import pickers as K
from lodestone.operators.predicates import document_classes
from lodestone.plans.predicates import _rlike
from lodestone.operators import predicates as P
from lodestone.plans.registry import fixture, query
from lodestone.sources.tables import table

DOCS = ("project_documents",)
#: Documents with the two classes that picking needs.
CLASSED = f"""classed as (select *, kind = 'tidligere_losning' as historical, role not in ('primary_customer_document', 'primary_solution_document') and kind <> 'tidligere_losning'
    and (kind in ('kravdokument', 'rfp') or (not ({_rlike(P.SOLUTION_RESPONSE)} and not {_rlike(P.CERTAIN_REQUIREMENT_SOURCE)}) and {_rlike(P.REQUIREMENT_SOURCE)})) as formal
  from (select *, coalesce(supporting_subtype, '') as kind, trim(regexp_replace(regexp_replace(title || ' ' || file_name, '[_‐‑‒–—-]+', ' ', 'g'), '\\s+', ' ', 'g')) as scope from project_documents))"""


@query(
    f"""with {CLASSED}, s as (select project_id, min(id) as s from classed where role = 'primary_solution_document' group by 1),
    c as (select project_id, arg_min(id, (role <> 'primary_customer_document', id)) as c from classed left join s using (project_id) where role = 'primary_customer_document' or (role <> 'primary_solution_document' and not historical and id is distinct from s) group by 1),
    z as (select d.project_id, min(id) as z from classed d left join s using (project_id) left join c using (project_id) where s is null and id is distinct from c and not historical and not formal and regexp_matches(title || ' ' || file_name, '(?i)løsn|losn|solution|arkitektur|architecture') group by 1)
    select * from (select d.project_id, id, case when id = c then 'customer' when id = coalesce(s, z) then 'solution' when not historical then 'supporting' end as part from classed d left join s using (project_id) left join c using (project_id) left join z using (project_id)) where part is not null""",
    DOCS,
)
def document_roles(spark, d):
    return K.document_roles(document_classes(fixture(spark, d, "project_documents")))


@query(
    f"""with {CLASSED}, u as (select project_id, id, min(k) as k from (select project_id, min(id) as id, 0 as k from classed where role = 'primary_customer_document' group by 1 union all select project_id, id, 1 from classed where formal) group by 1, 2)
    select project_id, id, row_number() over (partition by project_id order by k, id) as place from u""",
    DOCS,
)
def requirement_sources(spark, d):
    docs = document_classes(fixture(spark, d, "project_documents"))
    customer = docs.where("role = 'primary_customer_document'").groupBy("project_id").agg(F.min("id").alias("id"))
    return K.requirement_sources(docs, customer)


@query("select id, role = 'primary_customer_document' or coalesce(supporting_subtype in ('kravdokument', 'rfp'), false) as high_impact from project_documents", DOCS)
def high_impact_documents(spark, d):
    return fixture(spark, d, "project_documents").select("id", K.high_impact(F.col("role"), F.col("supporting_subtype")).alias("high_impact"))


@query("select p_partkey as id, contains(lower(p_name || ' ' || p_type), 'steel')::int + contains(lower(p_name || ' ' || p_type), 'large')::int + contains(lower(p_name || ' ' || p_type), 'an')::int as score from part order by score desc, id limit 5")
def relevant_services(spark, d):
    services = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_type").alias("summary"))
    return K.service_documents(services, ["steel", "large", "an"], "forbedret_kravsvar").select("id", "score")


@query("select p_partkey as id from part order by p_partkey % 7 = 0 desc, p_size > 40 desc, p_size % 5 desc, p_partkey % 2 = 0 desc, p_partkey limit 12")
def service_ranking(spark, d):
    services = table(spark, d, "part").selectExpr("p_partkey as id", "p_partkey % 7 = 0 as selected", "p_size > 40 as recommended", "p_size % 5 as score", "p_partkey % 2 = 0 as has_context")
    return K.service_candidates(services).select("id")


@query(
    """with r as (select p_partkey % 40 as project_id, p_partkey as id, p_brand as name, p_size * 2 as usefulness from part), b as (select *, row_number() over (partition by project_id, lower(trim(name)) order by usefulness desc, id) as k from r where usefulness >= 40)
    select * from (select project_id, id, row_number() over (partition by project_id order by usefulness desc, id) as place from b where k = 1) where place <= 5"""
)
def recommended_services(spark, d):
    services = table(spark, d, "part").selectExpr("p_partkey % 40 as project_id", "p_partkey as id", "p_brand as name", "p_size * 2 as usefulness")
    return K.recommended(services, "project_id").select("project_id", "id", "place")


@query(
    """with f as (select user_id % 60 as project_id, event_id as id, user_id % 4 as document_id, event_type as category, event_id % 37 as score from events), d as (select *, row_number() over (partition by project_id, document_id order by score desc, id) = 1 as d, coalesce(nullif(list_position(['purchase', 'error', 'click'], category), 0), 1000000000) as o from f),
    t as (select *, case when d then 0 else row_number() over (partition by project_id, category, d order by score desc, id) end as a, case when d then 0 else o end as b from d),
    p as (select *, row_number() over (partition by project_id order by a, b, score desc, id) as place from t) select p.project_id, id, place from p join (select project_id, count(distinct document_id) as n from f group by 1) c using (project_id) where place <= least(9, greatest(8, n + 7))"""
)
def fact_round_robin(spark, d):
    facts = table(spark, d, "events").selectExpr("user_id % 60 as project_id", "event_id as id", "user_id % 4 as document_id", "event_type as category", "event_id % 37 as score")
    return K.round_robin(facts, "project_id", ["purchase", "error", "click"]).select("project_id", "id", "place")


_ORDERED = "l_orderkey as doc, l_orderkey * 100000 + l_linenumber * 10000 + l_partkey as id, case when l_partkey % 3 = 0 then l_linenumber end as entry, case when l_partkey % 2 = 0 then l_suppkey % 5 end as page, l_returnflag as text"


@query(f"with r as (select {_ORDERED} from lineitem) select doc, id, row_number() over (partition by doc order by coalesce(entry, 1000000000), coalesce(page, 1000000000), text, id) as place from r")
def requirement_order(spark, d):
    rows = table(spark, d, "lineitem").selectExpr(*_ORDERED.split(", "))
    return K.requirement_order(rows, ["doc"], ["entry", "page"]).select("doc", "id", "place")


_GENERATED = "case p_partkey % 4 when 0 then substr(p_name, 1, 8) when 1 then concat(p_name, ' og mer') when 2 then 'annet' else concat(substr(p_name, 1, 8), '.') end"


@query(
    f"""with r as (select p_partkey, p_type, {_GENERATED} as g, p_name as t from part), k as (select *, trim(lower(g)) as a, trim(lower(t)) as b from r)
    select p_partkey, case when length(t) >= 12 and a <> '' and (contains(a, b) or (starts_with(b, a) and not regexp_matches(a, '[.!?;:]$') and not regexp_matches(substr(b, length(a) + 1), '^\\s*(?:[-•*]|\\|)'))) then t else g end as text, sha256(t || chr(10) || p_type) as content_hash from k"""
)
def trusted_texts(spark, d):
    return table(spark, d, "part").select("p_partkey", K.trusted_text(F.expr(_GENERATED), F.col("p_name")).alias("text"), K.content_hash(F.col("p_name"), F.col("p_type")).alias("content_hash"))


@query(
    """select c.c_custkey, coalesce(g.v, c.c_name) as goals, coalesce(r.v, c.c_mktsegment) as risks, c_nationkey as scale from customer c
    left join (select o_custkey, max(o_orderpriority) as v from orders where o_orderstatus = 'P' group by 1) g on g.o_custkey = c_custkey left join (select o_custkey, max(o_orderpriority) as v from orders where o_orderstatus = 'F' group by 1) r on r.o_custkey = c_custkey"""
)
def section_patches(spark, d):
    base = table(spark, d, "customer").selectExpr("c_custkey", "c_name as goals", "c_mktsegment as risks", "c_nationkey as scale")
    orders = table(spark, d, "orders").where("o_orderstatus in ('P', 'F')").groupBy(F.col("o_custkey").alias("c_custkey"), F.expr("case o_orderstatus when 'P' then 'goals' else 'risks' end").alias("section")).agg(F.max("o_orderpriority").alias("goals"))
    patch = orders.withColumn("risks", F.col("goals"))
    return K.merged_sections(base, patch, "c_custkey", {"goals": ["goals"], "risks": ["risks"]})
