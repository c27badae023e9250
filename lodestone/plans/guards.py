"""Guards of coverage and answers, document validation, and services."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import documents as D
from lodestone.operators import guards as G
from lodestone.plans.documents import HEADING, LINES
from lodestone.plans.registry import fixture, query
from lodestone.sources.tables import table

ITEMS = ("coverage_items",)


@query(
    r"""select eval_id, idx, case when trim(answer) = '' then 'Mangler' when mandatory and regexp_matches(answer, '(?i)(kan ikke|vil ikke|leveres ikke|støttes ikke|not supported|cannot)') then 'Dårlig'
      when regexp_matches(answer, '(?i)^\s*(se|jf\.?|see)\s+(vedlegg|bilag|attachment)[\s0-9.,]*$') and assessment = 'Godt' then 'Uklart' else assessment end as corrected from coverage_items""",
    ITEMS,
)
def corrected_assessments(spark, d):
    return fixture(spark, d, "coverage_items").select("eval_id", "idx", G.corrected_assessment(F.col("assessment"), F.col("answer"), F.col("mandatory")).alias("corrected"))


@query(r"select eval_id, bool_and(not regexp_matches(answer, '(?i)^\s*(ja|nei|yes|no|ok|n/a|-|x|)\s*[.!]?\s*$')) as complete from coverage_items group by 1", ITEMS)
def complete_evidence(spark, d):
    return G.complete_evidence(fixture(spark, d, "coverage_items"), ["eval_id"], "answer")


_RETURNED = """select eval_id, case when idx % 5 = 4 and eval_id % 3 = 0 then 90 else idx end as nr, case when eval_id % 11 = 0 then '' when eval_id % 5 = 0 and idx < 2 then concat('Q-', 1 - idx) when eval_id % 13 = 0 then 'Q-x' else concat('Q-', idx) end as reference
    from coverage_items where not (eval_id % 7 = 0 and idx = 1) union all select eval_id, idx, concat('Q-', idx) from coverage_items where eval_id % 17 = 0 and idx = 0"""


@query(
    f"""with returned as ({_RETURNED}), c as (select eval_id, nr, count(*) as n, min(reference) as got, count(*) filter (trim(reference) = '') as blank from returned group by 1, 2), e as (select eval_id, idx as nr, 'Q-' || idx as wanted from coverage_items),
    j as (select coalesce(e.eval_id, c.eval_id) as eval_id, coalesce(e.nr, c.nr) as nr, wanted, got, n, blank, exists (select 1 from e x where x.eval_id = c.eval_id and x.wanted = c.got) as elsewhere from e full join c on e.eval_id = c.eval_id and e.nr = c.nr)
    select * from (select eval_id, nr, case when n is null then 'missing' when wanted is null then 'extra' when n > 1 then 'duplicate' when blank > 0 then 'without_reference' when got <> wanted and elsewhere then 'swapped' when got <> wanted then 'unknown_reference' end as code from j) where code is not null""",
    ITEMS,
)
def batch_errors(spark, d):
    items = fixture(spark, d, "coverage_items")
    returned = spark.sql(_RETURNED.replace("coverage_items", "{items}"), items=items)
    return G.batch_errors(items.select("eval_id", F.col("idx").alias("nr"), F.concat(F.lit("Q-"), F.col("idx").cast("string")).alias("reference")), returned, ["eval_id"])


_FINDING = "case idx % 4 when 0 then concat('«', answer, '»') when 1 then concat(substr(answer, 1, 26), ' ... ut') when 2 then 'Generelt om løsningen' else answer end"


@query(
    f"""with f as (select eval_id, idx as finding_id, trim(regexp_replace({_FINDING}, '["«»“”]', '', 'g')) as q from coverage_items), p as (select eval_id, finding_id, trim(string_split(q, '...')[1]) as a, trim(coalesce(string_split(q, '...')[2], '')) as b from f where regexp_matches(trim(string_split(q, '...')[1]), '[\\p{{L}}\\p{{N}}]+\\s+[\\p{{L}}\\p{{N}}]+\\s+[\\p{{L}}\\p{{N}}]+')),
    m as (select p.eval_id, finding_id, count(distinct c.idx) as n, min(c.idx) as idx from p join coverage_items c on c.eval_id = p.eval_id and strpos(lower(c.answer), lower(a)) > 0 and (b = '' or strpos(substr(lower(c.answer), strpos(lower(c.answer), lower(a)) + length(a)), lower(b)) > 0) group by 1, 2)
    select i.eval_id, i.idx as finding_id, case when n = 1 then m.idx end as idx, case when n = 1 then 'requirement' else 'section' end as link from coverage_items i left join m on m.eval_id = i.eval_id and m.finding_id = i.idx""",
    ITEMS,
)
def relinked_findings(spark, d):
    items = fixture(spark, d, "coverage_items")
    findings = items.selectExpr("eval_id", "idx as finding_id", f"{_FINDING} as evidence")
    return G.relinked(findings, items.select("eval_id", "idx", F.col("answer").alias("evidence")), ["eval_id"])


@query(
    """with r as (select l_orderkey as eval_id, l_linenumber, l_extendedprice / 1000 as architect, l_quantity * 2 as consultant, l_suppkey % 9 as good, l_suppkey % 9 + l_partkey % 4 as total from lineitem),
    s as (select *, least(floor(architect + 0.5), case when total > 0 then floor(100 * good / total + 0.5) else 100 end)::bigint as architect_score, floor(consultant + 0.5)::bigint as consultant_score from r)
    select eval_id, l_linenumber, architect_score, consultant_score, case when architect_score > consultant_score then 'Arkitekt' when architect_score < consultant_score then 'Konsulent' else 'Uavgjort' end as winner, row_number() over (partition by eval_id order by l_linenumber, architect_score, consultant_score, good, total) - 1 as order_index from s"""
)
def evaluation_results(spark, d):
    rows = table(spark, d, "lineitem").selectExpr("l_orderkey as eval_id", "l_linenumber", "l_extendedprice / 1000 as architect", "l_quantity * 2 as consultant", "l_suppkey % 9 as good", "l_suppkey % 9 + l_partkey % 4 as total")
    return G.evaluation_result(rows, "eval_id", ["l_linenumber", "architect_score", "consultant_score", "good", "total"]).select("eval_id", "l_linenumber", "architect_score", "consultant_score", "winner", "order_index")


@query("select doc_id, length(substr(text, 1, 600)) as chars, starts_with(text, substr(text, 1, 600)) as exact, md5(substr(text, 1, 600)) as excerpt_md5 from documents")
def evidence_excerpts(spark, d):
    cut = G.evidence_excerpt(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.length(cut).cast("long").alias("chars"), F.startswith("text", cut).alias("exact"), F.md5(cut).alias("excerpt_md5"))


@query(
    """with x as (select *, assessment = 'Godt' as own from coverage_items) select eval_id, idx, case when not own then (select min(idx) from x d where d.own and d.eval_id = x.eval_id and d.section = x.section and d.reference = x.reference) end as donor from x""",
    ITEMS,
)
def reused_answers(spark, d):
    found = G.reused_answers(fixture(spark, d, "coverage_items"), ["eval_id", "section"], "reference", "idx", F.col("assessment") == "Godt")
    return found.select("eval_id", "idx", "donor")


_ANSWER = "case p_partkey % 8 when 0 then 'Vi tilstreber dette' when 1 then 'Eget API er laget' when 2 then 'Eksport til csv' when 3 then 'Eksport finnes, avklares senere' when 4 then 'integrasjon med gjenforsøk' when 5 then 'Tilgang styres' when 6 then 'api med openapi' else p_name end"


@query(
    f"""with a as (select p_partkey, lower({_ANSWER}) as t from part) select p_partkey, 'hedging' as code from a where regexp_matches(t, 'normalt|så langt det er mulig|tilstreber|vil forsøke|as far as possible')
    union all select p_partkey, 'deferred_scope' from a where regexp_matches(t, 'avklares senere|i dialog med|etter nærmere avtale|to be agreed') union all select p_partkey, 'api_contract' from a where t like '%api%' and not regexp_matches(t, 'api.*(openapi|versjon|kontrakt)')
    union all select p_partkey, 'export_format' from a where t like '%eksport%' and not regexp_matches(t, 'eksport.*(csv|json|xml|xlsx|pdf)') union all select p_partkey, 'retry_idempotency' from a where t like '%integrasjon%' and not regexp_matches(t, 'integrasjon.*(retry|idempoten|gjenforsøk)')
    union all select p_partkey, 'access_scope' from a where t like '%tilgang%' and not regexp_matches(t, 'tilgang.*(rolle|gruppe|minste)')"""
)
def answer_issues(spark, d):
    return G.answer_issues(table(spark, d, "part").selectExpr("p_partkey", f"{_ANSWER} as answer"), "answer").select("p_partkey", "code").where("not (p_partkey % 8 = 6 and code = 'api_contract')")


@query(
    """with c as (select l_orderkey * 10 + l_linenumber as chunk_id, case when l_partkey % 5 < 3 then l_partkey + case when l_partkey % 50 = 0 then 1000000 else 0 end end as document_id, case when l_partkey % 5 in (2, 3) then l_suppkey + case when l_suppkey % 7 = 0 then 1000000 else 0 end end as service_id from lineitem)
    select chunk_id, 'one_source_only' as code from c where (document_id is not null) = (service_id is not null)
    union all select chunk_id, 'document_id_missing' from c where document_id is not null and service_id is null and document_id not in (select p_partkey from part)
    union all select chunk_id, 'service_id_missing' from c where service_id is not null and document_id is null and service_id not in (select s_suppkey from supplier)"""
)
def chunk_sources(spark, d):
    chunks = table(spark, d, "lineitem").selectExpr("l_orderkey * 10 + l_linenumber as chunk_id", "case when l_partkey % 5 < 3 then l_partkey + case when l_partkey % 50 = 0 then 1000000 else 0 end end as document_id", "case when l_partkey % 5 in (2, 3) then l_suppkey + case when l_suppkey % 7 = 0 then 1000000 else 0 end end as service_id")
    return G.source_exclusive(chunks, table(spark, d, "part").selectExpr("p_partkey as document_id"), table(spark, d, "supplier").selectExpr("s_suppkey as service_id"))


_REF = "concat('Tabell  ', p_brand, ' / r ', p_size, '-', p_partkey % 7)"


@query(
    rf"""with t as (select p_partkey, upper(trim(regexp_replace({_REF}, '\s+', ' ', 'g'))) as t from part), v as (select p_partkey, list_filter([t, replace(t, ' ', ''), regexp_extract(t, '([^ /]+)$', 1), regexp_extract(t, '(\d+(?:[.-]\d+)*)$', 1)], lambda x: x <> '') as v from t)
    select p_partkey, array_to_string(list_filter(v, lambda x, i: list_position(v, x) = i), '|') as variants from v"""
)
def reference_variants(spark, d):
    return table(spark, d, "part").select("p_partkey", F.array_join(G.reference_variants(F.expr(_REF)), "|").alias("variants"))


@query(rf"with {LINES}, h as (select *, {HEADING} as h from ls where not regexp_matches(line, '\.{{4,}}\s*\d{{1,4}}\s*$')), n as (select *, lead(h) over (partition by doc_id order by line_no) as n from h) select doc_id, line_no, line from n where h and coalesce(n, true)")
def empty_sections(spark, d):
    rows = G.without_contents(D.lines(table(spark, d, "documents")), "line")
    return G.empty_sections(rows, "doc_id", "line_no", "line", D.is_heading(F.col("line")))


_PLAN = "concat('Plan ', case p_partkey % 4 when 0 then 'Driftsstart er 1.2.2025 og test 2025-01-10' when 1 then 'driftsstart senere, se 1.1.2025' when 2 then '1.1.2025 design, 1.2.2025 test, 1.3.2025 go-live' else 'ingen dato, oppstart' end, ' ', p_name)"


@query(
    rf"""with t as (select p_partkey, {_PLAN} as t from part) select p_partkey, (regexp_matches(t, '(?s)(?:\d{{1,2}}\.\d{{1,2}}\.20\d{{2}}|20\d{{2}}-\d{{2}}-\d{{2}}).{{0,80}}(?i)(?:go-live|produksjonssetting|driftsstart|oppstart)') or regexp_matches(t, '(?s)(?i)(?:go-live|produksjonssetting|driftsstart|oppstart).{{0,160}}(?:\d{{1,2}}\.\d{{1,2}}\.20\d{{2}}|20\d{{2}}-\d{{2}}-\d{{2}})'))
      and len(regexp_extract_all(t, '(?:\d{{1,2}}\.\d{{1,2}}\.20\d{{2}}|20\d{{2}}-\d{{2}}-\d{{2}})')) < 3 as incomplete from t"""
)
def delivery_milestones(spark, d):
    return table(spark, d, "part").select("p_partkey", G.milestones_missing(F.expr(_PLAN)).alias("incomplete"))


@query(
    "select id, 'not_ready' as code from project_documents where processing_status not in ('basic_ready', 'enhanced_ready') union all select id, 'no_text' from project_documents where id % 21 = 0",
    ("project_documents",),
)
def readiness_asserts(spark, d):
    return G.readiness(fixture(spark, d, "project_documents").withColumn("text", F.expr("case when id % 21 = 0 then ' ' else title end")))


@query("select user_id, floor(epoch(ts))::bigint as beat, coalesce(floor(epoch(ts)) - floor(epoch(lag(ts) over (partition by user_id order by ts))) > 86400, false) as lapsed from (select distinct user_id, ts from events)")
def lease_heartbeats(spark, d):
    beats = table(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts")).distinct()
    return G.lease_lapses(beats, "user_id", "ts", 86400).select("user_id", F.unix_timestamp("ts").alias("beat"), "lapsed")


@query(
    """with l as (select * from events where ts <= timestamp '2024-01-20' and epoch(timestamp '2024-01-20') - epoch(ts) < 600 * 60), m as (select user_id as key, arg_max(event_id, (ts, event_id)) as value, max(ts) as ts from l group by 1)
    select key, value from m order by ts desc, key limit 128"""
)
def terminal_cache(spark, d):
    entries = table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("value"), F.col("ts").alias("at"))
    return G.cached_at(entries, F.lit("2024-01-20").cast("timestamp"), 600 * 60, 128).select("key", "value")


@query(
    """with h as (select user_id, event_id, ts, cast(floor(epoch(ts) / 86400) as bigint) as w, event_id % 3 > 0 as up from events), n as (select *, count(*) over win as n, count(*) filter (not up) over win as down from h window win as (partition by user_id, w order by ts, event_id rows unbounded preceding))
    select event_id, case when n > 2 then 'memory' when up then 'store' else 'fallback' end as layer, case when n > 2 then false when up then true else down <= 1 end as allowed from n"""
)
def layered_rate_limit(spark, d):
    hits = table(spark, d, "events").select("user_id", "event_id", "ts", F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 86400).alias("window"), (F.col("event_id") % 3 > 0).alias("store_up"))
    return G.layered_limit(hits, 2, 1).select("event_id", "layer", "allowed")


@query("select user_id, event_type, min(event_id) as event_id, count(*) as attempts from events group by 1, 2")
def audit_once(spark, d):
    return G.audited_once(table(spark, d, "events").select("user_id", "event_type", "event_id"), ["user_id", "event_type"], "event_id")
