"""How documents were read and are shown."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import readings as R
from lodestone.plans.registry import query
from lodestone.sources.tables import table

_HEAVY = "case when doc_id % 9 = 0 then concat(repeat('12 #', 200), text) when doc_id % 10 = 1 then substr(text, 1, 300) else text end"
_RICH = "concat(case doc_id % 5 when 0 then 'a | b | c' else '' end, case doc_id % 5 when 0 then concat(chr(10), 'x  y  z', chr(10), 'q | r | s', chr(10)) when 1 then repeat(' skal krav ', 4) when 2 then ' R-1 og K2.1, FUN-3 ' else ' kravet skalle ' end, substr(text, 1, 200))"
_MARKED = "concat(substr(text, 1, 100), case doc_id % 4 when 0 then ' Krav registrert i tabell, punktkrav  som skal besvares; krav uten egen tabellrad' when 1 then ' Krav registrert i tabell. ID / markering Prioritet Kravtekst' else '' end)"


@query(
    f"""with t as (select doc_id, trim({_HEAVY}, ' ') as t, doc_id % 3 * 200000 as size from documents) select doc_id, t = '' or (size >= 250000 and length(t) < 600) or (length(t) >= 400 and len(regexp_extract_all(t, '[A-Za-zÆØÅæøå]')) / length(t) < 0.35) as poor from t"""
)
def poor_extractions(spark, d):
    return table(spark, d, "documents").select("doc_id", R.poor_extraction(F.expr(_HEAVY), F.expr("doc_id % 3 * 200000")).alias("poor"))


@query(
    rf"""with t as (select doc_id, {_RICH} as t from documents) select doc_id, len(list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(x)), lambda x: len(string_split(x, '|')) >= 3 or regexp_matches(x, '\S+\s{{2,}}\S+\s{{2,}}\S+'))) >= 3
      or len(regexp_extract_all(t, '(?i)\b{R.REQUIREMENT_TERMS}\b')) >= 8 or len(regexp_extract_all(t, '\b{R.REQUIREMENT_ID}\b')) >= 3 as rich from t"""
)
def rich_documents(spark, d):
    return table(spark, d, "documents").select("doc_id", R.tables_or_requirements(F.expr(_RICH)).alias("rich"))


@query(f"with t as (select doc_id, {_MARKED} as t from documents) select doc_id, {' + '.join(f'''regexp_matches(t, '(?i){chr(92)}b{p}')::int''' for p in R.CORPUS_MARKERS)} >= 3 as corpus from t")
def corpus_types(spark, d):
    return table(spark, d, "documents").select("doc_id", R.is_corpus(F.expr(_MARKED)).alias("corpus"))


_LINE = "case p_partkey % 8 when 0 then concat('Bilag 2 ', p_name) when 1 then concat('kunde : ', p_name) when 2 then concat('Tabell ', p_size) when 3 then '' when 4 then concat('Rad ', p_size, ': x') else p_name end"


@query(f"with l as (select p_partkey, {_LINE} as l from part) select p_partkey, l = '' or {' or '.join(f'''regexp_matches(l, '(?i){p}')''' for p in R.BOILERPLATE)} as boilerplate from l")
def boilerplate_lines(spark, d):
    return table(spark, d, "part").select("p_partkey", R.is_boilerplate(F.expr(_LINE)).alias("boilerplate"))


@query(
    """with p as (select o_orderkey as id, o_totalprice / 50 as chars0, o_custkey % 60 / 100 as score0, o_orderkey % 5 as entries0, o_totalprice / 90 * (o_orderkey % 3) as chars1, o_custkey % 70 / 100 as score1, o_orderkey % 7 as entries1, o_orderkey % 11 = 0 as t from orders)
    select id, (chars0 < 2000 or chars1 >= chars0 * 0.55) and score1 >= score0 - 0.05 and (entries1 > entries0 or t or score1 > score0) as taken from p"""
)
def better_parses(spark, d):
    orders = table(spark, d, "orders")
    first = orders.selectExpr("o_orderkey as id", "0 as attempt", "o_totalprice / 50 as chars", "o_custkey % 60 / double(100) as score", "o_orderkey % 5 as entries", "false as has_table")
    second = orders.selectExpr("o_orderkey as id", "1 as attempt", "o_totalprice / 90 * (o_orderkey % 3) as chars", "o_custkey % 70 / double(100) as score", "o_orderkey % 7 as entries", "o_orderkey % 11 = 0 as has_table")
    return R.better_parse(first.unionByName(second), "id")


@query("select doc_id, case when length(trim(text, ' ')) <= 120 then trim(text, ' ') else rtrim(substr(trim(text, ' '), 1, 108), ' ') || chr(10) || '[avkortet]' end as context from documents")
def bounded_contexts(spark, d):
    return table(spark, d, "documents").select("doc_id", R.bounded_context(F.col("text"), 120).alias("context"))


@query(
    r"""with w as (select item_id, list_filter(string_split(text, ' '), lambda w: regexp_matches(w, '(?i)^[a-z]{4,}$') and not regexp_matches(w, '(?i)^(the|and|that)')) as w from benchmark)
    select item_id, array_to_string(list_slice(list_filter(w, lambda x, i: list_position(list_transform(w, lambda y: lower(y)), lower(x)) = i), 1, 12), ',') as words from w"""
)
def signal_words(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.array_join(R.signal_words(F.split("text", " "), "(?i)^[a-z]{4,}$", "(?i)^(the|and|that)"), ",").alias("words"))


@query(
    """select l_orderkey, l_linenumber, l_partkey, array_to_string(list_filter(['Bilag ' || l_orderkey, case when l_partkey % 4 = 0 then '' when l_partkey % 4 = 1 or l_partkey % 9 = l_partkey % 9 + l_suppkey % 3 then 'side ' || l_partkey % 9 else 'side ' || l_partkey % 9 || '-' || (l_partkey % 9 + l_suppkey % 3) end,
      case when l_suppkey % 2 = 0 then 'Tabell ID ' || l_linenumber else '' end, 'K-' || l_linenumber], lambda x: x <> ''), ', ') as label from lineitem"""
)
def source_labels(spark, d):
    first, last = F.expr("case when l_partkey % 4 > 0 then l_partkey % 9 end"), F.expr("case when l_partkey % 4 > 1 then l_partkey % 9 + l_suppkey % 3 end")
    parts = [F.concat(F.lit("Bilag "), F.col("l_orderkey").cast("string")), R.page_label(first, last), F.expr("case when l_suppkey % 2 = 0 then concat('Tabell ID ', l_linenumber) end"), F.concat(F.lit("K-"), F.col("l_linenumber").cast("string"))]
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", R.source_label(parts).alias("label"))


@query(
    """with i as (select p_partkey as id, case p_partkey % 4 when 0 then upper(p_name) || ' ...' when 1 then substr(p_name, 1, 6) when 2 then substr(p_name, 4, 9) else 'annet' end as t, p_name as s, p_partkey % 10 > 0 as there from part), k as (select id, there, trim(regexp_replace(lower(regexp_replace(t, '\\s*(…|\\.{3})$', '')), '\\s+', ' ', 'g')) as a, lower(s) as b from i)
    select id, there and a <> '' and (contains(a, b) or contains(b, a)) as matches from k"""
)
def contained_requirements(spark, d):
    parts = table(spark, d, "part")
    items = parts.selectExpr("p_partkey as id", "case p_partkey % 4 when 0 then concat(upper(p_name), ' ...') when 1 then substr(p_name, 1, 6) when 2 then substr(p_name, 4, 9) else 'annet' end as text")
    return R.contained(items, parts.where("p_partkey % 10 > 0").selectExpr("p_partkey as id", "p_name as text"), ["id"])


@query(
    """with e as (select l_orderkey as k, l_linenumber * 1000000 + l_partkey as o, l_partkey % 4 as item from lineitem), a as (select k, case when k % 5 = 1 then -o else o end as o, case when k % 5 = 2 and o % 3 = 0 then 9 else item end as item from e where k % 5 <> 3),
    el as (select k, list(item order by o) as l, list_sort(list(item)) as s from e group by 1), al as (select k, list(item order by o) as l, list_sort(list(item)) as s from a group by 1)
    select el.k as id, case when al.k is null then 'empty' when el.l = al.l then 'in_order' when el.s = al.s then 'all_there' else 'deficient' end as state from el left join al on al.k = el.k"""
)
def inventory_states(spark, d):
    expected = table(spark, d, "lineitem").selectExpr("l_orderkey as id", "l_linenumber * 1000000 + l_partkey as o", "l_partkey % 4 as item")
    actual = expected.where("id % 5 <> 3").selectExpr("id", "case when id % 5 = 1 then -o else o end as o", "case when id % 5 = 2 and o % 3 = 0 then 9 else item end as item")
    return R.inventory_state(expected, actual, "id", "o", "item")


@query(
    """with k as (select l_orderkey, 'K' || l_linenumber as label, repeat(l_returnflag, 500) as t, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_returnflag) as k, count(*) over (partition by l_orderkey) as n from lineitem)
    select l_orderkey, md5(string_agg('- ' || label || ': ' || t[:420], chr(10) order by k) || case when max(n) > 3 then chr(10) || '… ' || (max(n) - 3) || ' til' else '' end) as context_md5 from k where k <= 3 group by 1"""
)
def ledger_contexts(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", F.concat(F.lit("K"), F.col("l_linenumber").cast("string")).alias("label"), F.repeat("l_returnflag", 500).alias("t"))
    found = R.ledger_context(rows, "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey", "l_returnflag"], "label", "t", 3)
    return found.select("l_orderkey", F.md5("context").alias("context_md5"))


@query(
    """with s as (select conv_id, list(text order by turn, role, text) as signals, min(role) as role from conversations group by 1), q as (select conv_id, trim(regexp_replace('Prosjekt ' || conv_id || chr(10) || chr(10) || 'Pris: kost' || chr(10) || chr(10) || array_to_string(signals[:24], chr(10)), '\\s+', ' ', 'g')) as q from s)
    select conv_id, case when length(q) <= 2400 then q else trim(substr(q, 1, 2399)) || '…' end as query from q"""
)
def retrieval_seeds(spark, d):
    signals = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda x: x["text"])
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(signals.alias("signals"))
    seed = R.retrieval_seed(F.concat(F.lit("Prosjekt "), F.col("conv_id").cast("string")), F.lit(None).cast("string"), F.lit("Pris: kost"), F.col("signals"))
    return rows.select("conv_id", seed["query"].alias("query"))
