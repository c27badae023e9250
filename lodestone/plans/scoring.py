"""Scores of coverage and extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import scoring as S
from lodestone.plans.registry import fixture, query
from lodestone.sources.tables import table

ISSUES = """n as (select eval_id, count(*) as n from coverage_items group by 1),
  placed as (select *, lower(trim(coalesce(reference, ''))) || '|' || lower(trim(coalesce(full_reference, ''))) || '|' || lower(trim(coalesce(source_reference, ''))) as identity from coverage_items),
  again as (select *, row_number() over (partition by eval_id, order_index order by idx) > 1 as o, row_number() over (partition by eval_id, identity order by idx) > 1 as i from placed),
  issues as (
    select h.eval_id, 'total_mismatch' as code, null as idx from coverage_heads h join n using (eval_id) where total <> n
    union all select h.eval_id, 'assessed_mismatch', null from coverage_heads h join n using (eval_id) where assessed <> n
    union all select h.eval_id, 'assessment_count_mismatch', null from coverage_heads h join n using (eval_id) where counted <> n
    union all select eval_id, 'order_index_mismatch', idx from again where order_index is distinct from idx
    union all select eval_id, 'duplicate_order_index', idx from again where order_index is not null and o
    union all select eval_id, 'duplicate_reference_identity', idx from again where identity <> '||' and i
    union all select eval_id, 'missing_reference', idx from again where trim(reference) = ''
    union all select eval_id, 'invalid_assessment', idx from again where assessment not in ('Godt', 'Dårlig', 'Mangler', 'Uklart')
    union all select eval_id, 'missing_rationale', idx from again where trim(rationale) = ''
    union all select eval_id, 'missing_evidence', idx from again where trim(evidence) = ''
    union all select eval_id, 'missing_recommendation', idx from again where trim(recommendation) = ''
    union all select eval_id, 'missing_with_matched_answer', idx from again where assessment = 'Mangler' and answer_document is not null)"""
GROUPS = ("coverage_items", "coverage_heads")


def _issues(spark, d):
    return S.self_consistency(fixture(spark, d, "coverage_heads"), fixture(spark, d, "coverage_items"))


@query(f"with {ISSUES} select eval_id, code, idx from issues", GROUPS)
def self_consistency(spark, d):
    return _issues(spark, d)


@query(f"with {ISSUES} select eval_id, code, idx from (select *, row_number() over (partition by eval_id order by idx nulls first, code) as k from issues) where k <= 6", GROUPS)
def first_issues(spark, d):
    return S.first_issues(_issues(spark, d), ["eval_id"], ["idx", "code"])


@query(
    f"""with {ISSUES}, u as (select eval_id, count(*) as n, avg((length(trim(rationale)) >= 24 and length(trim(evidence)) >= 24 and length(trim(recommendation)) >= 24)::int) as useful,
      avg((trim(reference) <> '' or trim(full_reference) <> '' or trim(coalesce(source_reference, '')) <> '')::int) as referred, avg((length(trim(full_reference)) >= 5)::int) as subtitled from coverage_items group by 1),
    i as (select eval_id, count(*) as issues from issues group by 1),
    s as (select h.eval_id, floor(least(1.0, least(total, assessed, n) / source_count) * 25 + referred * 15 + subtitled * 10 + useful * 20 + greatest(0, 20 - 2 * coalesce(issues, 0)) + 10 + 0.5) as score from coverage_heads h join u using (eval_id) left join i using (eval_id))
    select eval_id, greatest(0, least(100, score))::bigint as score, case when score >= 95 then 'Strong' when score >= 85 then 'Usable' when score >= 75 then 'Needs review' else 'Not ready' end as band from s""",
    GROUPS,
)
def project_scores(spark, d):
    return S.project_scores(fixture(spark, d, "coverage_heads"), fixture(spark, d, "coverage_items"), _issues(spark, d))


_SUMS = {
    "exact": "o_orderkey % 3 = 0", "expected": None, "ordered": "l_linenumber < 4", "strict": "l_linenumber < 5", "aligned": "l_linenumber < 6", "usable": "l_partkey % 2 = 0", "usable_ok": "l_partkey % 4 = 0",
    "made": "l_partkey % 2 = 1", "made_ok": "l_partkey % 6 = 1", "heading": "l_suppkey % 2 = 0", "heading_ok": "l_suppkey % 4 = 0", "located": "l_tax < 0", "located_ok": "l_tax < 0",
}
_COUNTS = ", ".join(f"{'max' if n == 'exact' else 'sum'}({'1' if t is None else f'case when {t} then 1 else 0 end'}) as {n}" for n, t in _SUMS.items())


def _pc(a: str, b: str) -> str:
    return f"case when ({b}) = 0 then 0 else floor(({a}) / ({b}) * 1000 + 0.5) / 10 end"


def _ra(a: str, b: str) -> str:
    return f"case when ({b}) = 0 then 0 else ({a}) / ({b}) end"


@query(
    f"""with doc as (select o_orderpriority as bucket, o_orderkey, {_COUNTS} from orders join lineitem on l_orderkey = o_orderkey group by 1, 2), s as (select bucket, count(*)::double as documents, {", ".join(f"sum({n})::double as {n}" for n in _SUMS)} from doc group by 1)
    select bucket, documents::bigint as documents, {_pc("exact", "documents")} as count_accuracy, {_pc("ordered", "expected")} as ordered_text, {_pc("strict", "expected")} as strict_recall, {_pc("aligned", "expected")} as aligned_text, {_pc("usable_ok", "usable")} as usable_ids,
      {_pc("made_ok", "made")} as made_ids, {_pc("usable_ok + made_ok", "usable + made")} as ids, {_pc("heading_ok", "heading")} as headings, {_pc("located_ok", "located")} as locators,
      round(0.45 * {_ra("strict", "expected")} + 0.25 * {_ra("usable_ok + made_ok", "usable + made")} + 0.25 * {_ra("heading_ok", "heading")} + 0.05 * {_ra("located_ok", "located")}, 6) as composite from s"""
)
def extraction_buckets(spark, d):
    orders, items = table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), table(spark, d, "lineitem")
    counts = [(F.max if n == "exact" else F.sum)(F.lit(1) if t is None else F.expr(t).cast("int")).alias(n) for n, t in _SUMS.items()]
    docs = items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("o_orderpriority").alias("bucket"), "o_orderkey").agg(*counts)
    return S.bucket_scores(docs, "bucket").withColumn("composite", F.round("composite", 6))


@query(
    r"""with r as (select l_orderkey, l_linenumber, l_partkey % 3 <> 0 as usable, 'K-' || l_partkey % 9 as expected_id, 'mark ' || l_partkey % 5 as expected_mark, case when l_partkey % 2 = 0 then 'Tekst' end as expected_kind, 'k ' || l_suppkey % 9 as actual_id, case when l_suppkey % 4 = 0 then 'Tekstkrav 1' end as excerpt,
      'Heading ' || l_partkey % 3 as expected_heading, case when l_suppkey % 5 > 0 then 'Top > heading  ' || l_suppkey % 3 end as heading from lineitem),
    t as (select *, regexp_replace(upper(expected_id), '[\s._-]+', '', 'g') as e, regexp_replace(upper(expected_mark), '[\s._-]+', '', 'g') as m, regexp_replace(upper(actual_id), '[\s._-]+', '', 'g') as a, regexp_replace(upper(coalesce(excerpt, '')), '[\s._-]+', '', 'g') as x from r)
    select l_orderkey, l_linenumber, case when usable then e in (a, x) or m in (a, x) else coalesce(contains(a || ' ' || x, upper(expected_kind)), false) end as id_ok,
      coalesce(list_contains(list_transform(string_split(heading, '>'), lambda h: lower(trim(regexp_replace(h, '\s+', ' ', 'g')))), lower(expected_heading)), false) as heading_ok, excerpt is not null or heading is not null as located from t"""
)
def entry_matches(spark, d):
    rows = table(spark, d, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "l_partkey % 3 <> 0 as usable", "concat('K-', l_partkey % 9) as expected_id", "concat('mark ', l_partkey % 5) as expected_mark", "case when l_partkey % 2 = 0 then 'Tekst' end as expected_kind",
        "concat('k ', l_suppkey % 9) as actual_id", "case when l_suppkey % 4 = 0 then 'Tekstkrav 1' end as excerpt", "cast(null as string) as table_id", "concat('Heading ', l_partkey % 3) as expected_heading",
        "case when l_suppkey % 5 > 0 then concat('Top > heading  ', l_suppkey % 3) end as heading", "cast(array() as array<int>) as pages",
    )
    return S.entry_matches(rows).select("l_orderkey", "l_linenumber", "id_ok", "heading_ok", "located")


@query(
    r"""select doc_id, len(regexp_extract_all(text, 'Ã[¦¸¥†˜…]|�')) as mojibake, len(regexp_extract_all(text, '\s+[,.;:!?]')) as space_before, len(regexp_extract_all(text, '[;,!?][\p{L}\p{N}]|\.\p{Lu}')) as space_missing from documents"""
)
def text_counters(spark, d):
    return table(spark, d, "documents").select("doc_id", *[c.cast("long").alias(n) for n, c in S.text_counters(F.col("text")).items()])


_ENTRY = "case p_partkey % 7 when 0 then 'Leverandøren skal beskrive' when 1 then 'Resultatet. Skal vises' when 2 then 'Leverandøren bes beskrive løsning for' else p_name end"
_EXCERPT = "case p_partkey % 3 when 0 then concat('1. ', upper(p_name), ' og mer') when 1 then concat(p_name, ' oghvis') else 'annet' end"


@query(
    f"""with e as (select p_partkey as id, {_ENTRY} as text, {_EXCERPT} as excerpt from part), t as (select *, strpos(lower(excerpt), lower(text)) as spot from e)
    select id, 'truncated_describe_requirement' as code from e where text = 'Leverandøren skal beskrive' union all select id, 'truncated_authentication_requirement' from e where text = 'Leverandøren bes beskrive løsning for'
    union all select id, 'mid_sentence_requirement_start' from e where text like 'Resultatet.%'
    union all select id, 'requirement_source_tail_omitted' from t where spot > 0 and regexp_matches(ltrim(substr(excerpt, spot + length(text))), '(?i)^(?:som|der|at|hvordan|hvorvidt|om|og|eller|samt|med|for|til|av)($|[^A-Za-z0-9_])')"""
)
def ledger_lint(spark, d):
    return S.lint(table(spark, d, "part").selectExpr("p_partkey as id", f"{_ENTRY} as text", f"{_EXCERPT} as excerpt"))


_TITLE = "case event_id % 5 when 0 then 'Mindre nedetid' when 1 then 'Lavere lisens' when 2 then 'Bedre respons' when 3 then 'Automatisert flyt' else 'Annet' end"


@query(
    f"""with recursive c as (select user_id % 50 as project_id, case event_id % 5 when 0 then 'Redusert risiko' when 1 then 'Lavere kostnader' when 2 then 'Bedre brukeropplevelse' when 3 then 'Høyere produktivitet' else 'Redusert risiko' end as category, case when user_id % 50 = 7 then 0 else event_id % 4 * (event_id % 5 + 1) end as share from events where event_id % 50 < 40),
    s as (select project_id, category, list_position(['Redusert risiko', 'Lavere kostnader', 'Bedre brukeropplevelse', 'Høyere produktivitet'], category) as o, sum(share) as share from c group by 1, 2),
    p as (select project_id, category, row_number() over (partition by project_id order by o) - 1 as k, count(*) over (partition by project_id) as n, case when sum(share) over (partition by project_id) > 0 then greatest(1, floor(share / sum(share) over (partition by project_id) * 100 + 0.5)) else floor(100 / count(*) over (partition by project_id)) end::bigint as p from s),
    l as (select project_id, list(p order by k) as ps, 100 - sum(p)::bigint as off, max(n) as n from p group by 1),
    r as (select project_id, ps, off, n, 0 as i from l union all
      select project_id, list_transform(ps, lambda x, j: case when j - 1 = i % n then x + (case when off > 0 then 1 when off < 0 and x > 1 then -1 else 0 end) else x end), off - (case when off > 0 then 1 when off < 0 and ps[i % n + 1] > 1 then -1 else 0 end), n, i + 1 from r where off <> 0)
    select p.project_id, p.category, r.ps[p.k + 1] as share from p join r on r.project_id = p.project_id and r.off = 0"""
)
def value_shares(spark, d):
    rows = table(spark, d, "events").where("event_id % 50 < 40").selectExpr("user_id % 50 as project_id", f"{_TITLE} as title", "case when user_id % 50 = 7 then 0 else event_id % 4 * (event_id % 5 + 1) end as share")
    return S.value_shares(rows.withColumn("category", S.value_category(F.col("title"))), ["project_id"])


@query(
    """with r as (select event_id % 100 as current_score, event_id * 7 % 97 as main_score, value as current_facts, value - 1 as main_facts, event_id % 50 + 10 as current_ms, event_id % 50 + 11 as main_ms from events)
    select count(*) filter (current_score > main_score) as wins, count(*) filter (current_score < main_score) as losses, count(*) filter (current_score = main_score) as ties,
      avg(current_score) > avg(main_score) and count(*) filter (current_score > main_score) >= count(*) filter (current_score < main_score) and avg(current_facts) >= avg(main_facts) as better,
      (avg(current_ms) / avg(main_ms) - 1) * 100 <= 5 as fast_enough, stddev_pop(current_score) <= stddev_pop(main_score) + 5 as stable from r"""
)
def ab_gates(spark, d):
    rounds = table(spark, d, "events").selectExpr("event_id % 100 as current_score", "event_id * 7 % 97 as main_score", "value as current_facts", "value - 1 as main_facts", "event_id % 50 + 10 as current_ms", "event_id % 50 + 11 as main_ms")
    return S.gates(rounds)
