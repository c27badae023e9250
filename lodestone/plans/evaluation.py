"""Scoring queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import evaluation as E
from lodestone.plans.registry import query
from lodestone.sources.tables import table

ITEMS = """items as (select l_orderkey as doc, l_linenumber as idx, case when l_linenumber = 6 then null else 'R-' || (l_partkey % case when l_linenumber = 5 then 3 else 1000 end) end as ref, 'text ' || (l_suppkey + case when l_quantity > 48 then 1 else 0 end) as text,
      case when l_discount > 0.09 then 'best' when l_discount > 0.05 then 'good' else 'weak' end as assessment, case when l_tax > 0.02 then 'see page' end as evidence from lineitem where l_linenumber < 7),
    source as (select l_orderkey as doc, l_linenumber as idx, 'R-' || (l_partkey % 1000) as ref, 'text ' || l_suppkey as text from lineitem where l_linenumber <> 2)"""


def _items(spark, d):
    lines = table(spark, d, "lineitem")
    items = lines.where("l_linenumber < 7").selectExpr(
        "l_orderkey as doc",
        "l_linenumber as idx",
        "case when l_linenumber = 6 then null else 'R-' || (l_partkey % case when l_linenumber = 5 then 3 else 1000 end) end as ref",
        "'text ' || (l_suppkey + case when l_quantity > 48 then 1 else 0 end) as text",
        "case when l_discount > 0.09 then 'best' when l_discount > 0.05 then 'good' else 'weak' end as assessment",
        "case when l_tax > 0.02 then 'see page' end as evidence",
    )
    source = lines.where("l_linenumber <> 2").selectExpr("l_orderkey as doc", "l_linenumber as idx", "'R-' || (l_partkey % 1000) as ref", "'text ' || l_suppkey as text")
    return items, source


@query(
    f"""with {ITEMS}, n as (select *, row_number() over (partition by doc, ref order by idx) > 1 as again from items), j as (select n.*, s.ref as sref, s.text as stext from n left join source s on s.doc = n.doc and s.idx = n.idx)
    select doc, idx, 'invented_item' as code from j where sref is null
    union all select doc, idx, 'invented_reference' from j where sref is not null and ref <> sref
    union all select doc, idx, 'requirement_text_mismatch' from j where stext is not null and text <> stext
    union all select doc, idx, 'missing_reference' from j where ref is null or ref = ''
    union all select doc, idx, 'duplicate_reference_identity' from j where again
    union all select doc, idx, 'invalid_assessment' from j where assessment not in ('good', 'weak', 'missing')
    union all select doc, idx, 'good_without_evidence' from j where assessment = 'good' and coalesce(evidence, '') = ''
    union all select s.doc, s.idx, 'missing_item' from source s where not exists (select 1 from items i where i.doc = s.doc and i.idx = s.idx)"""
)
def integrity_issues(spark, d):
    return E.integrity_issues(*_items(spark, d))


@query(
    f"""with {ITEMS}, g as (select doc, max(case when doc % 9 = 0 then 3 else 0 end) + count(*) as claimed, count(*) as items, count(*) filter (where assessment <> 'best') as assessed from items group by 1)
    select doc, claimed, items, assessed, greatest(claimed, items) as total, cast(floor(assessed * 100 / greatest(claimed, items) + 0.5) as bigint) as percent, case when claimed <> items then 'inconsistent' when assessed = greatest(claimed, items) then 'complete' else 'incomplete' end as status from g"""
)
def coverage_counters(spark, d):
    items, _ = _items(spark, d)
    sized = items.groupBy("doc").agg((F.max(F.expr("case when doc % 9 = 0 then 3 else 0 end")) + F.count("*")).alias("claimed"))
    return E.coverage_counters(items.join(sized, "doc"), ["doc"], "claimed", F.col("assessment") != "best")


@query(
    """with e as (select distinct l_partkey as k from lineitem where l_returnflag = 'R'), f as (select l_partkey as k, count(*) as f from lineitem where l_returnflag = 'A' group by 1),
    c as (select count(*) filter (where e.k is not null and f.k is not null) as matched, count(*) filter (where f.k is null) as missing, count(*) filter (where e.k is null) as unexpected, coalesce(sum(f.f - 1) filter (where f.f > 1), 0) as duplicates from e full join f on e.k = f.k),
    r as (select *, round(matched / (matched + unexpected), 6) as precision, round(matched / (matched + missing), 6) as recall from c)
    select matched, missing, unexpected, cast(duplicates as bigint) as duplicates, precision, recall, round(2 * precision * recall / (precision + recall), 5) as f1 from r"""
)
def extraction_prf(spark, d):
    lines = table(spark, d, "lineitem").select(F.col("l_partkey").alias("k"), "l_returnflag")
    return E.precision_recall(lines.where("l_returnflag = 'R'").distinct(), lines.where("l_returnflag = 'A'"), "k")


@query(
    """select doc_id, case when a + b + c = 3 then 'present' when a + b + c = 0 then 'missing' else 'partial' end as status from (
      select doc_id, (contains(lower(text), 'tion') or contains(lower(text), 'ment'))::int as a, contains(lower(text), 'the')::int as b, (contains(lower(text), 'ing') or contains(lower(text), 'heit'))::int as c from documents)"""
)
def fact_scores(spark, d):
    return table(spark, d, "documents").select("doc_id", E.fact_status(F.col("text"), [["tion", "ment"], ["the"], ["ing", "heit"]]).alias("status"))


@query(
    r"""with w as (select item_id, regexp_extract_all(lower(text), '[a-z]+') as ws from benchmark) select a.item_id, round(case when len(a.ws) > 0 then len(list_filter(a.ws, lambda x: list_contains(b.ws, x))) / len(a.ws) else 1 end, 6) as recall from w a join w b on b.item_id = a.item_id + 1"""
)
def token_recall(spark, d):
    a = table(spark, d, "benchmark").select("item_id", F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), 0).alias("ws"))
    b = a.select((F.col("item_id") - 1).alias("item_id"), F.col("ws").alias("other"))
    return a.join(b, "item_id").select("item_id", F.round(E.token_recall(F.col("ws"), F.col("other")), 6).alias("recall"))


@query(
    """with r as (select o_orderkey as row_id, o_custkey as a, o_orderpriority as b, cast(o_orderdate as date) as c from orders where o_orderkey % 2 = 0), s as (select o_orderkey as answer_id, o_custkey as a, o_orderpriority as b, cast(o_orderdate as date) as c from orders where o_orderkey % 2 = 1),
    w1 as (select x.row_id, y.answer_id, 1 as way from (select a, b, min(row_id) as row_id from r group by 1, 2 having count(*) = 1) x join (select a, b, min(answer_id) as answer_id from s group by 1, 2 having count(*) = 1) y using (a, b)),
    r2 as (select * from r where row_id not in (select row_id from w1)), s2 as (select * from s where answer_id not in (select answer_id from w1)),
    w2 as (select x.row_id, y.answer_id, 2 as way from (select a, min(row_id) as row_id from r2 group by 1 having count(*) = 1) x join (select a, min(answer_id) as answer_id from s2 group by 1 having count(*) = 1) y using (a))
    select * from w1 union all select * from w2"""
)
def answer_binding_cascade(spark, d):
    orders = table(spark, d, "orders").selectExpr("o_orderkey as row_id", "o_custkey as a", "o_orderpriority as b")
    answers = orders.where("row_id % 2 = 1").withColumnRenamed("row_id", "answer_id")
    return E.bind_answers(orders.where("row_id % 2 = 0"), answers, [["a", "b"], ["a"]])


@query("select l_orderkey as doc, l_returnflag as ref, l_linestatus as text, cast(floor(l_quantity / 10) as int) as entry_order, min(l_linenumber) as row_id from lineitem group by 1, 2, 3, 4")
def ledger_dedupe(spark, d):
    rows = table(spark, d, "lineitem").selectExpr("l_orderkey as doc", "l_returnflag as ref", "l_linestatus as text", "cast(floor(l_quantity / 10) as int) as entry_order", "l_linenumber as row_id")
    return E.ledger_dedupe(rows)


@query(
    """with recursive s as (select l_orderkey as doc, l_linenumber as i, cast(floor(l_quantity) as bigint) as z, row_number() over (partition by l_orderkey order by l_linenumber, floor(l_quantity)) as k from lineitem),
    f as (select doc, i, k, 0 as batch, 1 as n, z as used from s where k = 1
      union all select s.doc, s.i, s.k, case when f.n < 3 and f.used + s.z <= 60 then f.batch else f.batch + 1 end, case when f.n < 3 and f.used + s.z <= 60 then f.n + 1 else 1 end, case when f.n < 3 and f.used + s.z <= 60 then f.used + s.z else s.z end from f join s on s.doc = f.doc and s.k = f.k + 1)
    select doc, i, batch from f"""
)
def coverage_batches(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("i"), F.col("l_quantity").alias("z"))
    return E.batches(rows, "doc", "i", F.col("z"), 3, 60)


@query(
    """select metric, value, threshold, value >= threshold as passed from (values ('good_share', 0.5), ('nontoxic_share', 0.75)) t(metric, threshold)
    join (select 'good_share' as metric, round(avg(quality), 6) as value from labels union all select 'nontoxic_share', round(1 - avg(toxic), 6) from labels) using (metric)"""
)
def quality_gate(spark, d):
    metrics = table(spark, d, "labels").agg(F.round(F.avg("quality"), 6).alias("good_share"), F.round(1 - F.avg("toxic"), 6).alias("nontoxic_share"))
    rows = metrics.select(F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value"), F.lit(t).alias("threshold")) for m, t in (("good_share", 0.5), ("nontoxic_share", 0.75))])))
    return rows.withColumn("passed", F.col("value") >= F.col("threshold"))
