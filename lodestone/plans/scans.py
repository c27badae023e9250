"""Scans and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.plans.registry import query
from lodestone.sources import scans as S
from lodestone.sources.tables import table

_HEAD = {0: "255044462D312E37", 1: "504B0304AABB", 2: "504B0506", 3: "D0CF11E0A1B11AE1", 4: "6100620000", 5: "4142"}
_HEX = "case page_id % 6 " + " ".join(f"when {k} then '{v}'" for k, v in _HEAD.items()) + " end"
_FORMAT = "case page_id % 5 when 0 then 'pdf' when 1 then 'docx' when 2 then 'xls' when 3 then 'txt' else 'xlsx' end"


@query(
    f"""with f as (select page_id, {_HEX} as h, {_FORMAT} as f from pages) select page_id, case f when 'pdf' then starts_with(h, '255044462D') when 'xls' then h = 'D0CF11E0A1B11AE1' when 'txt' then h not in ('6100620000', '504B0304AABB00') else substr(h, 1, 8) in ('504B0304', '504B0506', '504B0708') end as fits from f"""
)
def file_signatures(spark, d):
    return table(spark, d, "pages").select("page_id", S.signature_fits(F.unhex(F.expr(_HEX)), F.expr(_FORMAT)).alias("fits"))


@query(
    """with i as (select o_orderkey as page, l_linenumber * 5 as y, l_partkey % 50 * 10 as x, l_linenumber * 100 + l_partkey % 50 as item_no, l_returnflag || l_partkey as text, l_suppkey % 12 as width from orders join lineitem on l_orderkey = o_orderkey where l_orderkey % 4 = 0),
    u as (select page, y, x, item_no, text, width from (select *, row_number() over (partition by page, item_no order by text, width) as k from i) where k = 1),
    g as (select *, x - lag(x + width) over (partition by page, y order by x, item_no) as gap from u)
    select page, row_number() over (partition by page order by y desc) as line_no, string_agg(case when gap > 3 then ' ' else '' end || text, '' order by x, item_no) as text from g group by page, y"""
)
def glyph_lines(spark, d):
    from pyspark.sql import Window

    items = table(spark, d, "lineitem").where("l_orderkey % 4 = 0").selectExpr("l_orderkey as page", "l_linenumber * 5 as y", "l_partkey % 50 * 10 as x", "l_linenumber * 100 + l_partkey % 50 as item_no", "concat(l_returnflag, l_partkey) as text", "l_suppkey % 12 as width")
    known = table(spark, d, "orders").select(F.col("o_orderkey").alias("page"))
    once = items.join(known, "page", "left_semi").withColumn("k", F.row_number().over(Window.partitionBy("page", "item_no").orderBy("text", "width"))).where("k = 1")
    return S.glyph_lines(once.selectExpr("page", "item_no", "double(x) as x", "double(y) as y", "double(width) as width", "text"), "page")


@query(
    """with c as (select user_id % 20 as sheet, event_id % 70 as row, case event_type when 'view' then 0 when 'click' then 1 else 27 end as col, case when min(event_id) % 9 > 0 then cast(min(event_id) as varchar) else ' ' end as text from events group by 1, 2, 3),
    l as (select sheet, row, 'Rad ' || (row + 1) || ': ' || string_agg(case col when 0 then 'A' when 1 then 'B' else 'AB' end || (row + 1) || ': ' || text, ' | ' order by col) as line from c where trim(text) <> '' group by 1, 2),
    n as (select *, row_number() over (partition by sheet order by row) - 1 as n from l)
    select sheet, n // 25 as block, n // 25 * 25 + 1 as first_row, n // 25 * 25 + count(*) as last_row, 'Ark: ' || sheet || chr(10) || string_agg(line, chr(10) order by n) as text from n group by sheet, n // 25"""
)
def sheet_blocks(spark, d):
    cells = table(spark, d, "events").groupBy(F.expr("user_id % 20").alias("sheet"), F.expr("event_id % 70").alias("row"), F.expr("case event_type when 'view' then 0 when 'click' then 1 else 27 end").alias("col")).agg(F.min("event_id").alias("e"))
    return S.sheet_blocks(cells.selectExpr("sheet", "row", "col", "case when e % 9 > 0 then cast(e as string) else ' ' end as text"), "sheet")


@query(
    """select l_orderkey as table_id, l_linenumber::int as row, string_agg(n || ': ' || v, ' | ' order by c) as text from (
      select l_orderkey, l_linenumber, 0 as c, 'Krav' as n, 'k' || min(l_partkey) as v from lineitem group by all union all select l_orderkey, l_linenumber, 1, 'Svar', 's ' || min(l_suppkey) from lineitem group by all union all select l_orderkey, l_linenumber, 2, 'Svar 2', min(l_returnflag) from lineitem group by all having min(l_returnflag) <> 'N') group by 1, 2"""
)
def layout_tables(spark, d):
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag").repartition("l_orderkey")  # a table's lines stay in one place from here on
    rows = lines.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"), F.min("l_suppkey").alias("s"), F.min("l_returnflag").alias("r"))
    cell = lambda text, row, col, header=False: F.struct(text.alias("text"), F.lit(row).alias("start_row_offset_idx") if isinstance(row, int) else row.cast("int").alias("start_row_offset_idx"), F.lit(col).alias("start_col_offset_idx"), F.lit(header).alias("column_header"))
    line = F.col("l_linenumber")
    body = F.array(cell(F.concat(F.lit("k"), F.col("p").cast("string")), line, 0), cell(F.concat(F.lit(" s  "), F.col("s").cast("string")), line, 1), cell(F.when(F.col("r") != "N", F.col("r")).otherwise(""), line, 2))
    head = F.array(cell(F.lit("Krav"), 0, 0, True), cell(F.lit("Svar"), 0, 1, True), cell(F.lit("svar"), 0, 2, True))
    head = F.array(cell(F.lit("Krav"), 0, 0, True), cell(F.lit("Svar"), 0, 1, True), cell(F.lit("Svar"), 0, 2, True))
    json = rows.groupBy(F.col("l_orderkey").alias("table_id")).agg(F.to_json(F.struct(F.concat(head, F.flatten(F.collect_list(body))).alias("table_cells"))).alias("json"))
    return S.table_rows(json, "table_id", "json")


@query("select event_id, user_id as a, event_type as b from events union all select event_id, user_id + 1, null from events")
def json_recordset(spark, d):
    json = F.concat(F.lit('[{"a":'), F.col("user_id").cast("string"), F.lit(',"b":"'), F.col("event_type"), F.lit('"},{"a":'), (F.col("user_id") + 1).cast("string"), F.lit(',"x":1}]'))
    return S.recordset(table(spark, d, "events").select("event_id", json.alias("json")), "event_id", "json", "a:bigint,b:string")


@query(
    """with changes as (select c_custkey + 5 as k, 'new' as v from customer where c_custkey % 7 = 0), gone as (select c_custkey as k from customer where c_custkey % 11 = 0), base as (select c_custkey as k, c_name as v from customer),
    u as (select * from base where k not in (select k from changes) union all select * from changes), i as (select * from base union all select * from changes where k not in (select k from base))
    select 'upsert' as op, * from u union all select 'insert', * from i union all select 'delete', * from base where k not in (select k from gone)"""
)
def snapshot_changes(spark, d):
    base = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("v"))
    changes = base.where("k % 7 = 0").select((F.col("k") + 5).alias("k"), F.lit("new").alias("v"))
    parts = {"upsert": S.upserted(base, changes, ["k"]), "insert": S.upserted(base, changes, ["k"], update=False), "delete": S.deleted(base, base.where("k % 11 = 0"), ["k"])}
    found = [df.select(F.lit(op).alias("op"), "k", "v") for op, df in parts.items()]
    return found[0].unionByName(found[1]).unionByName(found[2])


@query("select p_partkey, '| ' || replace(p_name || ' |x', '|', '\\|') || ' | ' || p_size || ' |' as line from part")
def report_lines(spark, d):
    rows = table(spark, d, "part").select("p_partkey", F.concat("p_name", F.lit(" |x")).alias("name"), "p_size")
    return S.report_lines(rows, ["name", "p_size"]).select("p_partkey", "line")


@query()
def evidence_segments(spark, d):
    split = F.pandas_udf(S.evidence_segments, "array<string>")
    return table(spark, d, "documents").select("doc_id", F.posexplode(split("text")).alias("segment_no", "segment"))
