"""Document queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import documents as D
from lodestone.plans.registry import query
from lodestone.sources.tables import table

LINES = r"""ls as (select doc_id, n as line_no, trim(regexp_replace(l, '\s+', ' ', 'g')) as line from (select doc_id, unnest(range(1, len(x) + 1)) as n, unnest(x) as l from (select doc_id, string_split(text, chr(10)) as x from documents)) where trim(regexp_replace(l, '\s+', ' ', 'g')) <> '')"""
HEADING = r"""(length(line) between 4 and 140 and (regexp_matches(line, '(?i)^(kapittel|chapter|section|del|vedlegg|appendix)[^\p{L}\p{N}_]') or regexp_matches(line, '^[0-9]{1,3}(\.[0-9]{1,3})*\s+\S+') or regexp_matches(line, '^[A-ZÆØÅ][A-ZÆØÅ0-9\s:()/.+-]{7,}$')))"""


def _word(column: str, alternatives: str) -> str:
    return rf"regexp_matches(lower({column}), '(^|[^\p{{L}}\p{{N}}_])(?:{alternatives})($|[^\p{{L}}\p{{N}}_])')"


_ANY = " or ".join(_word("line", w) for _, w in D.EVIDENCE)
KINDS = " union all ".join(f"select doc_id, line_no, line, '{k}' as kind from ls where {_word('line', w)}" for k, w in D.EVIDENCE) + f" union all select doc_id, line_no, line, 'table' from ls where contains(line, ' | ') and not ({_ANY})"
EVIDENCE = f"with {LINES}, k as ({KINDS}), e as (select doc_id, kind, 'ev_' || substr(sha256(kind || chr(10) || lower(line) || chr(10) || doc_id), 1, 16) as evidence_id, min(line_no) as line_no from k where length(line) >= 12 group by 1, 2, 3)"
PRIORITY = "case kind " + " ".join(f"when '{k}' then {v}" for k, v in D.PRIORITY.items()) + " end"


@query(
    rf"""with {LINES}, m as (select doc_id, {HEADING} as h, contains(line, ' | ') as t, {_word("line", D.EVIDENCE[-1][1])} as r, regexp_matches(line, '\.{{4,}}\s*[0-9]{{1,4}}\s*$') as c from ls),
    g as (select doc_id, count(*) as n_lines, count(*) filter (where h) as headings, count(*) filter (where t) as table_lines, count(*) filter (where r) as requirements, count(*) filter (where c) as contents from m group by 1)
    select *, round(least(1.0, 0.2 + 0.2 * (headings > 0)::int + 0.2 * (table_lines > 0)::int + 0.3 * (requirements > 0)::int + 0.1 * (contents > 0)::int), 2)::double as confidence from g"""
)
def document_ledger(spark, d):
    return D.ledger(table(spark, d, "documents"))


@query(rf"with {LINES} select doc_id, line_no, last_value(case when {HEADING} then line end ignore nulls) over (partition by doc_id order by line_no rows unbounded preceding) as heading from ls")
def heading_carry_forward(spark, d):
    return D.with_heading(D.lines(table(spark, d, "documents"))).select("doc_id", "line_no", "heading")


@query(
    r"""with p as (select conv_id, turn, n, l from (select conv_id, turn, unnest(range(1, len(x) + 1)) as n, unnest(x) as l from (select conv_id, turn, string_split(text, chr(10)) as x from conversations))),
    q as (select *, row_number() over (partition by conv_id, turn order by n) as t, row_number() over (partition by conv_id, turn order by n desc) as b, lower(trim(regexp_replace(l, '[0-9]+', '#', 'g'))) as key from p),
    m as (select conv_id, key from q where t <= 2 or b <= 2 group by 1, 2 having count(distinct turn) >= greatest(3, (select ceil(count(distinct turn) * 0.6) from p where p.conv_id = q.conv_id)))
    select conv_id, turn, count(*) as lines_left from q where not exists (select 1 from m where m.conv_id = q.conv_id and m.key = q.key) group by 1, 2"""
)
def header_footer_removal(spark, d):
    pages = table(spark, d, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", "\n")).alias("n", "l"))
    return D.without_margins(pages, "conv_id", "turn", "n", "l").groupBy("conv_id", "turn").agg(F.count("*").alias("lines_left"))


@query()
def chunk_documents(spark, d):
    return D.chunks(table(spark, d, "documents")).select("doc_id", "chunk_index", "offset", "kind", "content_hash", F.length("chunk").alias("chars"))


_PLACE = "case doc_id % 5 when 0 then 'Bilag 2, tabell 3, rad 4' when 1 then 'Svar fra leverandør' when 2 then concat('Bilag side ', doc_id % 40) else 'Innledning' end"
_KIND = "case " + " ".join(
    f"when {t} then '{k}'"
    for k, t in [
        ("spreadsheet_rows", "doc_id % 17 = 0"),
        *((k, _word("t", D.KIND_WORDS[k])) for k in ("evaluation_criteria", "risk", "commercial_term", "architecture_signal")),
        ("answer_cell", "req and " + _word("p", "svar|answer|besvarelse|response")),
        ("requirement_row", "req and (" + _word("p", "tabell|table|rad|row") + " or contains(t, ' | '))"),
        ("requirement", "req"),
        ("table", "contains(t, ' | ') or " + _word("t", D.KIND_WORDS["table"])),
        ("page", r"regexp_matches(lower(p), '(^|[^a-z0-9_])side\s+\d+')"),
        ("section", "head"),
    ]
) + " else 'paragraph' end"


@query(
    rf"""with t as (select doc_id, substr(text, 1, 300) as t, {_PLACE} as p from documents), l as (select *, list_filter(string_split(t, chr(10)), lambda x: trim(x) <> '')[1] as line from t),
    r as (select *, {_word("t", D.KIND_WORDS["requirement"])} or regexp_matches(t, '\b[A-Z]{{1,8}}-?\d{{1,5}}(?:\.\d+)*\b') as req, coalesce({HEADING}, false) as head from l) select doc_id, {_KIND} as kind from r"""
)
def chunk_kinds(spark, d):
    """The kind of each document's beginning, as a chunk of a named place in a file of some format."""
    kind = D.chunk_kind(F.col("t"), F.col("p"), F.expr("case when doc_id % 17 = 0 then 'xlsx' else 'pdf' end"))
    return table(spark, d, "documents").select("doc_id", F.substring("text", 1, 300).alias("t"), F.expr(_PLACE).alias("p")).select("doc_id", kind.alias("kind"))


@query(EVIDENCE + " select doc_id, kind, line_no, evidence_id from e")
def evidence_units(spark, d):
    return D.evidence(table(spark, d, "documents")).select("doc_id", "kind", "line_no", "evidence_id")


@query(
    EVIDENCE
    + f""", p as (select *, {PRIORITY} as p from e), kk as (select *, row_number() over (partition by doc_id, kind order by p desc, line_no, evidence_id) <= 2 as k from p),
    g as (select *, count(*) filter (k) over (partition by doc_id) as reserved, row_number() over (partition by doc_id, k order by p desc, line_no, evidence_id) as g from kk)
    select doc_id, kind, line_no, evidence_id from g where k or g <= 5 - reserved"""
)
def evidence_selected(spark, d):
    rows = D.evidence(table(spark, d, "documents"))
    return D.select_evidence(rows, reserve=2, limit=5).select("doc_id", "kind", "line_no", "evidence_id")


@query(EVIDENCE + " select kind, count(*) as n, count(distinct doc_id) as documents from e group by 1")
def evidence_counts(spark, d):
    return D.evidence(table(spark, d, "documents")).groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("documents"))


@query(
    r"""with r as (select doc_id, unnest(range(0, len(x))) as n, unnest(x) as line from (select doc_id, string_split(text, chr(10)) as x from documents)), b as (select *, contains(line, '|') as bar from r),
    g as (select *, sum((bar and not coalesce(prev, false))::int) over (partition by doc_id order by n) as table_no from (select *, lag(bar) over (partition by doc_id order by n) as prev from b))
    select doc_id, table_no, row_number() over (partition by doc_id, table_no order by n) as row_no, len(string_split(regexp_replace(trim(line, ' '), '^\||\|$', '', 'g'), '|')) as n_cells from g where bar"""
)
def markup_tables(spark, d):
    return D.tables(table(spark, d, "documents")).select("doc_id", "table_no", "row_no", F.size("cells").alias("n_cells"))


@query(
    r"""with s as (select doc_id, n_chars, len(regexp_extract_all(text, '[A-Za-z]')) as letters, contains(text, ' | ') as has_table, (case when contains(text, '  ') then 1 else 0 end) + (case when regexp_matches(text, '[#*$%&]{3}') then 1 else 0 end) as anomalies from documents),
    q as (select doc_id, round(greatest(0.0, least(1.0, 0.42 * least(1.0, n_chars / 1000.0) + 0.38 * case when n_chars > 0 then letters / n_chars::double else 0 end + 0.2 * (case when has_table then 1 else 0 end) - least(0.28, 0.055 * anomalies))), 3) as quality from s)
    select doc_id, quality, case when quality < 0.35 then 'ocr' when quality < 0.58 then 'layout' when quality < 0.76 then 'structure' else 'accept' end as route from q"""
)
def parser_routing(spark, d):
    docs = table(spark, d, "documents")
    n = F.col("n_chars")
    letters = F.regexp_count("text", F.lit("[A-Za-z]"))
    anomalies = F.col("text").contains("  ").cast("int") + F.col("text").rlike("[#*$%&]{3}").cast("int")
    quality = D.parse_quality(F.least(F.lit(1.0), n / 1000.0), F.when(n > 0, letters / n).otherwise(0.0), F.col("text").contains(" | ").cast("int"), anomalies)
    return docs.select("doc_id", quality.alias("quality"), D.route(quality).alias("route"))


@query(
    r"""select page_id, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]*)', 1)) as host, case when regexp_extract(lower(url), '\.([a-z]+)$', 1) in ('pdf','docx','txt','md','xlsx','xls') then regexp_extract(lower(url), '\.([a-z]+)$', 1) when regexp_matches(html, '(?i)^\s*<!doctype html|^\s*<html') then 'html' else 'unknown' end as format from pages"""
)
def format_inference(spark, d):
    extension = F.regexp_extract(F.lower("url"), r"\.([a-z]+)$", 1)
    kind = F.when(extension.isin("pdf", "docx", "txt", "md", "xlsx", "xls"), extension).when(F.col("html").rlike(r"(?i)^\s*<!doctype html|^\s*<html"), "html").otherwise("unknown")
    return table(spark, d, "pages").select("page_id", F.lower(F.regexp_extract("url", "^[A-Za-z]+://([^/?#:]*)", 1)).alias("host"), kind.alias("format"))


@query("select doc_id, source, total_chars, share_chars, least(n_chars, share_chars) as given, n_chars > share_chars as truncated from (select doc_id, source, n_chars, sum(n_chars) over (partition by source) as total_chars, cast(least(4000, floor(160000 / count(*) over (partition by source))) as bigint) as share_chars from documents)")
def context_budget(spark, d):
    """Each supporting document's share of its group's budget; group totals are aggregated first, then joined."""
    docs = table(spark, d, "documents").select("doc_id", "source", "n_chars")
    groups = docs.groupBy("source").agg(F.sum("n_chars").alias("total_chars"), F.least(F.lit(4000), F.floor(F.lit(160000) / F.count("*"))).cast("long").alias("share_chars"))
    joined = docs.join(groups, "source")
    return joined.select("doc_id", "source", "total_chars", "share_chars", F.least("n_chars", "share_chars").alias("given"), (F.col("n_chars") > F.col("share_chars")).alias("truncated"))


@query("select d.doc_id, l.doc_id is not null as reused, coalesce(l.quality, -1) as quality from documents d left join labels l on l.doc_id = d.doc_id")
def incremental_recompute(spark, d):
    """Stored contexts are reused where there is one; only the rest is computed."""
    docs, stored = table(spark, d, "documents").select("doc_id"), table(spark, d, "labels").select("doc_id", "quality")
    fresh = docs.join(stored, "doc_id").select("doc_id", F.lit(True).alias("reused"), "quality")
    return fresh.unionByName(docs.join(stored, "doc_id", "left_anti").select("doc_id", F.lit(False).alias("reused"), F.lit(-1).alias("quality")))
