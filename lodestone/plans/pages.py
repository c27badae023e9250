"""Pages, lines, headings and the language of marked and scanned texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from lodestone.functions import language as L
from lodestone.operators import documents as D
from lodestone.operators import pages as P
from lodestone.plans.documents import HEADING, LINES
from lodestone.plans.registry import fixture, query
from lodestone.sources.tables import table

MARK = r"\[\[SIDE:([0-9]{1,5})(?:-([0-9]{1,5}))?\]\]"
#: Every marker with its pages and where it begins, and the text up to the next.
MARKS = rf"""split as (select doc_id, raw, regexp_extract_all(raw, '{MARK}') as ms, string_split_regex(raw, '{MARK}') as ps from paged),
  marks as (select doc_id, raw, ms, ps, unnest(range(1, len(ms) + 1)) as n from split),
  placed as (select doc_id, n, regexp_extract(ms[n], '{MARK}', 1)::int as page, greatest(regexp_extract(ms[n], '{MARK}', 1)::int, coalesce(nullif(regexp_extract(ms[n], '{MARK}', 2), ''), '0')::int) as page_end,
    length(array_to_string(ps[1:n], '')) + length(array_to_string(ms[1:n - 1], '')) as spot, ps[n + 1] as text from marks)"""


def _rx(p: str, r: str, x: str) -> str:
    java = r.replace("$", "\\")
    return f"regexp_replace({x}, '{L.pattern(p, chr(92) + 'b')}', '{java}', 'g')"


def _like(p: str, x: str = "text", flags: str = "(?i)") -> str:
    return f"regexp_matches({x}, '{flags}{L.pattern(p, chr(92) + 'b')}')"


_FOOT = " or ".join(f"regexp_matches(trim(regexp_replace(l, '\\s+', ' ', 'g')), '{p}')" for p in L.FOOTERS)
BODY = _rx(r"\s+", " ", _rx("(?i)BKonfidensiellB", " ", _rx(r"(?i)BSide\s*\d+\s*av\s*\d+B", " ", _rx("[‐‑‒–—]", "-", f"array_to_string(list_filter(string_split(text, chr(10)), lambda l: not ({_FOOT})), chr(10))"))))
CANONICAL = f"trim(({reduce(lambda x, r: _rx(r[0], r[1], x), L.REPAIRS, reduce(lambda x, m: f'replace({x}, {m[0]!r}, {m[1]!r})', L.MOJIBAKE, 'text'))}), ' ')"


def _odd(a: str, b: str) -> str:
    n = [f"(length(text) - length(replace(text, '{c}', '')))" for c in (a, b)]
    return f"{n[0]} <> {n[1]}" if a != b else f"{n[0]} % 2 <> 0"


CODES = [
    ("mojibake", "regexp_matches(text, 'Ã[¦¸¥†˜…]')"), ("replacement_character", "contains(text, '�')"), ("soft_hyphen", "regexp_matches(text, '[­​﻿]')"),
    ("split_word", _like(L.SPLIT_WORDS)), ("joined_party_word", _like(L.JOINED_WORDS)), ("spaced_requirement_id", _like(L.SPACED_ID)),
    ("space_before_punctuation", r"regexp_matches(text, '\s+[,.;:!?]')"), ("missing_space_after_punctuation", r"regexp_matches(text, '[;!?][\p{L}\p{N}]|[:,]\p{L}|\.\p{Lu}')"),
    ("unbalanced_brackets", f"({_odd('(', ')')} or {_odd('[', ']')})"), ("unbalanced_quotes", f"({_odd('«', '»')} or {_odd(chr(34), chr(34))})"),
    ("lowercase_sentence_start", r"regexp_matches(text, '^\s*\p{Ll}')"), ("missing_terminal_punctuation", r"(regexp_matches(text, '[\p{L}\p{N})\]»]\s*$') and not regexp_matches(text, '[.:;!?]\s*$'))"),
]
DIAGNOSTICS = "list_filter([" + ", ".join(f"case when {test} then '{code}' end" for code, test in CODES) + "], lambda x: x is not null)"


@query(f"with {MARKS} select doc_id, n, page, page_end, spot from placed", ("paged",))
def page_markers(spark, d):
    found = fixture(spark, d, "paged").select("doc_id", F.posexplode(P.markers(F.col("raw"))).alias("n", "m"))
    return found.select("doc_id", (F.col("n") + 1).alias("n"), F.col("m.start").alias("page"), F.col("m.stop").alias("page_end"), F.col("m.offset").alias("spot"))


@query(f"with {MARKS}, b as (select *, trim({BODY}, ' ') as body from placed) select doc_id, page, page_end, length(text) as chars, md5(body) as body_md5 from b where body <> ''", ("paged",))
def page_split(spark, d):
    return P.split_pages(fixture(spark, d, "paged"), "doc_id", "raw").select("doc_id", "page", "page_end", F.length("text").alias("chars"), F.md5("body").alias("body_md5"))


@query(
    rf"""with {MARKS}, n as (select doc_id, unnest(list_transform(regexp_extract_all(title || chr(10) || raw, '(?i)\b(?:side|page)\s+(\d{{1,5}})\b', 1), lambda x: x::int)) as n from paged union all select doc_id, page from placed union all select doc_id, page_end from placed)
    select doc_id, min(n) as page_start, max(n) as page_end from n group by 1""",
    ("paged",),
)
def page_ranges(spark, d):
    return fixture(spark, d, "paged").select("doc_id", P.page_range(F.col("title"), F.col("raw")).alias("r")).select("doc_id", "r.*")


@query(
    rf"""with recursive {LINES}, h as (select doc_id, line_no, line, row_number() over (partition by doc_id order by line_no) as n, regexp_extract(line, '^(\d{{1,3}}(?:\.\d{{1,3}})*)\s+', 1) as number from ls where {HEADING}),
    r as (select doc_id, 0::bigint as n, []::varchar[] as path from (select distinct doc_id from h)
      union all select h.doc_id, h.n, case when number = '' then [line] else list_slice(list_append(list_slice(path, 1, len(string_split(number, '.')) - 1), line), -6, 6) end from r join h on h.doc_id = r.doc_id and h.n = r.n + 1)
    select h.doc_id, h.line_no, array_to_string(path, ' > ') as path from r join h on h.doc_id = r.doc_id and h.n = r.n"""
)
def heading_path(spark, d):
    rows = D.lines(table(spark, d, "documents")).withColumn("heading", F.when(D.is_heading(F.col("line")), F.col("line")))
    found = P.heading_paths(rows, "doc_id", "line_no", "heading").where("heading is not null")
    return found.select("doc_id", "line_no", F.array_join("path", " > ").alias("path"))


@query(
    rf"""with {LINES}, x as (select *, regexp_matches(line, '^[0-9]+[a-z]?$|^[A-Z]{{2,}}') as is_id, lower(line) in ('krav', 'type') as header, regexp_matches(line, '(?i)tion|ent') as req, regexp_matches(line, '(?i)^(mandatory|optional|required|yes|no|m|o)$') as answer from ls),
    w as (select a.doc_id, a.line_no, a.line as reference, b.line, b.is_id or b.answer as ends, b.req, row_number() over (partition by a.doc_id, a.line_no order by b.line_no) as k from
      (select *, row_number() over (partition by doc_id order by line_no) as i from x) a join (select *, row_number() over (partition by doc_id order by line_no) as i from x) b on a.doc_id = b.doc_id and b.i between a.i + 1 and a.i + 9 where a.is_id and not b.header),
    s as (select *, sum(length(line) + 1) over (partition by doc_id, line_no order by k) - 1 as upto from w),
    t as (select *, coalesce(max(case when ends or req or upto > 120 then 1 else 0 end) over (partition by doc_id, line_no order by k rows between unbounded preceding and 1 preceding), 0) as done from s),
    u as (select doc_id, line_no, reference, string_agg(line, ' ' order by k) as text from t where done = 0 and not ends group by 1, 2, 3)
    select doc_id, line_no, reference, text from u where length(text) >= 12 and regexp_matches(text, '(?i)tion|ent')"""
)
def table_requirements(spark, d):
    """Requirements under lines that look like ids; the words that make one are stand-ins that the invented prose has."""
    rows = D.lines(table(spark, d, "documents"))
    return P.table_requirements(rows, "doc_id", "line_no", "line", F.col("line").rlike("^[0-9]+[a-z]?$|^[A-Z]{2,}"), "(?i)tion|ent", ["krav", "type"])


@query(
    f"""with {LINES}, w as (select *, lead(line, 1) over (partition by doc_id order by line_no) as b, lead(line, 2) over (partition by doc_id order by line_no) as c from ls), r as (
      select doc_id, 1 as span, line as text from w union all select doc_id, 2, line || ' ' || b from w where b is not null union all select doc_id, 3, line || ' ' || b || ' ' || c from w where c is not null)
    select doc_id, span, count(*) as runs, max(length(text)) as longest from r group by 1, 2"""
)
def line_windows(spark, d):
    runs = P.line_runs(D.lines(table(spark, d, "documents")), "doc_id", "line_no", "line")
    return runs.groupBy("doc_id", "span").agg(F.count("*").alias("runs"), F.max(F.length("text")).alias("longest"))


@query(
    """with i as (select *, row_number() over (partition by doc_id order by line_no) as i from numbered_lines), a as (select *, max(case when place is not null then i end) over (partition by doc_id order by i) as back, min(case when place is not null then i end) over (partition by doc_id order by i rows between current row and unbounded following) as ahead from i)
    select a.doc_id, a.line_no, case when a.place is null and b.prefix = c.prefix and c.place - b.place = c.i - b.i then b.prefix || (b.place + a.i - b.i) end as inferred
    from a left join i b on b.doc_id = a.doc_id and b.i = a.back left join i c on c.doc_id = a.doc_id and c.i = a.ahead""",
    ("numbered_lines",),
)
def gap_filled_ids(spark, d):
    return P.gap_filled(fixture(spark, d, "numbered_lines"), ["doc_id"], "line_no", "place", "prefix").select("doc_id", "line_no", "inferred")


@query(
    """with recursive i as (select *, row_number() over (partition by doc_id, kind order by line_no) as i from numbered_lines),
    r as (select doc_id, kind, i, line_no, number, coalesce(number, 1) as top from i where i = 1 union all select i.doc_id, i.kind, i.i, i.line_no, i.number, case when i.number is null then r.top + 1 else greatest(r.top, i.number) end from r join i on i.doc_id = r.doc_id and i.kind = r.kind and i.i = r.i + 1)
    select doc_id, line_no, kind, coalesce(number, top) as assigned from r""",
    ("numbered_lines",),
)
def fallback_numbers(spark, d):
    return P.numbered(fixture(spark, d, "numbered_lines"), ["doc_id"], "line_no", "kind", "number").select("doc_id", "line_no", "kind", "assigned")


@query(
    r"""select item_id, md5(regexp_replace(regexp_replace(array_to_string(list_transform(string_split(regexp_replace(regexp_replace('Tittel' || chr(10) || 'fil-' || item_id || '.pdf' || chr(10) || chr(10) || 'rfp' || chr(10) || 'table' || chr(10) || 'side 3' || chr(10) || 'A B' || chr(10) || text, '[‐‑‒–—]', '-', 'g'), '[ \t]+', ' ', 'g'), chr(10)), lambda l: trim(l)), chr(10)), '\n{4,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) as search_md5 from benchmark"""
)
def chunk_search_text(spark, d):
    parts = [F.lit("Tittel"), F.concat(F.lit("fil-"), F.col("item_id").cast("string"), F.lit(".pdf")), F.lit(None).cast("string"), F.lit("rfp"), F.lit("table"), F.lit("side 3"), F.lit("A B"), F.col("text")]
    return table(spark, d, "benchmark").select("item_id", F.md5(P.search_text(parts)).alias("search_md5"))


@query(f"select doc_id, array_to_string({DIAGNOSTICS}, ',') as codes from scanned", ("scanned",))
def language_diagnostics(spark, d):
    return fixture(spark, d, "scanned").select("doc_id", F.array_join(L.diagnostics(F.col("text"), sentence=True), ",").alias("codes"))


@query(
    rf"""with c as (select doc_id, {CANONICAL} as c from scanned), u as (select doc_id, c, case when regexp_matches(c, '^\p{{Ll}}') then upper(substr(c, 1, 1)) || substr(c, 2) else c end as s from c)
    select doc_id, md5(case when regexp_matches(s, '[\p{{L}}\p{{N}})\]»]$') and not regexp_matches(s, '[.:;!?]$') then s || '.' else s end) as canonical_md5, md5(regexp_replace(c, '[‐‑‒–—]', '-', 'g')) as search_md5 from u""",
    ("scanned",),
)
def canonical_text(spark, d):
    text = F.col("text")
    return fixture(spark, d, "scanned").select("doc_id", F.md5(L.canonical(text, sentence=True)).alias("canonical_md5"), F.md5(L.for_search(text)).alias("search_md5"))


@query(
    f"""select doc_id, array_to_string(list_concat(list_filter({DIAGNOSTICS}, lambda x: x in ('mojibake', 'replacement_character', 'split_word', 'joined_party_word', 'spaced_requirement_id')),
      case when len(regexp_extract_all(regexp_replace({CANONICAL}, '[‐‑‒–—]', '-', 'g'), '(?i){L.pattern(L.REQUIREMENT_ID, chr(92) + "b")}')) >= 4 and not has_tables then ['unstructured_requirement_table'] else [] end), ',') as codes from scanned""",
    ("scanned",),
)
def parse_anomalies(spark, d):
    return fixture(spark, d, "scanned").select("doc_id", F.array_join(L.anomalies(F.col("text"), F.col("has_tables")), ",").alias("codes"))


_IDS = r"(case p_partkey % 6 when 0 then 'krav nr. ' || p_size || ' . 2' when 1 then 'id' || p_size || ' - 4a' when 2 then 'req - ' || p_size when 3 then 'fun – a ' || p_size when 4 then 'Krav' || p_size else p_brand end)"


@query(
    rf"""with v as (select p_partkey, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({_IDS}, '[‐‑‒–—]', '-', 'g'), '\s+', ' ', 'g'), '\s*-\s*', '-', 'g'), '\s*\.\s*', '.', 'g')) as v from part),
    w as (select p_partkey, regexp_replace(regexp_replace(regexp_replace(v, '(?i)^krav\s*(?:nr\.?|nummer)?\s*', 'Krav '), '(?i)^id\s*', 'ID '), '(?i)^req\s*[- ]?\s*', 'REQ-') as v from v)
    select p_partkey, case when regexp_matches(v, '^(Krav|ID) ') then v else upper(v) end as id from w"""
)
def normalized_ids(spark, d):
    value = F.expr(_IDS.replace(r"\s", r"\\s"))
    return table(spark, d, "part").select("p_partkey", L.normalized_requirement_id(value).alias("id"))
