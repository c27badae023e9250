"""DuckDB counterparts of the queries that SQL can express."""

from __future__ import annotations

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
FOLDED = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+')"

PREFERENCES = """
with last as (
  select conv_id, max(turn) as turn, arg_max(text, (turn, coalesce(text, ''))) as text from conversations where role = 'assistant' group by conv_id
), t as (
  select conv_id as pair_id, 0 as side, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all
  select c.conv_id, 1, c.turn, coalesce(c.role, ''), coalesce(case when c.role = 'assistant' and c.turn = l.turn then coalesce(n.text, c.text) else c.text end, '')
  from conversations c left join last l on l.conv_id = c.conv_id left join last n on n.conv_id = c.conv_id + 1
), o as (
  select *, row_number() over (partition by pair_id, side order by turn nulls first, role, text) as i from t
), p as (
  select pair_id, count(*) filter (side = 0) as c, count(*) filter (side = 1) as r from o group by pair_id
), d as (
  select p.pair_id, c, r, coalesce(min(a.i) filter (a.role <> b.role or a.text <> b.text) - 1, least(c, r)) as k
  from p left join o a on a.pair_id = p.pair_id and a.side = 0 left join o b on b.pair_id = p.pair_id and b.side = 1 and b.i = a.i
  group by p.pair_id, c, r
), m as (
  select o.pair_id, side, i, c, r, k, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) as line,
    case when role = 'assistant' then length(text) + 11 else 0 end as trained
  from o join d on o.pair_id = d.pair_id
)
select pair_id, c as chosen_turns, r as rejected_turns, k as n_prefix,
  coalesce(string_agg(line, '' order by i) filter (side = 0 and i <= k), '') as prompt,
  case when c > 0 then coalesce(string_agg(line, '' order by i) filter (side = 0 and i > k), '') end as chosen,
  case when r > 0 then coalesce(string_agg(line, '' order by i) filter (side = 1 and i > k), '') end as rejected,
  coalesce(sum(trained) filter (side = 0 and i > k), 0)::bigint as chosen_trained,
  coalesce(sum(trained) filter (side = 1 and i > k), 0)::bigint as rejected_trained
from m group by pair_id, c, r, k
"""

QUALITY = rf"""
with w as (
  select doc_id, lang, source, {WORDS} as words, coalesce(text, '') as text,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines
  from documents
), windows as (
  select doc_id, i, array_to_string(words[i : i + 7], ' ') as span
  from (select doc_id, words, unnest(range(1, len(words) - 6)) as i from w where len(words) >= 8)
), twice as (
  select doc_id, i from (select *, count(*) over (partition by doc_id, span) as n from windows) where n > 1
), covered as (
  select doc_id, count(distinct j) as n from (select doc_id, unnest(range(i, i + 8)) as j from twice) group by doc_id
), m as (
  select doc_id, lang, source, len(words)::bigint as n_words, length(array_to_string(words, ''))::bigint as word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
    (len(lines) - list_unique(lines))::bigint as n_dup_lines, coalesce(n, 0)::bigint as n_repeat_words, len(lines) as n_lines
  from w left join covered using (doc_id)
), b as (
  select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from m
), r as (
  select doc_id, lang, source, base_failed, unnest([
    {{'measure': 'symbol_rate', 'v': n_symbols * 1000 // nullif(n_words, 0), 'least': 5, 'part': 40}},
    {{'measure': 'word_length', 'v': word_chars * 100 // nullif(n_words, 0), 'least': 10, 'part': 40}},
    {{'measure': 'line_rate', 'v': n_dup_lines * 1000 // nullif(n_lines, 0), 'least': 30, 'part': 3}},
    {{'measure': 'repeat_rate', 'v': n_repeat_words * 1000 // nullif(n_words, 0), 'least': 25, 'part': 2}}], recursive := true)
  from b
), k as (
  select lang, source, measure, least, part, case when v < 128 then v else v // (1 << (length(bin(v)) - 7)::bigint) * (1 << (length(bin(v)) - 7)::bigint) end as bucket
  from r where not base_failed
), q as (
  select grouping(source) as wide, grouping(lang) as wider, lang, source, measure, least, part, count(*) as n,
    quantile_disc(bucket, 0.25) as low, quantile_disc(bucket, 0.75) as high, quantile_disc(bucket, 0.99) as tail
  from k group by grouping sets ((lang, source, measure, least, part), (lang, measure, least, part), (measure, least, part))
), l as (
  select q.lang, q.measure, (q.n * q.low + 30 * e.low) // (q.n + 30) as low, (q.n * q.high + 30 * e.high) // (q.n + 30) as high, (q.n * q.tail + 30 * e.tail) // (q.n + 30) as tail
  from q join q e on e.wide = 1 and e.wider = 1 and q.measure = e.measure where q.wide = 1 and q.wider = 0
), f as (
  select a.lang, a.source, a.measure, a.least, a.part, (a.n * a.low + 30 * l.low) // (a.n + 30) as q1, (a.n * a.high + 30 * l.high) // (a.n + 30) as q3, (a.n * a.tail + 30 * l.tail) // (a.n + 30) as q99
  from q a join l on a.lang is not distinct from l.lang and a.measure = l.measure
  where a.wide = 0
), v as (
  select r.doc_id, bool_and(coalesce(r.v between q1 - 4 * greatest(q3 - q1, f.least, (q99 - q3) // f.part) and q3 + 4 * greatest(q3 - q1, f.least, (q99 - q3) // f.part), true)) as within
  from r left join f on r.lang is not distinct from f.lang and r.source is not distinct from f.source and r.measure = f.measure
  group by r.doc_id
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and within as kept from b join v using (doc_id)
"""

CONTAMINATION = f"""
with d as (
  select doc_id, {FOLDED} as words from documents
), b as (
  select item_id, words, unnest(range(1, greatest(1, len(words) - 9) + 1)) as i from (select item_id, {FOLDED} as words from benchmark) where len(words) > 0
), windows as (
  select item_id, array_to_string(words[i : i + 9], ' ') as span, least(len(words), 10) as n from b
), sizes as (
  select distinct n from windows
), spans as (
  select doc_id, n, i, array_to_string(words[i : i + n - 1], ' ') as span
  from (select doc_id, words, n, unnest(range(1, len(words) - n + 2)) as i from d, sizes where len(words) >= n)
), hits as (
  select doc_id, s.n, i, item_id from spans s join windows w on s.span = w.span and s.n = w.n
), covered as (
  select doc_id, count(distinct j) as n from (select doc_id, unnest(range(i, i + n)) as j from hits) group by doc_id
), found as (
  select doc_id, count(distinct item_id) as n_items, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) as items from hits group by doc_id
)
select doc_id, len(words)::bigint as n_words, coalesce(n, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(items, '')) as items_sha256, n is not null as contaminated
from d left join covered using (doc_id) left join found using (doc_id)
"""

WARC = """
with p as (
  select page_id, octet_length(encode(coalesce(html, '')))::bigint as payload_bytes, sha1(coalesce(html, '')) as hex, min(page_id) over (partition by coalesce(html, '')) as first from pages
)
select page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    ((('0x' || substr(hex, (k // 4 * 5 + 1)::int, 5))::bigint >> (15 - k % 4 * 5)) & 31)::int + 1, 1)), '') as payload_digest,
  case when first = page_id then 'response' else 'revisit' end as record_type,
  case when first <> page_id then first end as refers_to
from p
"""

COMPACTION = "select doc_id, lang, source, n_chars, sha256(text) as text_sha256, true as compacted from documents"

REPEATS = f"""
with d as (
  select doc_id, {WORDS} as words from documents
), windows as (
  select doc_id, i, array_to_string(words[i : i + 49], ' ') as span
  from (select doc_id, words, unnest(range(1, len(words) - 48)) as i from d where len(words) >= 50)
), later as (
  select doc_id, i from (select doc_id, i, min(doc_id) over (partition by span) as first from windows) where first < doc_id
), gone as (
  select distinct doc_id, unnest(range(i, i + 50)) as j from later
), placed as (
  select doc_id, unnest(words) as word, unnest(range(1, len(words) + 1)) as j from d
), marked as (
  select p.doc_id, p.j, p.word, g.j is not null as gone from placed p left join gone g on p.doc_id = g.doc_id and p.j = g.j
), summed as (
  select doc_id, count(*) filter (gone) as n, string_agg(word, ' ' order by j) filter (not gone) as kept from marked group by doc_id
)
select doc_id, len(words)::bigint as n_words, coalesce(n, 0)::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from d left join summed using (doc_id)
"""

LINES = r"""
with p as (
  select page_id, lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) as host,
    regexp_replace(regexp_replace(regexp_replace(html,
      '(?is)<script\b[^>]*>.*?</script>|<style\b[^>]*>.*?</style>|<!--.*?-->', '', 'g'),
      '(?i)</?(?:p|div|br|li|ul|ol|h[1-6]|nav|article|section|header|footer|title|table|tr|body|html|head|main|aside|blockquote|pre)\b[^>]*>', chr(10), 'g'),
      '<[^>]*>', '', 'g') as text
  from pages
), l as (
  select page_id, host, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i from p where text is not null
), bare as (
  select *, regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') as b from l
), often as (
  select host, b from bare where b <> '' group by host, b
  having count(distinct page_id) >= 2 and count(distinct page_id) > 0.1 * (select count(*) from p where p.host = bare.host)
), kept as (
  select page_id, count(*) as n_lines, count(often.b) as n_dropped, string_agg(line, chr(10) order by i) filter (often.b is null) as text
  from bare left join often on bare.host = often.host and bare.b = often.b group by page_id
)
select page_id, p.host, coalesce(n_lines, 0)::bigint as n_lines, coalesce(n_dropped, 0)::bigint as n_dropped, sha256(coalesce(kept.text, '')) as kept_sha256
from p left join kept using (page_id)
"""



def vector_codes_sql(rounds: int = 6) -> str:
    """Each round as two common table expressions; whole-number division is rounded down by taking the remainder off."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""
a{r} as materialized (
  select p.id, p.part, arg_min(c.entry, (d, c.entry)) as entry, min(d) as d
  from (select p.id, p.part, c.entry, list_sum([(x[1] - x[2]) * (x[1] - x[2]) for x in list_zip(p.v, c.v)])::bigint as d from parts p join b{r} c on p.part = c.part) c
  join parts p on p.id = c.id and p.part = c.part group by p.id, p.part
)""")
        if r < rounds:
            steps.append(f"""
m{r + 1} as (
  select part, entry, i, (sum(v[i]) - ((sum(v[i]) % count(*)) + count(*)) % count(*)) // count(*) as x
  from (select a.part, a.entry, p.v, unnest(range(1, len(p.v) + 1)) as i from a{r} a join parts p on a.id = p.id and a.part = p.part) group by part, entry, i
), b{r + 1} as materialized (
  select part, entry, coalesce(n.v, o.v) as v from b{r} o left join (select part, entry, list(x::bigint order by i) as v from m{r + 1} group by part, entry) n using (part, entry)
)""")
    return f"""
with kept as (
  select vec_id, label, [floor(4096 * x::double)::bigint for x in embedding] as v
  from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), numbered as (
  select *, row_number() over (order by vec_id) as id from kept
), parts as materialized (
  select id, part, v[part * len(v) // 8 + 1 : (part + 1) * len(v) // 8] as v from numbered, range(8) t(part)
), b0 as (
  select part, id - 1 as entry, v from parts where id <= 16
), {", ".join(x.strip() for x in steps)}, codes as (
  select id, string_agg(printf('%02x', entry), '' order by part) as code, sum(d)::bigint as error from a{rounds} group by id
), books as (
  select sha256(string_agg(array_to_string(v, ','), ',' order by part, entry)) as codebooks_sha256 from b{rounds}
)
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, codebooks_sha256 from codes join numbered using (id), books
"""


def importance_sql() -> str:
    """The CRC as a fold over the bytes of each feature, its table by eight shifts of each byte."""
    steps = ", ".join(f"s{k + 1} as (select i, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end as c from s{k})" for k in range(8))
    return f"""
with s0 as (select i, i as c from range(256) t(i)), {steps}, tab as (select list(c order by i) as t from s8
), texts as (
  select false as target, doc_id as id, {FOLDED} as w from documents union all select true, null, {FOLDED} from benchmark
), runs as (
  select target, id, array_to_string(w[i : i + n - 1], ' ') as f from (select target, id, w, n, unnest(range(1, len(w) - n + 2)) as i from texts, range(1, 4) t(n) where len(w) >= n)
), counted as (
  select target, id, f, count(*) as k from runs group by target, id, f
), hashed as materialized (
  select f, xor(list_reduce(list_prepend(4294967295::bigint, [('0x' || h[2 * j + 1 : 2 * j + 2])::bigint for j in range(len(h) // 2)]), lambda s, b: xor(t[(xor(s, b) & 255) + 1], s >> 8)), 4294967295) % 10000 as bucket
  from (select distinct f, hex(encode(f)) as h from counted), tab
), held as (
  select target, id, bucket, sum(k)::bigint as k from counted join hashed using (f) group by target, id, bucket
), totals as (
  select bucket, coalesce(sum(k) filter (not target), 0)::double as s, coalesce(sum(k) filter (target), 0)::double as t from range(10000) b(bucket) left join held using (bucket) group by bucket
), gains as (
  select bucket, floor(1000 * ln((t + 1) * ((select sum(s) from totals) + 10000) / ((s + 1) * ((select sum(t) from totals) + 10000))))::bigint as gain from totals
), weighed as (
  select id, sum(k)::bigint as n_features, sum(k * gain)::bigint as weight from held join gains using (bucket) where not target group by id
), scored as (
  select id as doc_id, len(w) >= 20 as fit, coalesce(n_features, 0)::bigint as n_features, coalesce(weight, 0)::bigint as weight,
    coalesce(weight, 0)::bigint + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || id), 1, 8))::bigint + 0.5::double) / 4294967296)))::bigint as score
  from texts left join weighed using (id) where not target
), placed as (
  select *, row_number() over (partition by fit order by score desc, doc_id) as r, 5 * count(*) over (partition by fit) // 100 as top from scored
)
select doc_id, n_features, weight, score, case when fit and r <= top then r end as rank from placed
"""


URLS = """
with u as (
  select page_id, case when contains(url, '://') then substr(url, strpos(url, '://') + 3) else '' end as rest from pages
), p as (
  select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from u
), r as (
  select * from (values ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')) v(h, b, verdict)
), fit as (
  select page_id, max_by(h || b, length(h || b)) as rule, max_by(verdict, length(h || b)) as verdict
  from p join r on (host = h or ends_with(host, '.' || h)) and starts_with(path, b) group by page_id
)
select p.page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from p left join fit using (page_id)
"""

ORACLES = {
    "op1_preferences": PREFERENCES,
    "op3_quality": QUALITY,
    "op6_decontaminate": CONTAMINATION,
    "op7_warc": WARC,
    "op8_compaction": COMPACTION,
    "op9_substrings": REPEATS,
    "op10_lines": LINES,
    "op11_vector_codes": vector_codes_sql(),
    "op12_importance": importance_sql(),
    "op13_url_filter": URLS,
}
