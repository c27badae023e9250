"""Ledgers against their keys, their sources and themselves. The SQL follows each rule step by step, row after row."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import alignment as A
from lodestone.operators import similar as S
from lodestone.plans.registry import fixture, query
from lodestone.sources.tables import table

#: Each row in turn: the nearest free entry that fits, the lower of two. ``p`` is the fit of entry e.
_TURN = "list_sort([{{'gap': abs(e.entry - r.row), 'entry': e.entry}} for e in free if {fit}])[1].entry"

ALIGN = rf"""with recursive same as (
  select r.doc_id, r.row, e.entry from gold_rows r join gold_entries e on r.doc_id = e.doc_id and r.row = e.entry and coalesce(r.text, '') = coalesce(e.text, '')
), r1 as (
  select doc_id, row, text from gold_rows anti join same using (doc_id, row) where text <> ''
), e1 as (
  select doc_id, entry, text from gold_entries anti join same using (doc_id, entry) where text <> ''
), q2 as (
  select r.doc_id, r.text, r.row, row_number() over (partition by r.doc_id, r.text order by r.row) as n from r1 r
), f2 as (
  select doc_id, text, list({{'entry': entry}} order by entry) as free from e1 group by doc_id, text
), w2 as (
  select f.doc_id, f.text, 0::bigint as n, free, null::int as row, null::int as entry from f2 f
  union all
  select w.doc_id, w.text, r.n, [x for x in free if x.entry is distinct from t], r.row, t from (select w.*, q.row as qrow, q.n as qn from w2 w join q2 q on q.doc_id = w.doc_id and q.text = w.text and q.n = w.n + 1) w
    join q2 r on r.doc_id = w.doc_id and r.text = w.text and r.n = w.qn, lateral (select {_TURN.format(fit="true")} as t)
), m2 as (
  select doc_id, row, entry from w2 where entry is not null
), r3 as (
  select doc_id, row, text, row_number() over (partition by doc_id order by row) as n from r1 anti join m2 using (doc_id, row) where length(text) >= 48
), f3 as (
  select doc_id, list({{'entry': entry, 'text': text}} order by entry) as free from e1 anti join m2 using (doc_id, entry) group by doc_id
), w3 as (
  select doc_id, 0::bigint as n, free, null::int as row, null::int as entry from f3
  union all
  select w.doc_id, r.n, [x for x in free if x.entry is distinct from t], r.row, t from w3 w join r3 r on r.doc_id = w.doc_id and r.n = w.n + 1, lateral (select {_TURN.format(fit="contains(e.text, r.text) or contains(r.text, e.text)")} as t)
), every as (
  select *, 'ordered' as kind from same union all select *, 'unordered' from m2 union all select doc_id, row, entry, 'fuzzy' from w3 where entry is not null
)
select doc_id, row, entry, kind from gold_rows left join every using (doc_id, row)"""


@query(ALIGN, ("gold_rows", "gold_entries"))
def ledger_alignment(spark, d):
    """Every row of the key with the entry that it is matched with, in three passes."""
    return A.align(fixture(spark, d, "gold_rows"), fixture(spark, d, "gold_entries"), "doc_id")[0]


@query(
    r"""with recursive l as (
      select doc_id, regexp_replace(lower(trim(regexp_replace(regexp_replace(text, '[‐‑‒–—]', '-', 'g'), '\s+', ' ', 'g'))), '^$', '') as t, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as n from documents
    ), v as (
      select doc_id, t, n, lower(trim(regexp_replace(regexp_replace(line || case when n % 3 = 0 then ' med tillegg' else '' end, '[‐‑‒–—]', '-', 'g'), '\s+', ' ', 'g'))) as needle from l
    ), k as (
      select *, array_to_string(string_split(needle, ' ')[1:12], ' ') as lead from v
    ), w as (
      select doc_id, t, 0::bigint as n, 0::bigint as cursor, null::bigint as spot from (select distinct doc_id, t from k)
      union all
      select w.doc_id, w.t, k.n, coalesce(p + length(k.needle), w.cursor), p from w join k on k.doc_id = w.doc_id and k.n = w.n + 1, lateral (
        select coalesce(case when k.needle <> '' then nullif(strpos(substr(w.t, w.cursor + 1), k.needle), 0) end, case when length(k.lead) >= 24 then nullif(strpos(substr(w.t, w.cursor + 1), k.lead), 0) end) - 1 + w.cursor as p)
    ) select doc_id, n as line_no, spot from w where n > 0"""
)
def source_places(spark, d):
    """Where each line of a document, every third of them with words added, stands in it, searched from behind the one before."""
    docs = table(spark, d, "documents").where("text is not null")
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.when(i % 3 == 2, F.concat(x, F.lit(" med tillegg"))).otherwise(x))
    return docs.select("doc_id", F.posexplode(A.source_offsets(F.col("text"), lines)).alias("n", "spot")).select("doc_id", (F.col("n") + 1).alias("line_no"), "spot")


UNIQUE = r"""with recursive t as (
  select list_id, item, trim(regexp_replace(lower(trim(regexp_replace(text, '\s+', ' ', 'g'))), '[`*#>_\[\](){},.:;!?''"“”‘’/\\|-]', ' ', 'g')) as k from list_items where trim(regexp_replace(text, '\s+', ' ', 'g')) <> ''
), k as (
  select list_id, item, trim(regexp_replace(k, '\s+', ' ', 'g')) as key from t
), x as (
  select list_id, item, key, list_distinct(list_filter(string_split(key, ' '), lambda w: length(w) > 2 or regexp_matches(w, '[0-9]'))) as tokens,
    list_filter(string_split(key, ' '), lambda w: regexp_matches(w, '[0-9]') or w in ('ikke', 'dager')) as sensitive, row_number() over (partition by list_id order by item) as n from k
), w as (
  select list_id, 0::bigint as n, [{'key': '', 'tokens': ['x'], 'sensitive': ['x']}][:0] as kept, null::bigint as item, false as stays from (select distinct list_id from x)
  union all
  select w.list_id, x.n, case when fits then w.kept else list_append(w.kept, {'key': x.key, 'tokens': x.tokens, 'sensitive': x.sensitive}) end, x.item, not fits
  from w join x on x.list_id = w.list_id and x.n = w.n + 1, lateral (
    select x.key <> '' and len([1 for o in w.kept if o.key = x.key or (o.key <> '' and o.sensitive = x.sensitive and len(x.tokens) > 0 and len(o.tokens) > 0 and len(list_intersect(o.tokens, x.tokens)) / least(len(o.tokens), len(x.tokens)) >= 0.72::double)]) > 0 as fits)
) select list_id, item from w where stays"""


@query(UNIQUE, ("list_items",))
def unique_list_items(spark, d):
    """The items of every list that say nothing an earlier one, itself kept, has said."""
    return S.kept_items(fixture(spark, d, "list_items"), ["list_id"], "item", "text")
