"""Claims grounded in documents. The SQL compares every claim with every passage of its project."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators.grounding import ground
from lodestone.plans.registry import fixture, query


def _key(x: str) -> str:
    return rf"""trim(regexp_replace(regexp_replace(lower({x}), '[`*#>_\[\](){{}},.:;!?''"“”‘’/\\|-]', ' ', 'g'), '\s+', ' ', 'g'))"""


def _flat(x: str) -> str:
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


def _bounded(x: str) -> str:
    at = rf"length(regexp_extract(substr({x}, 1, 501), '^(.*)\s\S*$', 1))"
    return f"case when length({x}) <= 500 then {x} else rtrim(substr({x}, 1, case when {at} >= 375 then {at} else 500 end)) end"


_SHORT, _MONTHS = r"f\.eks|dvs|bl\.a|m\.m|o\.l|kl|ca|nr", "januar|februar|mars|april|mai|juni|juli|august|september|oktober|november|desember"
_STOPS = "['alle', 'eller', 'etter', 'for', 'fra', 'har', 'ikke', 'kan', 'kunden', 'med', 'skal', 'som', 'til', 'ved']"
_TOKENS = "list_filter(string_split({k}, ' '), lambda w: (length(w) > 2 or regexp_matches(w, '[0-9]')) and not list_contains(" + _STOPS + ", w))[1:40]"
_REFERS = "({a} <> '' and {b} <> '' and (contains({a}, {b}) or contains({b}, {a})))"
GROUNDED = rf"""with ls as (
  select project, doc, title, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(trim(x), chr(13))), lambda x: x <> '') as l from claim_documents
), pieces as (
  select project, doc, title, title as reference, 1 as kind, i, 1 as n, l[i] as t, false as structured from ls, range(1, len(l) + 1) r(i)
  union all select project, doc, title, title, 2, i, 2, array_to_string(l[i : i + 1], ' '), false from ls, range(1, len(l)) r(i)
  union all select project, doc, title, title, 2, i, 3, array_to_string(l[i : i + 2], ' '), false from ls, range(1, len(l) - 1) r(i)
  union all select e.project, e.doc, d.title, coalesce(nullif(e.reference, ''), d.title), 0, e.entry, 1, e.text, true from claim_entries e join claim_documents d using (project, doc)
), marked as (
  select *, regexp_replace(regexp_replace({_flat("t")}, '(?i)\b({_SHORT})\.', '\1' || chr(1), 'g'), '(?i)\b([0-9]{{1,2}})\.(\s+(?:{_MONTHS})\b)', '\1' || chr(1) || '\2', 'g') as m from pieces
), cut as (
  select *, list_filter(list_transform(string_split(regexp_replace(m, '([.!?])\s+', '\1' || chr(2), 'g'), chr(2)), lambda x: trim(replace(x, chr(1), '.'))), lambda x: x <> '') as ss from marked
), parts as (
  select project, doc, title, reference, structured, kind, i, n, unnest(ss) as s, generate_subscripts(ss, 1) as s_no from cut
), texts as (
  select * exclude (s), {_bounded("s")} as text from parts
), keyed as (
  select *, {_key("text")} as key from texts where length(text) >= 12
), p as (
  select *, row_number() over (order by doc, kind, i, n, s_no) as o from keyed where length(key) >= 12 qualify row_number() over (partition by project, {_key("title")}, {_key("reference")}, key order by doc, kind, i, n, s_no) = 1
), c as (
  select *, {_flat("excerpt")} as ex, {_key(_flat("excerpt"))} as k, {_key("reference")} as r, {_TOKENS.format(k=_key(_flat("excerpt")))} as te, {_TOKENS.format(k=_key("title || ' ' || description"))} as td from claims
), held as (
  select distinct c.project, claim, d.doc, d.title, r from c join claim_documents d using (project) left join claim_entries e on e.project = d.project and e.doc = d.doc
  where length(ex) >= 12 and k <> '' and (contains({_key("d.text")}, k) or contains(coalesce({_key("e.text")}, ''), k))
), named as (
  select *, count(*) over w as docs, count(*) filter ({_REFERS.format(a="r", b=_key("title"))}) over w as own, {_REFERS.format(a="r", b=_key("title"))} as is_own from held window w as (partition by project, claim)
), chosen as (
  select project, claim, title as doc_title from named where (own = 1 and is_own) or (own <> 1 and docs = 1)
), inside as (
  select c.claim, p.*, key <> k as longer, {_REFERS.format(a="r", b=_key("p.reference"))} or {_REFERS.format(a="r", b=_key("p.title"))} as refers from chosen join c using (project, claim) join p on p.project = c.project and p.title = doc_title and contains(p.key, k)
), ranked as (
  select project, claim, reference, text, o, length(text) as len, structured, case when refers and longer then 1 when longer then 2 when refers then 3 when structured and (count(distinct case when structured then reference end) over (partition by project, claim)) = 1 then 4 else 5 end as rank from inside
), best as (
  select project, claim, reference, text from ranked qualify row_number() over (partition by project, claim order by rank, case when rank = 2 and structured then 0 else 1 end, case when rank = 2 then len else 0 end, o) = 1
), exact as (
  select chosen.project, chosen.claim, coalesce(best.reference, doc_title) as reference, coalesce(best.text, c.ex) as excerpt, 'exact' as how from chosen join c using (project, claim) left join best using (project, claim)
), scores as (
  select c.project, claim, p.title, p.reference, p.text, p.o, len(list_filter(te, lambda w: contains(p.key, w))) as he, len(list_filter(td, lambda w: contains(p.key, w))) as hd, len(te) as ne, len(td) as nd,
    case when r = '' then 0 when contains(r, {_key("p.title")}) or contains({_key("p.title")}, r) then 4 when contains(r, {_key("p.reference")}) or contains({_key("p.reference")}, r) then 2 else 0 end as near
  from c anti join exact using (project, claim) join p on p.project = c.project
), fit as (
  select *, 3 * he + hd + near as score from scores where he >= least(3, greatest(1, ne)) or hd >= least(4, greatest(2, nd))
), top as (
  select * from fit qualify score = max(score) over (partition by project, claim)
), sure as (
  select project, claim, reference, text from top where (project, claim) in (select (project, claim) from top group by project, claim having count(distinct title) = 1) qualify row_number() over (partition by project, claim order by he desc, length(text), o) = 1
)
select project, claim, reference, sha256(excerpt) as excerpt_sha256, how from exact union all select project, claim, reference, sha256(text), 'scored' from sure"""


@query(GROUNDED, ("claim_documents", "claim_entries", "claims"))
def grounded_claims(spark, d):
    """Every claim with its place in its project's documents, where it has one."""
    found = ground(*(fixture(spark, d, n) for n in ("claims", "claim_documents", "claim_entries")), "project")
    return found.select("project", "claim", "reference", F.sha2("excerpt", 256).alias("excerpt_sha256"), "how")
