"""Facts left out of analyses. The SQL has a row for every value and looks at all others of its fact."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators.fact_coverage import missing_facts
from lodestone.plans.registry import fixture, query


def _key(x: str) -> str:
    return rf"""trim(regexp_replace(regexp_replace(lower({x}), '[`*#>_\[\](){{}},.:;!?''"“”‘’/\\|-]', ' ', 'g'), '\s+', ' ', 'g'))"""


_SENSITIVE = "string_split('rto rpo sla ikke ingen aldri uten not no never without sekund sekunder second seconds minutt minutter minute minutes time timer hour hours dag dager day days uke uker week weeks måned måneder month months år year years prosent percent kb mb gb tb kr nok eur usd m2 m²', ' ')"
_LIKE = "(a.key <> '' and b.key <> '' and (a.key = b.key or (a.marks = b.marks and len(a.uniq) > 0 and len(b.uniq) > 0 and len(list_intersect(a.uniq, b.uniq)) / least(len(a.uniq), len(b.uniq)) >= 0.65)))"
MISSING = rf"""with f as (
  select doc_id, fact, category, case when contains(text, ':') then trim(substr(text, 1, instr(text, ':') - 1)) else 'Dokumentert fakta' end as head, case when contains(text, ':') then substr(text, instr(text, ':') + 1) else text end as body from analysis_facts
), v as (
  select *, list_filter(list_transform(string_split(body, case when contains(body, ' | ') then ' | ' else ';' end), lambda x: trim(regexp_replace(regexp_replace(x, '[.\s]+$', ''), '^\s+', ''))), lambda x: x <> '') as vs from f
), u as (
  select f.doc_id, t.field, f.category, fact, head, body, unnest(vs) as value, generate_subscripts(vs, 1) as i, {_key("coalesce(t.text, '')")} as content from v f join analysis_fields t using (doc_id, category)
), k as (
  select *, {_key("value")} as key, string_split({_key("value")}, ' ') as parts from u
), m as (
  select *, array_to_string(list_filter(parts, lambda w: regexp_matches(w, '[0-9]') or list_contains({_SENSITIVE}, w)), '|') as marks, list_filter(parts, lambda w: length(w) > 2 or regexp_matches(w, '[0-9]')) as tokens from k
), h as (
  select *, list_distinct(tokens) as uniq, contains(content, key) or (len(tokens) > 0 and len(list_filter(tokens, lambda w: contains(content, w))) >= greatest(2, (len(tokens) * 4 + 4) // 5)) as has from m
), n as (
  select a.* from h a where not has and not exists (select 1 from h b where b.has and b.doc_id = a.doc_id and b.field = a.field and b.fact = a.fact and {_LIKE})
), g as (
  select a.* from n a where not exists (select 1 from n b where b.i < a.i and b.doc_id = a.doc_id and b.field = a.field and b.fact = a.fact and {_LIKE})
)
select doc_id, field, category, fact, md5(case when head in ('Dokumenterte tekniske grenseverdier', 'Dokumenterte arkitektur- og kontrollføringer', 'Dokumenterte effektmål', 'Dokumenterte milepæler') then string_agg(value, '. ' order by i) || '.'
  else head || ': ' || case when contains(body, ' | ') then string_agg(value, ' | ' order by i) else string_agg(value, '; ' order by i) end || '.' end) as added_md5 from g group by doc_id, field, category, fact, head, body"""


@query(MISSING, ("analysis_facts", "analysis_fields"))
def facts_left_out(spark, d):
    """What the fields of every analysis lack of their documents' facts."""
    found = missing_facts(fixture(spark, d, "analysis_facts"), fixture(spark, d, "analysis_fields"), ["doc_id"])
    return found.select("doc_id", "field", "category", "fact", F.md5("added").alias("added_md5"))
