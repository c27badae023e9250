"""One ledger for several sources. The SQL compares every customer's row with every formal row of its project, by the rule as it is told."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators.ledger_sources import canonical_ledger
from lodestone.plans.registry import fixture, query


def _canon(x: str) -> str:
    closed = rf"regexp_replace(replace(coalesce({x}, ''), chr(173), ''), '([\p{{L}}\p{{N}}])[-‐‑‒–—][\s\p{{Z}}]*\n[\s\p{{Z}}]*(\p{{Ll}})', '\1\2', 'g')"
    return rf"trim(regexp_replace(lower({closed}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"


_KINDS = " ".join(
    f"when regexp_full_match(w, '{p}') then '{n}'"
    for n, p in (
        ("internal", "intern(e|t)?"), ("external", "ekstern(e|t)?"), ("minimum", "minimum|minst"), ("maximum", "maksimum|maksimalt|høyst"), ("before", "før"), ("after", "etter"),
        ("included", "inkludert"), ("excluded", "ekskludert"), ("allowed", "tillatt"), ("prohibited", "forbudt"), ("encrypted", "kryptert"), ("unencrypted", "ukryptert"),
        ("active", "aktiv(e|t)?"), ("passive", "passiv(e|t)?"),
    )
)
_RESTRICTED = "['aldri', 'bare', 'ingen', 'ikke', 'intet', 'kun', 'unntatt', 'uten', 'verken']"
_UNITS = "string_split('bit byte dag dager gb gbps hz kb kbps kg km mb mbps minutt minutter ms måned måneder prosent sekund sekunder tb time timer uke uker år', ' ')"
_GENERIC = "string_split('dokument dokumentet krav kravene kravet leveranse leveransen leveransekrav tjeneste tjenesten', ' ')"
_MADE_UP = "'side[0-9]+krav[0-9]+|dokumenttekstkrav[0-9]+'"
_SET = "list_sort(list_distinct({}))"
LEDGER = rf"""with e as (
  select *, coalesce(list_filter(list_transform(regexp_split_to_array(coalesce(id, ''), '[\s\p{{Z}}]+-[\s\p{{Z}}]+'), lambda p: trim(p)), lambda p: p <> '')[-1], '') as last from source_entries
), n as (
  select project, doc, entry, side, id, text, {_canon("text")} as c, {_canon("service")} as s, replace({_canon("heading")}, ' ', '') as h, {_canon("id")} as i, {_canon("last")} as l from e
), f as (
  select *, replace(c, ' ', '') as x, replace(s, ' ', '') as sx, string_split(c, ' ') as tokens,
    list_filter([{{'k': replace(l, ' ', ''), 'w': l}}, {{'k': replace(s, ' ', ''), 'w': s}}], lambda z: length(z.k) >= 6 and not regexp_full_match(z.k, {_MADE_UP}) and z.k not in ('krav', 'requirement')) as named,
    list_filter([replace(i, ' ', ''), replace(l, ' ', '')], lambda k: regexp_matches(k, '[0-9]') and not regexp_full_match(k, {_MADE_UP})) as numbers from n
), g as (
  select *, case when len(named) = 2 and named[1].k = named[2].k then named[1:1] else named end as labels,
    len(list_filter(list_distinct(list_filter(string_split(s, ' '), lambda w: length(w) >= 5 and not list_contains({_GENERIC}, w))), lambda w: len(list_filter(tokens, lambda t: t = w or (length(w) > 6 and length(t) > 6 and t[1:7] = w[1:7]))) > 0)) >= 2 as grounded,
    {_SET.format(f"list_filter(list_transform(tokens, lambda w: case {_KINDS} end), lambda k: k is not null)")} as contrasts, {_SET.format(f"list_filter(tokens, lambda w: list_contains({_RESTRICTED}, w))")} as restricted,
    {_SET.format(f"list_concat(list_filter(tokens, lambda w: regexp_full_match(w, '[0-9]+') or list_contains({_UNITS}, w)), list_filter([array_to_string(list_sort(regexp_extract_all(text, '[%‰°]')), '')], lambda w: w <> ''))")} as amounts,
    list_transform(regexp_extract_all(text, '\b(\p{{Lu}}{{2,}}[\p{{L}}\p{{N}}]*|\p{{Lu}}\p{{Ll}}+\p{{Lu}}[\p{{L}}\p{{N}}]*)\b', 1), lambda m: lower(m)) as entities from f
), pairs as (
  select a.project, a.doc, a.entry, a.c as ac, b.c as bc, a.x as ax, b.x as bx, a.sx as asx, b.sx as bsx, a.h as ah, b.h as bh, a.grounded as ag, b.grounded as bg,
    a.contrasts = b.contrasts and a.restricted = b.restricted and a.amounts = b.amounts and len(list_filter(a.entities, lambda z: not contains(b.x, z))) = 0 and len(list_filter(b.entities, lambda z: not contains(a.x, z))) = 0 as alike,
    list_filter(a.labels, lambda z: list_contains(list_transform(b.labels, lambda y: y.k), z.k)) as common, list_has_any(a.numbers, b.numbers) as numbered from g a join g b using (project) where a.side = 'customer' and b.side = 'formal'
), told as (
  select *, len(common) > 0 or numbered as known, list_filter(flatten(list_transform(common, lambda z: string_split(z.w, ' '))), lambda w: length(w) >= 4) as words,
    case when asx <> '' and bsx <> '' then asx <> bsx else ah <> '' and bh <> '' and ah <> bh end as apart,
    case when asx <> '' and bsx <> '' then asx = bsx when asx = '' and bsx = '' then not (ah <> '' and bh <> '' and ah <> bh) when asx <> '' then ag else bg end as scoped from pairs
), gone as (
  select distinct project, doc, entry from told where ac <> '' and bc <> '' and case when ac = bc then case when length(ac) >= 160 then scoped else known and not apart end
    else (least(length(ax), length(bx)) >= 800 and 5 * least(length(ax), length(bx)) >= 4 * greatest(length(ax), length(bx)) and (starts_with(ax, bx) or starts_with(bx, ax)) and scoped)
      or (known and not apart and alike and (ax = bx or (len(words) > 0 and array_to_string(list_filter(string_split(ac, ' '), lambda w: not list_contains(words, w)), '') = array_to_string(list_filter(string_split(bc, ' '), lambda w: not list_contains(words, w)), '')))) end
)
select project, doc, entry, id, md5(text) as text_md5, row_number() over (partition by project, doc order by entry, id, text) - 1 as entry_order from g anti join gone using (project, doc, entry)"""


@query(LEDGER, ("source_entries",))
def source_ledger(spark, d):
    """Every source's requirement rows but those of the customer that a formal document states too, ranked anew."""
    found = canonical_ledger(fixture(spark, d, "source_entries"), ["project"])
    return found.select("project", "doc", "entry", "id", F.md5("text").alias("text_md5"), F.col("entry_order").cast("long"))
