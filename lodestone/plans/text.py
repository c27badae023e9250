"""Text queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import similar as S
from lodestone.plans.registry import query
from lodestone.sources.tables import table

#: The comparison key of a text.
KEY = r"""trim(regexp_replace(regexp_replace(lower(text), '[`*#>_\[\](){},.:;!?''"“”‘’/\\|-]', ' ', 'g'), '\s+', ' ', 'g'))"""

#: Its identifiers: words with a letter and a digit.
IDENTITY = rf"array_to_string(list_filter(string_split({KEY}, ' '), lambda w: regexp_matches(w, '[0-9]') and regexp_matches(w, '\p{{L}}')), ' ')"


def _docs(spark, d):
    return table(spark, d, "documents")


@query("select doc_id, greatest(1, cast(ceil(length(text) / 4) as bigint)) as tokens, sha256(text) as content_hash from documents")
def token_count_hash(spark, d):
    return _docs(spark, d).select("doc_id", T.token_count(F.col("text")).alias("tokens"), F.sha2("text", 256).alias("content_hash"))


@query(
    r"""select doc_id, md5(regexp_replace(regexp_replace(array_to_string(list_transform(string_split(regexp_replace(regexp_replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(0), ''), '[‐‑‒–—]', '-', 'g'), '[ \t]+', ' ', 'g'), chr(10)), lambda l: trim(l)), chr(10)), '\n{4,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) as normalized_md5 from documents"""
)
def normalized_text(spark, d):
    return _docs(spark, d).select("doc_id", F.md5(T.normalized(F.col("text"))).alias("normalized_md5"))


@query(
    r"""select item_id, trim(regexp_replace(regexp_replace(strip_accents(lower(text)), '[^a-z0-9\s.-]+', ' ', 'g'), '\s+', ' ', 'g')) as key from benchmark"""
)
def comparable_key(spark, d):
    return table(spark, d, "benchmark").select("item_id", T.comparable(F.col("text")).alias("key"))


@query(
    rf"""with k as (select doc_id, regexp_replace(regexp_replace(text, '(?i)\b({"|".join(a.replace(".", chr(92) + ".") for a in T.ABBREVIATIONS)})\.', '\1' || chr(1), 'g'), '(?i)\b([0-9]{{1,2}})\.(\s+(?:{"|".join(T.MONTHS)})\b)', '\1' || chr(1) || '\2', 'g') as k from documents),
    s as (select doc_id, list_filter(list_transform(string_split(regexp_replace(k, '([.!?])\s+', '\1' || chr(2), 'g'), chr(2)), lambda x: trim(replace(x, chr(1), '.'))), lambda x: x <> '') as s from k)
    select doc_id, len(s) as n_sentences, md5(array_to_string(s, chr(10))) as sentences_md5 from s"""
)
def sentence_split(spark, d):
    found = _docs(spark, d).select("doc_id", T.sentences(F.col("text")).alias("s"))
    return found.select("doc_id", F.size("s").cast("long").alias("n_sentences"), F.md5(F.array_join("s", "\n")).alias("sentences_md5"))


@query(
    r"""with f as (select doc_id, list_filter(regexp_extract_all(' ' || upper(text) || ' R-12 ISO-9001 FUN-A1 K3.2: k3.2', '[^A-Za-z0-9_-]([A-Z]{1,6}-?[0-9]{1,5}(?:\.[0-9]{1,3})*)', 1), lambda x: regexp_extract(x, '^([A-Z]+)', 1) not in ('ISO','IEC','IEEE','RFC','NS','EN','UTF','SHA','TLS','WCAG')) as ids from documents)
    select doc_id, len(list_distinct(ids)) as n_ids, array_to_string(list_sort(list_distinct(ids)), ',') as ids from f"""
)
def requirement_ids(spark, d):
    source = F.concat(F.upper("text"), F.lit(" R-12 ISO-9001 FUN-A1 K3.2: k3.2"))
    found = _docs(spark, d).select("doc_id", T.requirement_ids(source).alias("ids"))  # once for both columns
    return found.select("doc_id", F.size("ids").cast("long").alias("n_ids"), F.array_join(F.array_sort("ids"), ",").alias("ids"))


@query(
    rf"""with a as (select item_id, text, list_distinct(list_filter(string_split({KEY}, ' '), lambda w: length(w) > 2 or regexp_matches(w, '[0-9]'))) as ws from benchmark)
    select a.item_id, round(case when least(len(a.ws), len(b.ws)) > 0 then len(list_intersect(a.ws, b.ws)) / least(len(a.ws), len(b.ws)) else 0 end, 6) as overlap from a join a b on b.item_id = a.item_id + 1"""
)
def token_overlap(spark, d):
    a = table(spark, d, "benchmark").select("item_id", T.words(F.col("text")).alias("ws"))
    b = a.select((F.col("item_id") - 1).alias("item_id"), F.col("ws").alias("other"))
    return a.join(b, "item_id").select("item_id", F.round(T.overlap(F.col("ws"), F.col("other")), 6).alias("overlap"))


@query(
    f"""with w as (select doc_id, {KEY} as k, array_to_string(list_filter(string_split({KEY}, ' '), lambda w: regexp_matches(w, '[0-9]') or w in ({", ".join(f"'{w}'" for w in T.SENSITIVE)})), chr(1)) as s,
      list_distinct(list_filter(string_split({KEY}, ' '), lambda w: length(w) > 2 or regexp_matches(w, '[0-9]'))) as ws, {IDENTITY} as i from documents),
    d as (select k, s, any_value(ws) as ws, any_value(i) as i, min(doc_id) as doc_id from w where k <> '' group by k, s),
    b as (select doc_id, 1 as form, s, replace(k, ' ', '') as key from d union all select doc_id, 2, s, substr(k, 1, 320) from d union all select doc_id, 3, s, i from d where i <> ''),
    c as (select distinct a.doc_id as a, z.doc_id as z from b a join b z using (form, key, s) where a.doc_id <> z.doc_id),
    n as (select c.a, c.z from c join d a on a.doc_id = c.a join d z on z.doc_id = c.z where least(len(a.ws), len(z.ws)) > 0 and len(list_intersect(a.ws, z.ws)) / least(len(a.ws), len(z.ws)) >= 0.72),
    every as (select a, z from n union all select doc_id, doc_id from d)
    select w.doc_id, min(z) as first_id, bool_or(z = d.doc_id) as exact from w join d on w.k = d.k join every on every.a = d.doc_id where z < w.doc_id group by 1"""
)
def near_duplicate_pairs(spark, d):
    """Each document with the first that it repeats, and whether one before it is equal; see ``similar.first_repeats``."""
    return S.first_repeats(_docs(spark, d), "doc_id", "text")


@query(
    r"""select doc_id, case when length(text) > 80 then rtrim(substr(text, 1, 79)) || '…' else text end as preview, case when length(text) <= 60 then text when regexp_replace(substr(text, 1, 60), '\s+\S*$', '') = '' then substr(text, 1, 60) else regexp_replace(substr(text, 1, 60), '\s+\S*$', '') end as title from documents"""
)
def previews(spark, d):
    return _docs(spark, d).select("doc_id", T.compact(F.col("text"), 80).alias("preview"), T.cut_at_word(F.col("text"), 60).alias("title"))


@query(
    r"""select doc_id, md5(regexp_replace(text, '([A-Za-z0-9])[A-Za-z0-9._%+-]*@([A-Za-z0-9.-]+\.[A-Za-z]{2,})', '\1***@\2', 'g')) as masked_md5, regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}') as has_email from documents"""
)
def masked_emails(spark, d):
    has = F.col("text").rlike(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}")
    return _docs(spark, d).select("doc_id", F.md5(T.masked_email(F.col("text"))).alias("masked_md5"), has.alias("has_email"))


@query(
    r"""select doc_id, greatest(1, len(regexp_extract_all(lower(text), 'and[\s-]+the'))) as mentions from documents"""
)
def mention_counts(spark, d):
    return _docs(spark, d).select("doc_id", T.mentions(F.col("text"), "And the").cast("long").alias("mentions"))


@query(
    r"""select doc_id, array_to_string(list_filter([case when contains(text, '�') then 'replacement_character' end, case when contains(text, chr(173)) then 'soft_hyphen' end, case when regexp_matches(text, '[a-z]-\n[a-z]') then 'broken_word' end, case when length(text) > 40 and not regexp_matches(lower(text), '[aeiouyæøåäöüéèêíóúáà]') then 'no_vowels' end, case when contains(text, '  ') then 'double_space' end, case when regexp_matches(text, '[\x00-\x08\x0B\x0C\x0E-\x1F]') then 'control_character' end], lambda x: x is not null), ',') as codes from documents"""
)
def text_diagnostics(spark, d):
    codes = F.array_except(T.diagnostics(F.col("text")), F.array(F.lit("mojibake"), F.lit("long_run")))  # RE2 has no back references
    return _docs(spark, d).select("doc_id", F.array_join(codes, ",").alias("codes"))


@query(
    """select event_id, json_extract_string(props, '$.k') as k, sha256('{"event_type":"' || event_type || '","user_id":' || user_id || '}') as fingerprint from events"""
)
def canonical_fingerprint(spark, d):
    body = T.canonical_json(F.struct("user_id", "event_type"), ["user_id", "event_type"])
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), F.sha2(body, 256).alias("fingerprint"))
