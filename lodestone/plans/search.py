"""Full-text ranks and the retrieval chain."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import retrieval as R
from lodestone.operators import search as S
from lodestone.plans.registry import fixture, query
from lodestone.plans.retrieval import COS, _query_vector
from lodestone.sources.tables import table

WORDS = r"regexp_extract_all(lower(substr(text, 1, 200000)), '[\p{L}\p{N}]+')"
#: Cover density of ``the`` with ``and`` or ``en``: the last place of each group so far, and the covers that begin later than the one before.
COVER = f"""word as (select doc_id, unnest(ws) as w, unnest(range(len(ws))) as p from (select doc_id, {WORDS} as ws from documents)),
  entry as (select *, row_number() over (partition by doc_id order by p) - 1 as i from word where w in ('the', 'and', 'en')),
  last as (select *, max(case when w = 'the' then i end) over win as a, max(case when w <> 'the' then i end) over win as b from entry window win as (partition by doc_id order by i rows unbounded preceding)),
  low as (select *, case when a is not null and b is not null then least(a, b) end as low from last),
  cover as (select *, lag(low) over (partition by doc_id order by i) as before from low),
  cd as (select c.doc_id, sum(0.1::double / ((c.p - e.p) - (c.i - e.i) + 1)) as rank from cover c join entry e on e.doc_id = c.doc_id and e.i = c.low where c.before is null or c.low > c.before group by 1)"""
TOKENS, TERMS = ["the", "tion", "est"], ["ention", "zzqx"]
LOW = "lower(title || ' ' || reference || ' ' || text)"
LEX = " + ".join([*(f"contains({LOW}, '{t}')::int" for t in TOKENS), *(f"5 * contains({LOW}, '{t}')::int" for t in TERMS)])
FOCUS = LEX.replace("reference || ' '", "reference || ' ' || heading || ' '")
SCORED = f"scored as (select *, {LEX} as lexical, case retrieval when 'hybrid' then 120 * rrf + 18 * coalesce(similarity, 0) + {LEX} when 'vector' then 28 * similarity + {LEX} else {LEX} end as score from candidates)"
RERANKED = f"""best as (select * exclude (k) from (select *, row_number() over (partition by source_type, source_id, reference, sha256(substr(text, 1, 700)) order by score desc, id) as k from scored) where k = 1),
  reranked as (select * exclude (score, lexical), greatest(lexical, {FOCUS}) as lexical, score + 1.8 * ({FOCUS}) + least({FOCUS}, 12)
    + case kind when 'requirement' then 3 when 'table' then 2 when 'answer_cell' then 2 when 'risk' then 1.5 else 0 end + case when retrieval = 'hybrid' then 180 * rrf else 0 end + 22 * coalesce(similarity, 0) as score from best)"""


@query(f"select doc_id, len(ws) as positions, len(list_distinct(ws)) as lexemes, coalesce(list_position(ws, 'the'), 0) as first_the, md5(array_to_string(ws, ' ')) as words_md5 from (select doc_id, {WORDS} as ws from documents)")
def lexeme_vector(spark, d):
    found = table(spark, d, "documents").select("doc_id", S.lexemes(F.col("text")).alias("v"))
    words = F.transform("v", lambda e: e["lexeme"])
    first = F.coalesce(F.get(F.filter("v", lambda e: e["lexeme"] == "the"), F.lit(0))["position"], F.lit(0))
    return found.select("doc_id", F.size("v").cast("long").alias("positions"), F.size(F.array_distinct(words)).cast("long").alias("lexemes"), first.alias("first_the"), F.md5(F.array_join(words, " ")).alias("words_md5"))


@query(f"with {COVER} select doc_id, round(rank, 9) as rank from cd")
def cover_density_rank(spark, d):
    words = F.regexp_extract_all(F.lower(F.substring("text", 1, 200_000)), F.lit(r"[\p{L}\p{N}]+"), 0)
    found = table(spark, d, "documents").select("doc_id", S.cover_density(words, S.query_groups("the and or en")).alias("rank"))
    return found.where("rank > 0").select("doc_id", F.round("rank", 9).alias("rank"))


@query(
    f"""with {COS}, {COVER}, a as (select vec_id as id, s, row_number() over (order by s desc, vec_id) as r from sims order by s desc, vec_id limit 48),
    b as (select doc_id as id, row_number() over (order by rank desc, doc_id) as r from cd order by rank desc, doc_id limit 48),
    f as (select coalesce(a.id, b.id) as id, coalesce(1.0 / (50 + a.r), 0) + coalesce(1.0 / (50 + b.r), 0) as score, a.s from a full join b on a.id = b.id)
    select id, round(score, 9) as score, round(s, 6) as similarity from f order by f.score desc, s desc nulls last, id limit 12"""
)
def hybrid_cover_density(spark, d, n: int = 12):
    """Nearest vectors and the best cover density of ``the`` with ``and`` or ``en``, fused; each list four times as long, within 12 to 200."""
    each = min(max(4 * n, 12), 200)
    semantic = R.vector_matches(table(spark, d, "embeddings"), "vec_id", "embedding", _query_vector(spark, d), each)
    keyword = S.keyword_ranked(table(spark, d, "documents"), "doc_id", "text", "the and or en", each)
    return R.fuse(semantic, keyword, n).select("id", F.round("score", 9).alias("score"), F.round("similarity", 6).alias("similarity"))


@query(f"with {COS} select vec_id as id, round(s, 6) as similarity from sims where label = 1 or label in (2, 3) order by s desc, vec_id limit 100")
def evidence_match(spark, d):
    """The older match: no threshold, at most 100, one project or the services."""
    scope = (F.col("label") == 1) | F.col("label").isin(2, 3)
    found = R.vector_matches(table(spark, d, "embeddings"), "vec_id", "embedding", _query_vector(spark, d), min(100, 200), -1.0, scope)
    return found.select("id", F.round("similarity", 6).alias("similarity"))


_LISTS = ", ".join(f"regexp_extract_all(text, '\\b{p}\\b')" for p in S.EXACT_TERMS)


@query(
    rf"""with t as (select doc_id, list_filter(list_transform(list_filter(flatten([{_LISTS}]), lambda t: length(t) between 2 and 80 and not regexp_matches(t, '^\d+$') and not regexp_matches(t, '(?i)^(side|page|del|part|section|seksjon)\s+\d+')), lambda t: trim(regexp_replace(t, '\s+', ' ', 'g'))), lambda t: t <> '') as ts from documents),
    k as (select doc_id, ts, list_transform(ts, lambda t: lower(t)) as ks from t)
    select doc_id, array_to_string(list_slice(list_filter(ts, lambda t, i: list_position(ks, lower(t)) = i), 1, 36), '|') as terms from k"""
)
def exact_terms(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(S.exact_terms(F.col("text")), "|").alias("terms"))


@query(
    r"""with q as (select conv_id, turn, strip_accents(lower(text)) as t, role from conversations), h as (select *, contains(t, 'tion')::int + contains(t, 'ing')::int + contains(t, 'risk')::int as hits from q)
    select conv_id, turn, role, hits >= 2 or (regexp_matches(regexp_replace(t, '[^a-z0-9\s.-]+', ' ', 'g'), '^\s*(hva|hvilke|oppsummer|gi|vis|forklar)\b') and hits >= 1) or role = 'system' as structured from h"""
)
def structured_mode(spark, d):
    turns = table(spark, d, "conversations")
    hints = F.when(F.col("role") == "system", F.array(F.lit("Risiko og drift"))).otherwise(F.array(F.lit("pris")))
    return turns.select("conv_id", "turn", "role", S.structured_mode(F.col("text"), ["tion", "ing", "risk"], hints).alias("structured"))


def _scored(spark, d):
    found = fixture(spark, d, "candidates")
    lex = S.lexical(found, TOKENS, TERMS, ["title", "reference", "text"])
    return found.withColumn("lexical", lex).withColumn("score", S.candidate_score(F.col("retrieval"), F.col("rrf"), F.col("similarity"), F.col("lexical")))


@query(f"with {SCORED} select id, lexical, round(score, 6) as score from scored", ("candidates",))
def candidate_scores(spark, d):
    return _scored(spark, d).select("id", "lexical", F.round("score", 6).alias("score"))


@query(f"with {SCORED}, {RERANKED} select id, lexical, round(score, 6) as score from reranked order by reranked.score desc, id limit 16", ("candidates",))
def reranked_snippets(spark, d):
    found = S.rerank(_scored(spark, d), TOKENS, TERMS)
    return found.orderBy(F.desc("score"), "id").limit(16).select("id", "lexical", F.round("score", 6).alias("score"))


@query(
    f"""with {SCORED}, {RERANKED}, top as (select * from reranked order by score desc, id limit 8),
    c as (select max(score) as top_score, count(*) as sources, count(*) filter (coalesce(similarity, 0) >= 0.15) as semantic_hits, count(*) filter (keyword_rank is not null or lexical > 0) as keyword_hits,
      count(distinct (source_type, source_id)) as documents, (max(contains({LOW}, 'ention')::int) + max(contains({LOW}, 'zzqx')::int)) / 2 as coverage from top),
    q as (select *, least(top_score / 6, 10) + least(sources, 4) + least(semantic_hits, 3) + least(keyword_hits, 3) + least(documents, 2) + coverage * 4 as score from c)
    select sources, semantic_hits, keyword_hits, documents, round(coverage, 6) as coverage, round(score, 6) as score, score >= 9 and coverage >= 0.4 as sufficient,
      case when score >= 18 and coverage >= 0.4 then 'high' when score >= 9 and coverage >= 0.4 then 'medium' else 'low' end as confidence from q""",
    ("candidates",),
)
def retrieval_assessment(spark, d):
    top = S.rerank(_scored(spark, d), TOKENS, TERMS).orderBy(F.desc("score"), "id").limit(8)
    return S.assess(top, TERMS).select("sources", "semantic_hits", "keyword_hits", "documents", F.round("coverage", 6).alias("coverage"), F.round("score", 6).alias("score"), "sufficient", "confidence")


@query(
    """with sources as (select distinct source_type, source_id, length(source_id) as fingerprint from candidates), stored as (select c.*, case when id % 5 = 0 then 0 else length(source_id) end as fingerprint, case when id % 11 = 0 then 'v0' else 'v1' end as version from candidates c where retrieval <> 'memory'),
    fresh as (select id, source_type, source_id, 'stored' as origin from stored s where version = 'v1' and exists (select 1 from sources x where x.source_type = s.source_type and x.source_id = s.source_id and x.fingerprint = s.fingerprint)),
    stale as (select distinct source_type, source_id from stored where version <> 'v1' or fingerprint = 0)
    select id, origin from fresh union all select c.id, 'memory' from candidates c join stale using (source_type, source_id) where retrieval = 'memory'""",
    ("candidates",),
)
def fallback_candidates(spark, d):
    """Stored chunks with a current fingerprint, and chunks made in memory for the sources that had stale ones."""
    found = fixture(spark, d, "candidates")
    sources = found.select("source_type", "source_id", F.length("source_id").alias("fingerprint"), F.lit("v1").alias("fingerprint_version")).distinct()
    stored = found.where("retrieval <> 'memory'").withColumns({"fingerprint": F.expr("case when id % 5 = 0 then 0 else length(source_id) end"), "fingerprint_version": F.expr("case when id % 11 = 0 then 'v0' else 'v1' end")})
    fresh = S.fresh(stored, sources)
    stale = stored.join(sources, ["source_type", "source_id", "fingerprint", "fingerprint_version"], "left_anti")
    columns = ["id", "source_type", "source_id"]
    memory = found.where("retrieval = 'memory'").select(*columns, F.lit("memory").alias("origin"))
    return S.with_fallback(fresh.select(*columns, F.lit("stored").alias("origin")), memory, sources, stale).select("id", "origin")
