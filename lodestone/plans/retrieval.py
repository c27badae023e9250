"""Retrieval queries. The query vector is that of vec_id 0."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.operators import retrieval as R
from lodestone.operators.search import nearest
from lodestone.plans.registry import query
from lodestone.sources.tables import table

TERMS = ["the", "that", "and"]
COS = """sims as (select e.vec_id, e.label, list_dot_product(e.embedding::double[], q.v) / (sqrt(list_dot_product(e.embedding::double[], e.embedding::double[])) * sqrt(list_dot_product(q.v, q.v))) as s
    from embeddings e, (select embedding::double[] as v from embeddings where vec_id = 0) q)"""
HITS = " + ".join(f"contains(lower(text), '{t}')::int" for t in TERMS)


def _query_vector(spark, d) -> list[float]:
    row = table(spark, d, "embeddings").where("vec_id = 0").select("embedding").first()
    return [float(x) for x in row["embedding"]]


@query(
    f"""with {COS}, a as (select vec_id as id, s, row_number() over (order by s desc, vec_id) as r from sims order by s desc, vec_id limit 48),
    h as (select doc_id as id, {HITS} as hits from documents), b as (select id, hits, row_number() over (order by hits desc, id) as r from h where hits > 0 order by hits desc, id limit 48),
    f as (select coalesce(a.id, b.id) as id, coalesce(1.0 / (50 + a.r), 0) + coalesce(1.0 / (50 + b.r), 0) as score, a.s from a full join b on a.id = b.id)
    select id, round(score, 9) as score, round(s, 6) as similarity from f order by f.score desc, s desc nulls last, id limit 12"""
)
def hybrid_rrf_topk(spark, d):
    """The nearest vectors and the documents with most query terms, fused."""
    semantic = R.vector_matches(table(spark, d, "embeddings"), "vec_id", "embedding", _query_vector(spark, d), 48)
    keyword = R.keyword_matches(table(spark, d, "documents"), "doc_id", "text", TERMS, 48)
    fused = R.fuse(semantic, keyword, 12)
    return fused.select("id", F.round("score", 9).alias("score"), F.round("similarity", 6).alias("similarity"))


@query(f"with {COS} select vec_id as id, round(s, 6) as similarity from sims where label in (1, 3) and s >= 0.0 order by s desc, vec_id limit 20")
def vector_match_scoped(spark, d):
    found = R.vector_matches(table(spark, d, "embeddings"), "vec_id", "embedding", _query_vector(spark, d), 20, 0.0, F.col("label").isin(1, 3))
    return found.select("id", F.round("similarity", 6).alias("similarity"))


@query(
    r"""with p as (select doc_id, ' ' || regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g') || ' ' as t from documents)
    select doc_id from p where (contains(t, ' the ') or contains(t, ' und ')) and contains(t, ' and the ') and not contains(t, ' les ')"""
)
def boolean_keyword_search(spark, d):
    return table(spark, d, "documents").where(R.boolean_search(F.col("text"), 'the or und "and the" -les')).select("doc_id")


@query(
    f"""with s as (select doc_id, lang, {HITS} + 5 * contains(lower(text), 'ention')::int as score from documents), r as (select *, row_number() over (partition by lang order by score desc, doc_id) as k from s where score > 0) select doc_id, lang, score from r where k <= 10"""
)
def lexical_score_rerank(spark, d):
    scored = table(spark, d, "documents").select("doc_id", "lang", R.lexical_score(F.col("text"), TERMS, ["ention"]).alias("score")).where("score > 0")
    k = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), "doc_id"))
    return scored.withColumn("k", k).where("k <= 10").drop("k")


@query(
    """with t as (select doc_id, regexp_split_to_array(trim(regexp_replace(lower(text), '[^a-z0-9 .-]+', ' ', 'g')), ' +') as ws from documents)
    select doc_id, array_to_string(list_sort(list_distinct(list_slice(list_filter(ws, lambda w: length(w) >= 4 and w not in ('eller','ikke','skal','som','for','med','til','det','den','dette','the','and','that','this','with','from','have','will','must','shall','requirement','requirements','krav','kunden','leverandor','leverandoren')), 1, 180))), ' ') as tokens from t"""
)
def retrieval_tokens(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(F.array_sort(R.tokens(F.col("text"))), " ").alias("tokens"))


@query(
    """with s as (select doc_id as id, source as source_id, lang as reference, text, length(text) as score from documents), r as (select *, row_number() over (partition by source_id, reference, sha256(substr(text, 1, 700)) order by score desc, id) as k from s) select id, source_id, reference, score from r where k = 1"""
)
def snippet_dedupe(spark, d):
    snippets = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("source_id"), F.col("lang").alias("reference"), "text", F.length("text").cast("long").alias("score"))
    return R.snippet_dedupe(snippets).select("id", "source_id", "reference", "score")


@query(
    """with q as (select vec_id as query_id, label, embedding::double[] as v from embeddings where vec_id % 50 = 0),
    s as (select q.query_id, e.vec_id as id, list_dot_product(e.embedding::double[], q.v) / (sqrt(list_dot_product(e.embedding::double[], e.embedding::double[])) * sqrt(list_dot_product(q.v, q.v))) as s from q join embeddings e on e.vec_id <> q.query_id),
    r as (select *, row_number() over (partition by query_id order by round(s, 9) desc, id) as rank from s),
    x as (select q.query_id, e.vec_id as id from q join embeddings e on e.label = q.label and e.vec_id <> q.query_id),
    p as (select x.query_id, avg((coalesce(r.rank, 1000000000) <= 5)::int) as r5, avg((coalesce(r.rank, 1000000000) <= 10)::int) as r10, coalesce(1.0 / min(r.rank), 0) as rr from x left join (select * from r where rank <= 10) r on r.query_id = x.query_id and r.id = x.id group by 1)
    select count(*) as queries, round(avg(r5), 6) as recall_at_5, round(avg(r10), 6) as recall_at_10, round(avg(rr), 6) as mrr from p"""
)
def retrieval_eval_mrr(spark, d):
    """Queries are the vectors whose id fifty divides; what has their label is relevant."""
    vectors = table(spark, d, "embeddings").select("vec_id", "label", "embedding")
    queries = vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("label").alias("wanted"), F.col("embedding").alias("v"))
    top = nearest(vectors.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), queries, 10)
    wanted = vectors.join(queries.select("query_id", F.col("wanted").alias("label")), "label").where("vec_id <> query_id")
    return R.evaluate(top, wanted.select("query_id", F.col("vec_id").alias("id")))


@query(
    """with t as (select doc_id as id, source as source_id, text from documents order by n_chars desc, doc_id limit 16), c as (select count(*) as snippets, count(distinct source_id) as sources, max(contains(lower(text), 'ention')::int) + max(contains(lower(text), 'zzqx')::int) as covered from t)
    select snippets, sources, covered, round(covered / 2, 6) as coverage, snippets + 2 * sources + 3 * covered as score, snippets + 2 * sources + 3 * covered >= 9 and covered / 2 >= 0.4 as sufficient, snippets + 2 * sources + 3 * covered >= 18 as high from c"""
)
def retrieval_quality(spark, d):
    top = table(spark, d, "documents").orderBy(F.desc("n_chars"), "doc_id").limit(16).select(F.col("source").alias("source_id"), "text")
    return R.quality(top, ["ention", "zzqx"])


@query(
    """select doc_id, round(case when len(ws) > 0 then len(list_filter(ws, lambda w: w = 'the')) * 100.0 / len(ws) else 0 end, 6) as density from (select doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') as ws from documents)"""
)
def term_density(spark, d):
    return table(spark, d, "documents").select("doc_id", R.cover_density(F.col("text"), "the").alias("density"))


@query(
    """with r(bucket, ord, word) as (values ('service', 1, 'serv'), ('price', 2, 'ent'), ('risk', 3, 'ris'), ('time', 4, 'tion'), ('people', 5, 'ing'), ('security', 6, 'sec'), ('other', 7, 'the'))
    select bucket, count(*) as documents, sum(hits) as hits from (select doc_id, bucket, (length(lower(text)) - length(replace(lower(text), word, ''))) // length(word) as hits, row_number() over (partition by doc_id order by (length(lower(text)) - length(replace(lower(text), word, ''))) // length(word) desc, ord) as k from documents, r) where k = 1 group by 1"""
)
def coverage_buckets(spark, d):
    """Each document's bucket is that whose word occurs most, the first winning; seven expressions a row, no join."""
    rules = [("service", "serv"), ("price", "ent"), ("risk", "ris"), ("time", "tion"), ("people", "ing"), ("security", "sec"), ("other", "the")]
    low = F.lower("text")
    hits = [F.struct(F.floor((F.length(low) - F.length(F.replace(low, F.lit(w), F.lit("")))) / len(w)).alias("hits"), F.lit(-i).alias("ord"), F.lit(b).alias("bucket")) for i, (b, w) in enumerate(rules)]
    best = table(spark, d, "documents").select(F.greatest(*hits).alias("m"))
    return best.groupBy("m.bucket").agg(F.count("*").alias("documents"), F.sum("m.hits").alias("hits"))


@query(
    """with p as (select p_partkey, list_distinct(string_split(lower(p_name), ' ')) as ks from part), d as (select doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z]+')) as ws from documents where doc_id % 50 = 0),
    k as (select doc_id, p_partkey, count(*) as n, any_value(len(ks)) as m from (select doc_id, unnest(ws) as w from d) join (select p_partkey, ks, unnest(ks) as w from p) using (w) group by 1, 2)
    select doc_id, p_partkey, n, least(100, round(100.0 * n / greatest(4, m), 6)) as usefulness, 100.0 * n / greatest(4, m) >= 18 as recommended from k"""
)
def service_recommendation(spark, d):
    """Keyword overlap of query documents (those whose id fifty divides) with part names: an equi-join on words."""
    parts = table(spark, d, "part").select("p_partkey", F.array_distinct(F.split(F.lower("p_name"), " ")).alias("ks"))
    keys = parts.select("p_partkey", F.size("ks").alias("m"), F.explode("ks").alias("w"))
    docs = table(spark, d, "documents").where("doc_id % 50 = 0")
    words = docs.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), 0))).alias("w"))
    hits = words.join(keys, "w").groupBy("doc_id", "p_partkey").agg(F.count("*").alias("n"), F.max("m").alias("m"))
    useful = 100 * F.col("n") / F.greatest(F.lit(4), F.col("m"))
    return hits.select("doc_id", "p_partkey", "n", F.least(F.lit(100), F.round(useful, 6)).alias("usefulness"), (useful >= 18).alias("recommended"))
