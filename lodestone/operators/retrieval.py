"""Vector and keyword retrieval, fused by reciprocal rank.

Queries are a stated set, so scores are a scan of the chunks per query, not a
join of chunks with chunks; top-k is a partial top-k a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Words that no query searches for.
STOP_WORDS = [
    "eller", "ikke", "skal", "som", "for", "med", "til", "det", "den", "dette", "the", "and", "that", "this", "with", "from",
    "have", "will", "must", "shall", "requirement", "requirements", "krav", "kunden", "leverandor", "leverandoren",
]


def cosine(vector: Column, query: list[float]) -> Column:
    """Cosine similarity with a constant vector, in doubles; null for a zero vector or another length."""
    norm = sum(x * x for x in query) ** 0.5
    wanted = F.array(*[F.lit(float(x)) for x in query])
    products = F.zip_with(vector, wanted, lambda a, b: a.cast("double") * b)
    dot = F.aggregate(products, F.lit(0.0), lambda s, x: s + x)
    own = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when((F.size(vector) == len(query)) & (own > 0), dot / (own * norm))


def vector_matches(chunks: DataFrame, id_column: str, vector: str, query: list[float], limit: int, threshold: float = -1.0, scope: Column | None = None) -> DataFrame:
    """``id, similarity`` of the nearest chunks at or above the threshold; the limit is kept within 1 to 200."""
    rows = chunks if scope is None else chunks.where(scope)
    found = rows.select(F.col(id_column).alias("id"), cosine(F.col(vector), query).alias("similarity")).where(F.col("similarity") >= threshold)
    return found.orderBy(F.desc("similarity"), "id").limit(min(max(limit, 1), 200))


def tokens(text: Column, limit: int = 180) -> Column:
    """Search tokens: lower-case words of four characters or more that are not stop words, the first ``limit``, each once."""
    words = F.filter(F.split(F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9 .-]+", " ")), " +"), lambda w: (F.length(w) >= 4) & ~w.isin(STOP_WORDS))
    return F.array_distinct(F.slice(words, 1, limit))


def lexical_score(text: Column, terms: list[str], exact: list[str]) -> Column:
    """Terms that occur, and five for each exact term that does."""
    low = F.lower(text)
    score = F.lit(0)
    for term in terms:
        score = score + low.contains(term).cast("int")
    for term in exact:
        score = score + 5 * low.contains(term.lower()).cast("int")
    return score


def keyword_matches(chunks: DataFrame, id_column: str, text: str, terms: list[str], limit: int) -> DataFrame:
    """``id, hits`` of the chunks with most of the terms, at least one."""
    found = chunks.select(F.col(id_column).alias("id"), lexical_score(F.col(text), terms, []).alias("hits")).where("hits > 0")
    return found.orderBy(F.desc("hits"), "id").limit(min(max(limit, 1), 200))


def ranked(rows: DataFrame, score: str, name: str) -> DataFrame:
    """``rows`` of a top-k list with their rank."""
    return rows.withColumn(name, F.row_number().over(Window.orderBy(F.desc(score), "id")))


def fuse(semantic: DataFrame, keyword: DataFrame, limit: int, k: int = 50, weights: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """Reciprocal-rank fusion of two top-k lists of at most 200 rows."""
    a, b = ranked(semantic, "similarity", "semantic_rank"), ranked(keyword, "hits", "keyword_rank")
    part = [F.coalesce(F.lit(w) / (F.lit(max(k, 1)) + F.col(r)), F.lit(0.0)) for w, r in zip(weights, ("semantic_rank", "keyword_rank"), strict=True)]
    fused = a.join(b, "id", "full").withColumn("score", part[0] + part[1])
    return fused.orderBy(F.desc("score"), F.desc_nulls_last("similarity"), "id").limit(limit)


def web_query(text: str) -> list[tuple[bool, list[str]]]:
    """A search string as (negated, phrase words) terms; ``or`` is kept as a marker phrase."""
    import re

    out = []
    for minus, phrase, word in re.findall(r'(-?)(?:"([^"]*)"|(\S+))', text.lower()):
        words = re.findall(r"[^\W_]+", phrase or word)
        if words:
            out.append((bool(minus), words))
    return out


def boolean_search(text: Column, query: str) -> Column:
    """Whether a text satisfies a search string: all terms, quoted phrases, ``or`` between two terms, ``-`` for none."""
    padded = F.concat(F.lit(" "), F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "), F.lit(" "))
    groups: list[Column] = []
    alternative = False
    for negated, words in web_query(query):
        if words == ["or"] and not negated:
            alternative = True
            continue
        has = padded.contains(f" {' '.join(words)} ")
        has = ~has if negated else has
        if alternative and groups:
            groups[-1] = groups[-1] | has
        else:
            groups.append(has)
        alternative = False
    result = F.lit(bool(groups))
    for g in groups:
        result = result & g
    return result


def cover_density(text: Column, term: str) -> Column:
    """A documented stand-in for a cover-density rank: hits of the term for each hundred words."""
    words = F.size(F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9]+"), 0))
    hits = F.size(F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9]+"), 0), lambda w: w == term))
    return F.when(words > 0, F.round(hits * 100.0 / words, 6)).otherwise(0.0)


def snippet_dedupe(snippets: DataFrame) -> DataFrame:
    """The best-scored snippet of each source, reference and beginning of text (700 characters)."""
    key = ["source_id", "reference", F.sha2(F.substring("text", 1, 700), 256).alias("head")]
    best = F.max_by(F.struct(*snippets.columns), F.struct("score", (-F.col("id")).alias("id"))).alias("row")
    return snippets.groupBy(*key).agg(best).select("row.*")


def evaluate(retrieved: DataFrame, expected: DataFrame, ks: tuple[int, ...] = (5, 10)) -> DataFrame:
    """``retrieved(query_id, rank, id)`` against ``expected(query_id, id)``: recall at each k and mean reciprocal rank."""
    hits = expected.join(retrieved, ["query_id", "id"], "left")
    recalls = [F.avg((F.coalesce("rank", F.lit(1 << 30)) <= k).cast("double")).alias(f"recall_at_{k}") for k in ks]
    per_query = hits.groupBy("query_id").agg(*recalls, F.coalesce(1.0 / F.min("rank"), F.lit(0.0)).alias("rr"))
    return per_query.agg(F.count("*").alias("queries"), *[F.round(F.avg(f"recall_at_{k}"), 6).alias(f"recall_at_{k}") for k in ks], F.round(F.avg("rr"), 6).alias("mrr"))


def quality(snippets: DataFrame, exact_terms: list[str], text: str = "text") -> DataFrame:
    """Counts, coverage of the exact terms, a score, and whether the retrieval suffices (score 9 and coverage 0.4) or is high (18)."""
    low = F.lower(text)
    found = [F.max(low.contains(t.lower()).cast("int")) for t in exact_terms]
    total = sum(found[1:], found[0]) if found else F.lit(0)
    counted = snippets.agg(F.count("*").alias("snippets"), F.countDistinct("source_id").alias("sources"), F.coalesce(total, F.lit(0)).alias("covered"))
    n = max(len(exact_terms), 1)
    scored = counted.withColumns({"coverage": F.round(F.col("covered") / n, 6), "score": F.col("snippets") + 2 * F.col("sources") + 3 * F.col("covered")})
    return scored.withColumns({"sufficient": (F.col("score") >= 9) & (F.col("coverage") >= 0.4), "high": F.col("score") >= 18})
