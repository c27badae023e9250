"""Full-text ranks by cover density, and the retrieval chain from candidates to reranked snippets."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.requirements import let
from lodestone.functions.text import comparable
from lodestone.operators import retrieval as R
from lodestone.session import map_arrow

# What a kind of chunk adds to its score.
KIND_BOOST = {
    "requirement": 3.0, "requirement_row": 3.0, "evaluation_criteria": 3.0, "table": 2.0, "spreadsheet_rows": 2.0,
    "answer_cell": 2.0, "risk": 1.5, "commercial_term": 1.5, "architecture_signal": 1.5,
}
# Patterns of terms that a search must match exactly. Word limits are ASCII ones.
EDGE = r"(?:(?=\w)(?<!\w)|(?!\w)(?<=\w))"
EXACT_TERMS = [
    r"[A-ZÆØÅ]{1,10}-?\d{1,5}(?:\.\d+)*",
    r"[A-ZÆØÅ]{2,12}(?:/[A-ZÆØÅ]{2,12})?",
    r"[A-Za-zÆØÅæøå][A-Za-zÆØÅæøå0-9]+(?:-[A-Za-zÆØÅæøå0-9]+)+",
    r"[A-ZÆØÅ][A-Za-zÆØÅæøå0-9]+(?:\s+[A-ZÆØÅ][A-Za-zÆØÅæøå0-9]+){1,3}",
    r"(?:[A-ZÆØÅ][A-Za-zÆØÅæøå]{1,30}\s+){0,2}\d{1,4}(?:[,.]\d+)?\s*(?:%|prosent|timer|minutter|dager|uker|måneder|år)",
    r"\d{1,2}\.\s*[A-Za-zÆØÅæøå]{3,20}(?:\s+\d{4})?",
    r"(?:NOK|EUR|USD|SEK|DKK|GBP)\s*[\d\s,.]+(?:[A-Za-zÆØÅæøå]{0,20})?",
    r"[A-ZÆØÅ][A-Za-zÆØÅæøå]{1,30}\s+\d{1,4}",
]
PAGE_REFERENCE = r"(?i)^(side|page|del|part|section|seksjon)\s+\d+"


def lexemes(text: Column) -> Column:
    """Word and position (from 1) of the first 200,000 characters: lower case, no stemming, no stop words."""
    words = F.regexp_extract_all(F.lower(F.substring(text, 1, 200_000)), F.lit(r"[\p{L}\p{N}]+"), 0)
    return F.transform(words, lambda w, i: F.struct(w.alias("lexeme"), (i + 1).alias("position")))


def cover_density(words: Column, groups: list[list[str]]) -> Column:
    """Cover-density rank of a text's words for a query of alternatives that must all occur.

    A cover is a shortest run of words that has one of each group. Each adds a
    tenth, divided by one more than the words in it that the query doesn't name.
    One fold over the query's own words: the state is the last place of each group.
    """
    named = sorted({w for g in groups for w in g})
    entries = F.filter(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.cast("int").alias("p"))), lambda e: e["w"].isin(named))
    never = F.struct(F.lit(-1).alias("i"), F.lit(-1).alias("p"))
    start = F.struct(*(never.alias(f"g{k}") for k in range(len(groups))), F.lit(-1).alias("begin"), F.lit(0).alias("i"), F.lit(0.0).alias("rank"))

    def step(s: Column, e: Column) -> Column:
        here = F.struct(s["i"].alias("i"), e["p"].alias("p"))
        last = [F.when(e["w"].isin(g), here).otherwise(s[f"g{k}"]) for k, g in enumerate(groups)]
        low = F.least(*last) if len(last) > 1 else last[0]
        found = low["i"] > s["begin"]
        noise = (e["p"] - low["p"]) - (s["i"] - low["i"])
        return F.struct(
            *(x.alias(f"g{k}") for k, x in enumerate(last)),
            F.when(found, low["i"]).otherwise(s["begin"]).alias("begin"),
            (s["i"] + 1).alias("i"),
            (s["rank"] + F.when(found, F.lit(0.1) / (noise + 1)).otherwise(0.0)).alias("rank"),
        )

    return F.aggregate(entries, start, step, lambda s: s["rank"])


def query_groups(query: str) -> list[list[str]]:
    """The words of a search string that must occur, as groups of alternatives; words of a phrase are groups each."""
    groups: list[list[str]] = []
    alternative = False
    for negated, words in R.web_query(query):
        if negated:
            continue
        if words == ["or"]:
            alternative = True
            continue
        if alternative and groups and len(words) == 1:
            groups[-1] = groups[-1] + words
        else:
            groups += [[w] for w in words]
        alternative = False
    return groups


def keyword_ranked(chunks: DataFrame, id_column: str, text: str, query: str, limit: int) -> DataFrame:
    """``id, hits`` of the chunks that satisfy the search string, by cover density."""
    words = F.regexp_extract_all(F.lower(F.substring(F.col(text), 1, 200_000)), F.lit(r"[\p{L}\p{N}]+"), 0)
    found = chunks.where(R.boolean_search(F.col(text), query)).select(F.col(id_column).alias("id"), cover_density(words, query_groups(query)).alias("hits"))
    return found.orderBy(F.desc("hits"), "id").limit(min(max(limit, 1), 200))


def exact_terms(text: Column, limit: int = 36) -> Column:
    """Terms to match exactly, in the order of the patterns, each once whatever its case."""
    found = F.flatten(F.array(*(F.regexp_extract_all(text, F.lit(f"(?={p[: p.index(']') + 1]})" * p.startswith("[") + EDGE + p + EDGE), 0) for p in EXACT_TERMS)))
    fit = F.filter(found, lambda t: (F.length(t) >= 2) & (F.length(t) <= 80) & ~t.rlike(r"^\d+$") & ~t.rlike(PAGE_REFERENCE))
    tidy = F.filter(F.transform(fit, lambda t: F.trim(F.regexp_replace(t, r"\s+", " "))), lambda t: t != "")

    def first(ts: Column, keys: Column) -> Column:
        return F.transform(F.slice(F.array_distinct(keys), 1, limit), lambda k: F.get(ts, F.array_position(keys, k).cast("int") - 1))

    return let(tidy, lambda ts: let(F.transform(ts, F.lower), lambda keys: first(ts, keys)))


def structured_mode(question: Column, broad_terms: list[str], hints: Column) -> Column:
    """Whether a question is answered from structured coverage: two broad terms, or a question word and one, or a telling hint."""
    plain = comparable(question)
    hits = reduce(lambda a, b: a + b, (plain.contains(t).cast("int") for t in broad_terms))
    asked = plain.rlike(r"^(hva|hvilke|oppsummer|gi|vis|forklar)" + EDGE) & (hits >= 1)
    return (hits >= 2) | asked | F.exists(hints, lambda h: h.rlike("(?i)krav|arkitektur|leveranse|drift|kontrakt|risiko"))


def lexical(candidates: DataFrame, tokens: list[str], terms: list[str], fields: list[str]) -> Column:
    """A point for each token that the fields contain, five for each exact term."""
    haystack = F.lower(F.concat_ws(" ", *fields))
    points = [haystack.contains(t.lower()).cast("int") * w for ts, w in ((tokens, 1), (terms, 5)) for t in ts]
    return reduce(lambda a, b: a + b, points, F.lit(0))


def candidate_score(source: Column, rrf: Column, similarity: Column, lex: Column) -> Column:
    """The first score of a candidate, by where it was found."""
    near, fused = F.coalesce(similarity, F.lit(0.0)), F.coalesce(rrf, F.lit(0.0))
    return F.when(source == "hybrid", 120 * fused + 18 * near + lex).when(source == "vector", 28 * near + lex).otherwise(lex.cast("double"))


def kind_boost(kind: Column) -> Column:
    return reduce(lambda c, k: c.when(kind == k, KIND_BOOST[k]), list(KIND_BOOST)[1:], F.when(kind == "requirement", 3.0)).otherwise(0.0)


def fresh(chunks: DataFrame, sources: DataFrame) -> DataFrame:
    """Chunks whose stored fingerprint and its version are those of their source."""
    return chunks.join(sources, ["source_type", "source_id", "fingerprint", "fingerprint_version"], "left_semi")


def with_fallback(stored: DataFrame, memory: DataFrame, requested: DataFrame, stale: DataFrame) -> DataFrame:
    """Stored candidates, and those made in memory of the sources that were stale, or of all requested if nothing is stored."""
    none = stored.agg((F.count("*") == 0).alias("none"))
    wanted = requested.join(stale.select("source_type", "source_id").distinct().withColumn("stale", F.lit(True)), ["source_type", "source_id"], "left")
    wanted = wanted.join(F.broadcast(none)).where("none or stale").select("source_type", "source_id")  # one row
    return stored.unionByName(memory.join(wanted, ["source_type", "source_id"], "left_semi"))


def rerank(candidates: DataFrame, tokens: list[str], terms: list[str]) -> DataFrame:
    """The best of equal snippets, rescored by a focused look at reference, headings and text."""
    key = ["source_type", "source_id", "reference", F.sha2(F.substring("text", 1, 700), 256).alias("head")]
    best = candidates.groupBy(*key).agg(F.max_by(F.struct(*candidates.columns), F.struct("score", (-F.col("id")).alias("o"))).alias("row")).select("row.*")
    focused = lexical(best, tokens, terms, ["title", "reference", "heading", "text"])
    found = best.withColumn("_focus", focused)
    exact = F.least(F.col("_focus"), F.lit(6 * len(terms))) if terms else F.lit(0)
    hybrid = F.when(F.col("retrieval") == "hybrid", 180 * F.coalesce("rrf", F.lit(0.0))).otherwise(0.0)
    score = F.col("score") + 1.8 * F.col("_focus") + exact + kind_boost(F.col("kind")) + hybrid + 22 * F.coalesce("similarity", F.lit(0.0))
    return found.withColumns({"score": score, "lexical": F.greatest("lexical", "_focus")}).drop("_focus")


def assess(snippets: DataFrame, terms: list[str], threshold: float = 0.15) -> DataFrame:
    """One row on the snippets of an answer: counts, coverage of the exact terms, score, and whether they suffice."""
    low = F.lower(F.concat_ws(" ", "title", "reference", "text"))
    covered = reduce(lambda a, b: a + b, (F.coalesce(F.max(low.contains(t.lower()).cast("int")), F.lit(0)) for t in terms)) if terms else F.lit(1)
    counted = snippets.agg(
        F.coalesce(F.max("score"), F.lit(0.0)).alias("top_score"),
        F.count("*").alias("sources"),
        F.count_if(F.coalesce("similarity", F.lit(0.0)) >= threshold).alias("semantic_hits"),
        F.count_if(F.col("keyword_rank").isNotNull() | (F.col("lexical") > 0)).alias("keyword_hits"),
        F.countDistinct("source_type", "source_id").alias("documents"),
        (covered / max(len(terms), 1)).alias("coverage"),
    )
    parts = [F.least(F.col("top_score") / 6, F.lit(10)), *(F.least(F.col(c), F.lit(n)) for c, n in (("sources", 4), ("semantic_hits", 3), ("keyword_hits", 3), ("documents", 2))), F.col("coverage") * 4]
    scored = counted.withColumn("score", reduce(lambda a, b: a + b, parts))
    enough = (F.col("sources") > 0) & (F.col("score") >= 9) & (F.col("coverage") >= 0.4)
    return scored.withColumns({"sufficient": enough, "confidence": F.when(enough & (F.col("score") >= 18), "high").when(enough, "medium").otherwise("low")})


def nearest(chunks: DataFrame, vectors: DataFrame, limit: int = 10, block: int = 1024) -> DataFrame:
    """For each of ``vectors(query_id, v)`` the nearest ``chunks(id, v)``: ``query_id, id, similarity, rank``.

    Queries are taken in blocks of a fixed size, each a scan of the chunks; a task
    keeps its own best of every query, so that few rows are shuffled.
    """
    parts, held = [], []
    for row in vectors.toLocalIterator():
        held.append((row["query_id"], row["v"]))
        if len(held) == block:
            parts.append(_block_best(chunks, held, limit))
            held = []
    parts.append(_block_best(chunks, held, limit))
    found = reduce(DataFrame.unionByName, parts)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= limit)


def _block_best(chunks: DataFrame, queries: list[tuple], limit: int) -> DataFrame:
    ids = [i for i, _ in queries]
    wanted = np.array([v for _, v in queries], np.float64)
    wanted = wanted / np.linalg.norm(wanted, axis=1, keepdims=True) if ids else wanted

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list] = [[] for _ in ids]
        for b in batches:
            keys, v = np.asarray(b.column(0)), np.array(b.column(1).to_pylist(), np.float64)
            if not len(keys) or not ids:
                continue
            scores = np.round((v / np.linalg.norm(v, axis=1, keepdims=True)) @ wanted.T, 9)
            for i in range(len(ids)):
                order = np.lexsort((keys, -scores[:, i]))[: limit + 1]
                best[i] = sorted([*best[i], *zip((-scores[order, i]).tolist(), keys[order].tolist(), strict=True)])[: limit + 1]
        out = [(ids[i], k, -s) for i, found in enumerate(best) for s, k in found]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["query_id", "id", "similarity"])

    return map_arrow(chunks.select("id", "v"), run, "query_id long, id long, similarity double").where("id <> query_id")
