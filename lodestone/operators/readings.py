"""How well a document was read, what kind it is, and how it is shown: small rules over whole tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.language import EDGE
from lodestone.functions.text import compared
from lodestone.operators.search import exact_terms

# What marks a corpus, a requirement and a boilerplate line.
CORPUS_MARKERS = [
    r"Krav\s+registrert\s+i\s+tabell", r"Punktkrav\s+som\s+skal\s+besvares", r"Krav\s+uten\s+egen\s+tabellrad",
    r"Notater\s+som\s+skal\s+tolkes\s+som\s+krav", r"Avklaringer/innspill\s+som\s+inngår\s+i\s+kravbildet", r"ID\s*/\s*markering\s+Prioritet\s+Kravtekst",
]
REQUIREMENT_TERMS = r"(?:krav|kravspesifikasjon|skal|må|shall|must|requirement|requirements)"
REQUIREMENT_ID = r"[A-ZÆØÅ]{1,8}-?\d{1,5}(?:\.\d+)*"
BOILERPLATE = [r"^Bilag\s+2", r"^Kunde\s*:", r"^Prosjektkode\s*:", r"^Kravene\s+er\s+hentet", r"^Dersom\s+et\s+krav", r"^Denne\s+delen", r"^Tabell\s+\d{1,4}", r"^Rad\s+\d{1,4}\s*:"]


def poor_extraction(text: Column, size: Column, most: int = 600) -> Column:
    """Nothing, little from a large file, or a long text of few letters."""
    body = F.trim(text)
    letters = F.regexp_count(body, F.lit("[A-Za-zÆØÅæøå]")) / F.length(body)
    return (body == "") | ((size >= 250_000) & (F.length(body) < most)) | ((F.length(body) >= 400) & (letters < 0.35))


def tables_or_requirements(text: Column) -> Column:
    """Three lines like a table's, eight requirement words, or three identifiers."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(x))
    like = F.filter(lines, lambda x: (F.size(F.split(x, r"\|")) >= 3) | x.rlike(r"\S+\s{2,}\S+\s{2,}\S+"))
    terms = F.regexp_count(text, F.lit(f"(?iu){EDGE}{REQUIREMENT_TERMS}{EDGE}"))
    ids = F.regexp_count(text, F.lit(f"{EDGE}{REQUIREMENT_ID}{EDGE}"))
    return (F.size(like) >= 3) | (terms >= 8) | (ids >= 3)


def is_corpus(text: Column, least: int = 3) -> Column:
    """Whether enough of the corpus' markers occur."""
    return reduce(lambda a, b: a + b, (text.rlike(f"(?iu){EDGE}{p}").cast("int") for p in CORPUS_MARKERS)) >= least


def is_boilerplate(line: Column) -> Column:
    """Lines of a form that say nothing of a requirement."""
    return (line == "") | reduce(lambda a, b: a | b, (line.rlike(f"(?iu){p}") for p in BOILERPLATE))


def better_parse(parses: DataFrame, key: str) -> DataFrame:
    """``parses(chars, score, entries, has_table)`` 0 and 1 of each document side by side, and whether the second is taken.

    It must keep 55 per cent of the text, lose no more than .05 of the score, and gain structure or score.
    """
    now, new = (parses.where(F.col("attempt") == i).select(key, *[F.col(c).alias(f"{c}{i}") for c in ("chars", "score", "entries", "has_table")]) for i in (0, 1))
    keeps = (F.col("chars0") < 2000) | (F.col("chars1") >= F.col("chars0") * 0.55)
    gains = (F.col("entries1") > F.col("entries0")) | F.col("has_table1") | (F.col("score1") > F.col("score0"))
    return now.join(new, key).select(key, (keeps & (F.col("score1") >= F.col("score0") - 0.05) & gains).alias("taken"))


def bounded_context(text: Column, limit: int, marker: str = "[avkortet]") -> Column:
    """The text, or as much of it as leaves room for a line that says it was cut."""
    body = F.trim(text)
    cut = F.concat(F.rtrim(F.substring(body, 1, max(0, limit - len(marker) - 2))), F.lit("\n" + marker))
    return F.when(F.length(body) <= limit, body).otherwise(cut)


def signal_words(words: Column, allowed: str, denied: str, limit: int = 12) -> Column:
    """The words that name technology, each once whatever its case, in order."""
    tidy = F.filter(F.transform(words, lambda w: F.trim(F.regexp_replace(w, r"\s+", " "))), lambda w: (w != "") & w.rlike(allowed) & ~w.rlike(denied))
    keys = F.transform(tidy, lambda w: F.lower(w))
    once = F.filter(F.transform(tidy, lambda w, i: F.struct(w.alias("w"), (F.array_position(keys, F.lower(w)) == i + 1).alias("first"))), lambda s: s["first"])
    return F.slice(F.transform(once, lambda s: s["w"]), 1, limit)


def page_label(first: Column, last: Column) -> Column:
    """``side 3`` or ``side 3-5``; empty without a page."""
    return F.when(first.isNull(), "").when(last.isNull() | (first == last), F.concat(F.lit("side "), first.cast("string"))).otherwise(F.concat(F.lit("side "), first.cast("string"), F.lit("-"), last.cast("string")))


def source_label(parts: list[Column]) -> Column:
    """The parts that say something, with commas between."""
    return F.array_join(F.filter(F.array(*[F.trim(F.coalesce(p, F.lit(""))) for p in parts]), lambda x: x != ""), ", ")


def contained(items: DataFrame, sources: DataFrame, keys: list[str]) -> DataFrame:
    """Items that meet the source row of their place, with whether one text holds the other: ``keys, matches``."""
    a, b = items.select(*keys, compared(F.regexp_replace("text", r"\s*(…|\.{3})$", "")).alias("a")), sources.select(*keys, compared(F.col("text")).alias("b"))
    same = (F.col("a") != "") & (F.col("b") != "") & (F.contains("a", F.col("b")) | F.contains("b", F.col("a")))
    return a.join(b, keys, "left").select(*keys, F.coalesce(same, F.lit(False)).alias("matches"))


def inventory_state(expected: DataFrame, actual: DataFrame, key: str, order: str, item: str) -> DataFrame:
    """``key, state``: empty, in_order, all_there or deficient, of what ``actual`` has of ``expected``.

    Compared by place and by counts of equal items, so no list is gathered.
    """
    place = Window.partitionBy(key).orderBy(order)
    e, a = (x.select(key, F.col(item).alias("item"), F.row_number().over(place).alias("place")) for x in (expected, actual))
    moved = e.join(a.withColumnRenamed("item", "other"), [key, "place"], "full").groupBy(key).agg(F.count_if(~F.col("item").eqNullSafe(F.col("other"))).alias("moved"), F.count("other").alias("n"))
    counts = [x.groupBy(key, "item").agg(F.count("*").alias(n)) for x, n in ((e, "e"), (a, "a"))]
    short = counts[0].join(counts[1], [key, "item"], "full").groupBy(key).agg(F.sum(F.greatest(F.coalesce("e", F.lit(0)) - F.coalesce("a", F.lit(0)), F.lit(0))).alias("short"))
    state = F.when(F.col("n") == 0, "empty").when(F.col("moved") == 0, "in_order").when(F.col("short") == 0, "all_there").otherwise("deficient")
    return moved.join(short, key).select(key, state.alias("state"))


def ledger_context(rows: DataFrame, key: str, order: list[str], label: str, text: str, most: int, chars: int = 420) -> DataFrame:
    """``key, context``: the first rows of each ledger as lines, long texts cut, with how many were left out."""
    line = F.concat(F.lit("- "), label, F.lit(": "), F.substring(text, 1, chars)).alias("_l")  # only what is shown is shuffled and sorted
    placed = rows.select(key, *[c for c in order if c != key], line).withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    kept = placed.where(F.col("_k") <= most).groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_k", F.col("_l").alias("l")))), lambda x: x["l"]), "\n").alias("context"))
    total = rows.groupBy(key).agg(F.count("*").alias("_n"))
    rest = F.when(F.col("_n") > most, F.concat(F.lit("\n… "), (F.col("_n") - most).cast("string"), F.lit(" til"))).otherwise("")
    return kept.join(total, key).select(key, F.concat("context", rest).alias("context"))


def retrieval_seed(name: Column, question: Column, buckets: Column, signals: Column, limit: int = 2400, terms: int = 36) -> Column:
    """``query`` and ``terms`` of a search: names, buckets and the first 24 signals, and the exact terms in them."""
    parts = F.filter(F.array(name, F.coalesce(question, F.lit("")), buckets, F.array_join(F.slice(signals, 1, 24), "\n")), lambda x: x != "")
    flat = F.trim(F.regexp_replace(F.array_join(parts, "\n\n"), r"\s+", " "))
    cut = F.when(F.length(flat) <= limit, flat).otherwise(F.concat(F.trim(F.substring(flat, 1, limit - 1)), F.lit("…")))
    return F.struct(cut.alias("query"), exact_terms(F.concat_ws("\n", name, question, F.array_join(signals, "\n")), terms).alias("terms"))
