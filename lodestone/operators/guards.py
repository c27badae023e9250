"""Guards on coverage assessments and answers, on generated documents, and stateful services as batches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Vocabularies: what an answer says when it declines, points elsewhere, or says no more than yes or no.
DECLINES = r"(?i)(kan ikke|vil ikke|leveres ikke|støttes ikke|not supported|cannot)"
ATTACHMENT = r"(?i)^\s*(se|jf\.?|see)\s+(vedlegg|bilag|attachment)[\s0-9.,]*$"
BARE = r"(?i)^\s*(ja|nei|yes|no|ok|n/a|-|x|)\s*[.!]?\s*$"
# Rules: families of weak requirement answers.
ANSWER_ISSUES = [
    ("hedging", r"(?i)(normalt|så langt det er mulig|tilstreber|vil forsøke|as far as possible)"),
    ("deferred_scope", r"(?i)(avklares senere|i dialog med|etter nærmere avtale|to be agreed)"),
    ("api_contract", r"(?i)(api)(?!.*(openapi|versjon|kontrakt))"),
    ("export_format", r"(?i)(eksport)(?!.*(csv|json|xml|xlsx|pdf))"),
    ("retry_idempotency", r"(?i)(integrasjon)(?!.*(retry|idempoten|gjenforsøk))"),
    ("access_scope", r"(?i)(tilgang)(?!.*(rolle|gruppe|minste))"),
]
# What is a dated start of production.
GO_LIVE = r"(?i)(?:go-live|produksjonssetting|driftsstart|oppstart)"
DATE = r"(?:\d{1,2}\.\d{1,2}\.20\d{2}|20\d{2}-\d{2}-\d{2})"


def corrected_assessment(assessment: Column, answer: Column, mandatory: Column) -> Column:
    """An assessment held against its answer: none is Mangler, a mandatory one declined is Dårlig, a mere pointer Uklart; never better than it was."""
    text = F.trim(F.coalesce(answer, F.lit("")))
    return (
        F.when(text == "", "Mangler")
        .when(mandatory & text.rlike(DECLINES), "Dårlig")
        .when(text.rlike(ATTACHMENT) & (assessment == "Godt"), "Uklart")
        .otherwise(assessment)
    )


def complete_evidence(rows: DataFrame, keys: list[str], answer: str) -> DataFrame:
    """Whether every row of a batch has an answer of substance."""
    return rows.groupBy(*keys).agg(F.bool_and(~F.coalesce(F.col(answer), F.lit("")).rlike(BARE)).alias("complete"))


def batch_errors(expected: DataFrame, returned: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, nr, code`` where ``returned(nr, reference)`` differs from ``expected``: missing, swapped, duplicate, extra, without reference."""
    counted = returned.groupBy(*keys, "nr").agg(F.count("*").alias("n"), F.min("reference").alias("got"), F.count_if(F.trim(F.coalesce("reference", F.lit(""))) == "").alias("blank"))
    both = expected.select(*keys, "nr", F.col("reference").alias("wanted"), F.lit(True).alias("asked")).join(counted, [*keys, "nr"], "full")
    known = expected.select(*keys, F.col("reference").alias("got"), F.lit(True).alias("elsewhere")).distinct()
    joined = both.join(known, [*keys, "got"], "left")
    code = (
        F.when(F.col("n").isNull(), "missing")
        .when(F.col("asked").isNull(), "extra")
        .when(F.col("n") > 1, "duplicate")
        .when(F.col("blank") > 0, "without_reference")
        .when((F.col("got") != F.col("wanted")) & F.col("elsewhere"), "swapped")
        .when(F.col("got") != F.col("wanted"), "unknown_reference")
    )
    return joined.select(*keys, "nr", code.alias("code")).where("code is not null")


def relinked(findings: DataFrame, coverage: DataFrame, keys: list[str]) -> DataFrame:
    """``findings(finding_id, evidence)`` with the one ``coverage(idx, evidence)`` row of its key whose words it quotes, else ``section``.

    An evidence text in quotes, or with ``...`` for what is left out, matches
    where its pieces stand in order. Rows meet by the first words of the first
    piece, so no finding is compared with every row.
    """
    clean = F.trim(F.regexp_replace("evidence", '["«»“”]', ""))
    pieces = F.filter(F.transform(F.split(clean, r"\.\.\.|…"), lambda x: F.trim(x)), lambda p: p != "")
    words = lambda c: F.regexp_extract(F.lower(c), r"([\p{L}\p{N}]+\s+[\p{L}\p{N}]+\s+[\p{L}\p{N}]+)", 1)
    asked = findings.select(*keys, "finding_id", F.transform(pieces, F.lower).alias("_p")).withColumn("_head", words(F.get("_p", F.lit(0)))).where("_head <> ''")
    spots = F.regexp_extract_all(F.lower("evidence"), F.lit(r"(?=([\p{L}\p{N}]+\s+[\p{L}\p{N}]+\s+[\p{L}\p{N}]+))\b"), 1)
    rows = coverage.select(*keys, "idx", F.lower("evidence").alias("_e"), F.explode(F.array_distinct(spots)).alias("_head"))
    # Each piece is sought from behind the one before, 0 being none found: a pattern made for every pair would be compiled for every pair.
    spot = lambda at, p: F.position(p, F.col("_e"), at)
    found = F.aggregate("_p", F.lit(1), lambda at, p: F.when((at > 0) & (spot(at, p) > 0), spot(at, p) + F.length(p)).otherwise(0)) > 0
    met = asked.join(rows, [*keys, "_head"]).where(found).groupBy(*keys, "finding_id").agg(F.countDistinct("idx").alias("n"), F.min("idx").alias("idx"))
    joined = findings.join(met, [*keys, "finding_id"], "left")
    return joined.select(*keys, "finding_id", F.when(F.col("n") == 1, F.col("idx")).alias("idx"), F.when(F.col("n") == 1, "requirement").otherwise("section").alias("link"))


def evaluation_result(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """``rows(architect, consultant, good, total)``: rounded scores, architect's held to what exact coverage bears, the winner by them, and a dense order."""
    bound = F.when(F.col("total") > 0, F.floor(100 * F.col("good") / F.col("total") + 0.5)).otherwise(100)
    a, b = F.least(F.floor(F.col("architect") + 0.5), bound), F.floor(F.col("consultant") + 0.5)
    winner = F.when(a > b, "Arkitekt").when(a < b, "Konsulent").otherwise("Uavgjort")
    scored = rows.withColumns({"architect_score": a.cast("long"), "consultant_score": b.cast("long"), "winner": winner})
    return scored.withColumn("order_index", F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1)


def evidence_excerpt(answer: Column, limit: int = 600) -> Column:
    """An exact prefix of the answer, by code points, so no character is split."""
    return F.substring(answer, 1, limit)


def reused_answers(rows: DataFrame, scope: list[str], text: str, order: str, accepted: Column) -> DataFrame:
    """``rows`` with ``donor``: the first row with the same text in the same scope whose answer is accepted, for rows without one of their own."""
    donors = rows.where(accepted).groupBy(*scope, text).agg(F.min(order).alias("donor"))
    joined = rows.withColumn("_own", accepted).join(donors, [*scope, text], "left")
    return joined.withColumn("donor", F.when(~F.col("_own"), F.col("donor"))).drop("_own")


def answer_issues(answers: DataFrame, text: str) -> DataFrame:
    """One row for each family of weakness that an answer shows."""
    codes = F.array_compact(F.array(*[F.when(F.col(text).rlike(p), F.lit(c)) for c, p in ANSWER_ISSUES]))
    return answers.withColumn("code", F.explode(codes))


def source_exclusive(chunks: DataFrame, documents: DataFrame, services: DataFrame) -> DataFrame:
    """``chunk_id, code`` of chunks that name both or neither source, or one that is not there."""
    both = F.col("document_id").isNotNull().cast("int") + F.col("service_id").isNotNull().cast("int")
    shape = chunks.where(both != 1).select("chunk_id", F.lit("one_source_only").alias("code"))
    one = chunks.where(both == 1)
    lost = [one.where(f"{c} is not null").join(t.select(c), c, "left_anti").select("chunk_id", F.lit(f"{c}_missing").alias("code")) for c, t in (("document_id", documents), ("service_id", services))]
    return reduce(DataFrame.unionByName, lost, shape)


def reference_variants(reference: Column) -> Column:
    """The forms under which a reference may be named: as it stands, without spaces, its last part, its number."""
    tidy = F.upper(F.trim(F.regexp_replace(reference, r"\s+", " ")))
    forms = F.array(tidy, F.replace(tidy, F.lit(" "), F.lit("")), F.regexp_extract(tidy, r"([^ /]+)$", 1), F.regexp_extract(tidy, r"(\d+(?:[.-]\d+)*)$", 1))
    return F.array_distinct(F.filter(forms, lambda x: x != ""))


def empty_sections(lines: DataFrame, doc: str, order: str, line: str, is_heading: Column) -> DataFrame:
    """Headings that nothing but another heading, or the end, follows."""
    w = Window.partitionBy(doc).orderBy(order)
    marked = lines.withColumn("_h", is_heading)
    marked = marked.withColumn("_next", F.lead("_h").over(w))
    return marked.where(F.col("_h") & F.coalesce("_next", F.lit(True))).select(doc, order, line)


def without_contents(lines: DataFrame, line: str) -> DataFrame:
    """Lines without those of a table of contents."""
    return lines.where(~F.col(line).rlike(r"\.{4,}\s*\d{1,4}\s*$"))


def milestones_missing(text: Column, needed: int = 3) -> Column:
    """Whether a plan names a dated start of production, 80 characters before to 160 behind, but too few dated milestones."""
    dated = text.rlike(f"(?s){DATE}.{{0,80}}{GO_LIVE}|{GO_LIVE}.{{0,160}}{DATE}")
    return dated & (F.regexp_count(text, F.lit(DATE)) < needed)


def readiness(documents: DataFrame) -> DataFrame:
    """``id, code`` of documents that can't be used: not ready, or nothing to read."""
    status = F.when(~F.col("processing_status").isin("basic_ready", "enhanced_ready"), F.lit("not_ready"))
    empty = F.when(F.trim(F.coalesce("text", F.lit(""))) == "", F.lit("no_text"))
    return documents.select("id", F.explode(F.array_compact(F.array(status, empty))).alias("code"))


def lease_lapses(beats: DataFrame, key: str, at: str, ttl: int) -> DataFrame:
    """``key, at, lapsed`` for each heartbeat: whether the lease had run out before it (``ttl`` seconds since the last)."""
    since = F.unix_timestamp(at) - F.unix_timestamp(F.lag(at).over(Window.partitionBy(key).orderBy(at)))
    return beats.select(key, at, F.coalesce(since > ttl, F.lit(False)).alias("lapsed"))


def cached_at(entries: DataFrame, as_of: Column, ttl: int, capacity: int, shards: int = 16) -> DataFrame:
    """The newest ``capacity`` entries written within ``ttl`` seconds before ``as_of``, the last write of each key.

    Each shard keeps its own newest first, so that no one task sorts all.
    """
    live = entries.where((F.col("at") <= as_of) & (F.unix_timestamp(as_of) - F.unix_timestamp("at") < ttl))
    last = live.groupBy("key").agg(F.max_by("value", F.struct("at", "value")).alias("value"), F.max("at").alias("at"))
    return last.orderBy(F.desc("at"), "key").limit(capacity)


def layered_limit(hits: DataFrame, limit: int, reduced: int) -> DataFrame:
    """``hits(user_id, window, ts, store_up)`` with the layer that decided and whether the hit passes.

    A hit over the limit stops in memory; else the store decides by the same
    limit while it is up; while it is down a smaller limit holds.
    """
    w = Window.partitionBy("user_id", "window").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    n, down = F.count("*").over(w), F.count_if(~F.col("store_up")).over(w)
    layer = F.when(n > limit, "memory").when(F.col("store_up"), "store").otherwise("fallback")
    return hits.withColumns({"layer": layer, "allowed": F.when(n > limit, False).when(F.col("store_up"), True).otherwise(down <= reduced)})


def audited_once(events: DataFrame, keys: list[str], attempt: str) -> DataFrame:
    """One row an event, its first attempt; a later one with the same key counts as done, not as an error."""
    return events.groupBy(*keys).agg(F.min_by(F.struct(*events.columns), attempt).alias("row"), F.count("*").alias("attempts")).select("row.*", "attempts")


def status_durations(rows: DataFrame, key: str, started: str, ended: str, deadline: int) -> DataFrame:
    """Whether each piece of work ended within its deadline, in seconds."""
    took = F.unix_timestamp(ended) - F.unix_timestamp(started)
    return rows.select(key, took.alias("seconds"), (took > deadline).alias("late"))
