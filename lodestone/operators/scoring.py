"""Consistency of coverage, scores of extractions, value shares and gates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Assessments, and the least score of each band.
ASSESSMENTS = ["Godt", "Dårlig", "Mangler", "Uklart"]
BANDS = [(95, "Strong"), (85, "Usable"), (75, "Needs review")]
# Words of each value category, in order of precedence.
VALUE_CATEGORIES = [
    ("Redusert risiko", "risiko|sikkerhet|avbrudd|nedetid|kontroll|compliance|etterlevelse|robust|sårbar"),
    ("Lavere kostnader", "kost|kostnad|besparelse|økonomi|lisens|driftskost|finops|forbruk|reduser|reducer"),
    ("Bedre brukeropplevelse", "bruker|opplevelse|selvbetjening|tilgjengelighet|adopsjon|respons|kundeopplevelse"),
    ("Høyere produktivitet", "produktiv|effektiv|automatis|arbeidsflyt|prosess|kapasitet|tidsbruk|standardiser"),
]
# Patterns of texts that a parser broke.
MALFORMED = [
    ("truncated_control_requirement", "(?i)^Redegjør for kontrollmekanismer ved$"),
    ("truncated_describe_requirement", "(?i)^Leverandøren skal beskrive$"),
    ("truncated_authentication_requirement", "(?i)^Leverandøren bes beskrive løsning for$"),
    ("mid_sentence_requirement_start", r"(?i)^resultatet\."),
]
OMITTED_TAIL = "(?i)^(?:som|der|at|hvordan|hvorvidt|om|og|eller|samt|med|for|til|av)($|[^A-Za-z0-9_])"


def _filled(c: str) -> Column:
    return F.trim(F.coalesce(F.col(c), F.lit("")))


def self_consistency(heads: DataFrame, items: DataFrame) -> DataFrame:
    """``eval_id, code, idx`` of everything that contradicts itself in a coverage; idx is null for totals."""
    sums = heads.join(items.groupBy("eval_id").agg(F.count("*").alias("n")), "eval_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    totals = [("total_mismatch", "total"), ("assessed_mismatch", "assessed"), ("assessment_count_mismatch", "counted")]
    head = sums.select("eval_id", F.explode(F.array_compact(F.array(*[F.when(F.coalesce(F.col(c), F.lit(0)) != F.col("n"), F.lit(code)) for code, c in totals]))).alias("code"))
    identity = [F.lower(_filled(c)) for c in ("reference", "full_reference", "source_reference")]
    named = reduce(lambda a, b: a | b, (c != "" for c in identity))
    placed = items.withColumns(
        {
            "_named": named,
            "_identity": F.concat_ws("|", *identity),
            "_order_again": F.row_number().over(Window.partitionBy("eval_id", "order_index").orderBy("idx")) > 1,
        }
    )
    placed = placed.withColumn("_identity_again", F.row_number().over(Window.partitionBy("eval_id", "_identity").orderBy("idx")) > 1)
    rules = [
        ("order_index_mismatch", ~F.col("order_index").eqNullSafe(F.col("idx"))),
        ("duplicate_order_index", F.col("order_index").isNotNull() & F.col("_order_again")),
        ("duplicate_reference_identity", F.col("_named") & F.col("_identity_again")),
        ("missing_reference", _filled("reference") == ""),
        ("invalid_assessment", ~F.coalesce(F.col("assessment").isin(*ASSESSMENTS), F.lit(False))),
        *((f"missing_{c}", _filled(c) == "") for c in ("rationale", "evidence", "recommendation")),
        ("missing_with_matched_answer", (F.col("assessment") == "Mangler") & F.col("answer_document").isNotNull()),
    ]
    found = placed.select("eval_id", "idx", F.explode(F.array_compact(F.array(*[F.when(test, F.lit(code)) for code, test in rules]))).alias("code"))
    return head.select("eval_id", "code", F.lit(None).cast("int").alias("idx")).unionByName(found.select("eval_id", "code", F.col("idx").cast("int").alias("idx")))


def first_issues(issues: DataFrame, keys: list[str], order: list[str], n: int = 6) -> DataFrame:
    """The first issues of each group, for the message of a failed check."""
    return issues.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_k") <= n).drop("_k")


def percent(part: Column, whole: Column) -> Column:
    """Per cent to one decimal, halves up; 0 of nothing."""
    return F.when(whole == 0, 0.0).otherwise(F.floor(part / whole * 1000 + 0.5) / 10)


def ratio(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, 0.0).otherwise(part / whole)


def bucket_scores(documents: DataFrame, bucket: str) -> DataFrame:
    """Sums of the documents of each bucket as nine percentages, and the composite by which providers are ranked."""
    names = ["exact", "expected", "ordered", "strict", "aligned", "usable", "usable_ok", "made", "made_ok", "heading", "heading_ok", "located", "located_ok"]
    sums = documents.groupBy(bucket).agg(F.count("*").alias("documents"), *[F.sum(n).alias(n) for n in names])
    c = F.col
    ids, ids_ok = c("usable") + c("made"), c("usable_ok") + c("made_ok")
    parts = {
        "count_accuracy": (c("exact"), c("documents")), "ordered_text": (c("ordered"), c("expected")), "strict_recall": (c("strict"), c("expected")),
        "aligned_text": (c("aligned"), c("expected")), "usable_ids": (c("usable_ok"), c("usable")), "made_ids": (c("made_ok"), c("made")),
        "ids": (ids_ok, ids), "headings": (c("heading_ok"), c("heading")), "locators": (c("located_ok"), c("located")),
    }
    composite = 0.45 * ratio(c("strict"), c("expected")) + 0.25 * ratio(ids_ok, ids) + 0.25 * ratio(c("heading_ok"), c("heading")) + 0.05 * ratio(c("located_ok"), c("located"))
    return sums.select(bucket, "documents", *[percent(*p).alias(n) for n, p in parts.items()], composite.alias("composite"))


def entry_matches(rows: DataFrame) -> DataFrame:
    """``rows`` of expected and actual entries with whether id, heading and place agree.

    Columns: usable, expected_id, expected_mark, expected_kind, actual_id, excerpt, table_id, expected_heading, heading, pages.
    """
    tidy = lambda c: F.regexp_replace(F.upper(F.coalesce(F.col(c), F.lit(""))), r"[\s._-]+", "")
    actual = [tidy(c) for c in ("actual_id", "excerpt", "table_id")]
    exact = reduce(lambda a, b: a | b, ((e != "") & (e == a) for e in (tidy("expected_id"), tidy("expected_mark")) for a in actual))
    kind = tidy("expected_kind")
    made = (kind != "") & F.concat_ws(" ", *actual).contains(kind)
    key = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    heading, wanted = F.coalesce("heading", F.lit("")), key(F.coalesce("expected_heading", F.lit("")))
    under = (key(heading) == wanted) | F.array_contains(F.transform(F.split(heading, ">"), key), wanted)
    placed = reduce(lambda a, b: a | b, (_filled(c) != "" for c in ("excerpt", "heading", "table_id"))) | (F.coalesce(F.size("pages"), F.lit(0)) > 0)
    return rows.withColumns({"id_ok": F.when(F.col("usable"), exact).otherwise(made), "heading_ok": (wanted != "") & under, "located": placed})


def project_scores(heads: DataFrame, items: DataFrame, issues: DataFrame) -> DataFrame:
    """``eval_id, score, band`` of each evaluation, out of 100."""
    useful = reduce(lambda a, b: a & b, ((F.length(_filled(c)) >= 24) & ~_filled(c).rlike("(?i)^(ok|n/a|ikke vurdert)$") for c in ("rationale", "evidence", "recommendation")))
    referred = reduce(lambda a, b: a | b, (_filled(c) != "" for c in ("reference", "full_reference", "source_reference")))
    subtitled = F.length(_filled("full_reference")) >= 5
    own = items.groupBy("eval_id").agg(F.count("*").alias("n"), *[F.avg(t.cast("double")).alias(c) for c, t in (("useful", useful), ("referred", referred), ("subtitled", subtitled))])
    found = heads.join(own, "eval_id", "left").join(issues.groupBy("eval_id").agg(F.count("*").alias("issues")), "eval_id", "left")
    found = found.na.fill(0, ["n", "useful", "referred", "subtitled", "issues"])
    coverage = F.when(F.col("source_count") > 0, F.least(F.lit(1.0), F.least("total", "assessed", "n") / F.col("source_count"))).otherwise(0.0)
    raw = coverage * 25 + F.col("referred") * 15 + F.col("subtitled") * 10 + F.col("useful") * 20 + F.greatest(F.lit(0), 20 - 2 * F.col("issues")) + 10
    score = F.greatest(F.lit(0), F.least(F.lit(100), F.floor(raw + 0.5)))
    return found.select("eval_id", score.alias("score")).withColumn("band", band(F.col("score")))


def band(score: Column) -> Column:
    return reduce(lambda c, b: c.when(score >= b[0], b[1]), BANDS[1:], F.when(score >= BANDS[0][0], BANDS[0][1])).otherwise("Not ready")


def text_counters(text: Column) -> dict[str, Column]:
    """Counts of what betrays a broken text."""
    return {
        "mojibake": F.regexp_count(text, F.lit("Ã[¦¸¥†˜…]|�")),
        "space_before": F.regexp_count(text, F.lit(r"\s+[,.;:!?]")),
        "space_missing": F.regexp_count(text, F.lit(r"[;,!?](?=[\p{L}\p{N}])|\.(?=\p{Lu})")),
    }


def lint(entries: DataFrame) -> DataFrame:
    """``id, code`` of ``entries(id, text, excerpt)`` that a parser broke, or cut short of their source."""
    text, low = F.col("text"), F.lower("excerpt")
    at = F.position(F.lower(text), low)
    tail = F.ltrim(F.substring(F.col("excerpt"), at + F.length(text), F.length("excerpt")))
    codes = [F.when(text.rlike(p), F.lit(code)) for code, p in MALFORMED] + [F.when((text != "") & (at > 0) & tail.rlike(OMITTED_TAIL), F.lit("requirement_source_tail_omitted"))]
    return entries.select("id", F.explode(F.array_compact(F.array(*codes))).alias("code"))


def value_category(text: Column) -> Column:
    """The category of a value opportunity, the first whose words occur."""
    low = F.lower(text)
    return reduce(lambda c, x: c.when(low.rlike(x[1]), x[0]), VALUE_CATEGORIES[1:], F.when(low.rlike(VALUE_CATEGORIES[0][1]), VALUE_CATEGORIES[0][0])).otherwise(VALUE_CATEGORIES[0][0])


def value_shares(items: DataFrame, keys: list[str]) -> DataFrame:
    """Shares of ``items(keys, category, share)`` by category, in whole per cent of at least one, that add up to 100.

    Four categories a group at most: rounding errors are taken up in turn, by those that may still lose one.
    """
    order = F.array(*[F.lit(c) for c, _ in VALUE_CATEGORIES])
    sums = items.groupBy(*keys, "category").agg(F.sum("share").alias("share"))
    ranked = sums.withColumn("_o", F.array_position(order, F.col("category")))
    every = Window.partitionBy(*keys)
    total, n = F.sum("share").over(every), F.count("*").over(every)
    first = F.when(total > 0, F.greatest(F.lit(1), F.floor(F.col("share") / total * 100 + 0.5))).otherwise(F.floor(100 / n)).cast("long")
    rows = ranked.withColumn("p", first).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_o", "category", "p"))).alias("r"))
    ps = F.transform("r", lambda x: x["p"])
    start = F.struct(ps.alias("ps"), (100 - F.aggregate(ps, F.lit(0).cast("long"), lambda a, x: a + x)).alias("off"))

    def step(s: Column, i: Column) -> Column:
        at = i % F.size(s["ps"])
        sign = F.when(s["off"] > 0, 1).when((s["off"] < 0) & (F.get(s["ps"], at) > 1), -1).otherwise(0)
        return F.struct(F.transform(s["ps"], lambda p, k: F.when(k == at, p + sign).otherwise(p)).alias("ps"), (s["off"] - sign).alias("off"))

    fixed = F.aggregate(F.sequence(F.lit(0), F.lit(39)), start, step, lambda s: s["ps"])
    done = rows.select(*keys, F.explode(F.arrays_zip("r", fixed.alias("ps"))).alias("z"))
    return done.select(*keys, F.col("z.r.category").alias("category"), F.col("z.ps").alias("share"))


def gates(rounds: DataFrame) -> DataFrame:
    """One row on ``rounds(current_score, main_score, current_facts, main_facts, current_ms, main_ms)``: wins, losses, ties and the gates."""
    d = F.col("current_score") - F.col("main_score")
    a = rounds.agg(
        F.count_if(d > 0).alias("wins"), F.count_if(d < 0).alias("losses"), F.count_if(d == 0).alias("ties"),
        *[F.avg(c).alias(c) for c in rounds.columns], *[F.when(F.count(c) < 2, 0.0).otherwise(F.stddev_pop(c)).alias(f"{c}_dev") for c in ("current_score", "main_score")],
    )
    speed = (F.col("current_ms") / F.col("main_ms") - 1) * 100
    better = (F.col("current_score") > F.col("main_score")) & (F.col("wins") >= F.col("losses")) & (F.col("current_facts") >= F.col("main_facts"))
    return a.select("wins", "losses", "ties", better.alias("better"), (speed <= 5).alias("fast_enough"), (F.col("current_score_dev") <= F.col("main_score_dev") + 5).alias("stable"))
