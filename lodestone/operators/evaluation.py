"""Scores of extractions, coverage and integrity of assessments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def precision_recall(expected: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Counts and ratios of expected and found keys; duplicates are counted apart."""
    e, f = expected.groupBy(key).agg(F.count("*").alias("e")), found.groupBy(key).agg(F.count("*").alias("f"))
    both = e.join(f, key, "full")
    counts = both.agg(
        F.count(F.when(F.col("e").isNotNull() & F.col("f").isNotNull(), 1)).alias("matched"),
        F.count(F.when(F.col("f").isNull(), 1)).alias("missing"),
        F.count(F.when(F.col("e").isNull(), 1)).alias("unexpected"),
        F.coalesce(F.sum(F.when(F.col("f") > 1, F.col("f") - 1)), F.lit(0)).alias("duplicates"),
    )
    p = F.when(F.col("matched") + F.col("unexpected") > 0, F.col("matched") / (F.col("matched") + F.col("unexpected"))).otherwise(0.0)
    r = F.when(F.col("matched") + F.col("missing") > 0, F.col("matched") / (F.col("matched") + F.col("missing"))).otherwise(0.0)
    rated = counts.withColumns({"precision": F.round(p, 6), "recall": F.round(r, 6)})
    f1 = F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0)
    return rated.withColumn("f1", F.round(f1, 5))


def fact_status(text: Column, groups: list[list[str]]) -> Column:
    """present if every group has a term in the text, missing if none has, partial otherwise."""
    low = F.lower(text)
    met = []
    for group in groups:
        test = F.lit(False)
        for term in group:
            test = test | low.contains(term.lower())
        met.append(test.cast("int"))
    total = sum(met[1:], met[0])
    return F.when(total == len(groups), "present").when(total == 0, "missing").otherwise("partial")


def token_recall(expected: Column, parsed: Column) -> Column:
    """Share of the expected tokens, repeats counted, that are among the parsed; 1 where none is expected."""
    hit = F.size(F.filter(expected, lambda w: F.array_contains(parsed, w)))
    return F.when(F.size(expected) > 0, hit / F.size(expected)).otherwise(1.0)


def coverage_counters(rows: DataFrame, keys: list[str], claimed: str, assessed: Column) -> DataFrame:
    """Total, assessed, percent and status of each group's coverage, against the total that it claims."""
    found = rows.groupBy(*keys).agg(F.max(claimed).alias("claimed"), F.count("*").alias("items"), F.count(F.when(assessed, 1)).alias("assessed"))
    total = F.greatest("claimed", "items")
    status = F.when(F.col("claimed") != F.col("items"), "inconsistent").when(F.col("assessed") == total, "complete").otherwise("incomplete")
    percent = F.when(total > 0, F.floor(F.col("assessed") * 100 / total + 0.5)).otherwise(0).cast("long")
    return found.withColumns({"total": total, "percent": percent, "status": status})


def integrity_issues(items: DataFrame, source: DataFrame) -> DataFrame:
    """``items(doc, idx, ref, text, assessment, evidence)`` against ``source(doc, idx, ref, text)``: one row an issue, ``doc, idx, code``."""
    seen = Window.partitionBy("doc", "ref").orderBy("idx")
    own = items.withColumn("again", F.row_number().over(seen) > 1)
    joined = own.join(source.select("doc", "idx", F.col("ref").alias("sref"), F.col("text").alias("stext")), ["doc", "idx"], "left")
    rules = [
        ("invented_item", F.col("sref").isNull()),
        ("invented_reference", F.col("sref").isNotNull() & (F.col("ref") != F.col("sref"))),
        ("requirement_text_mismatch", F.col("stext").isNotNull() & (F.col("text") != F.col("stext"))),
        ("missing_reference", F.col("ref").isNull() | (F.col("ref") == "")),
        ("duplicate_reference_identity", F.col("again")),
        ("invalid_assessment", ~F.coalesce(F.col("assessment").isin("good", "weak", "missing"), F.lit(False))),
        ("good_without_evidence", (F.col("assessment") == "good") & (F.coalesce("evidence", F.lit("")) == "")),
    ]
    codes = F.array_compact(F.array(*[F.when(test, F.lit(code)) for code, test in rules]))
    found = joined.select("doc", "idx", F.explode(codes).alias("code"))
    lost = source.join(items.select("doc", "idx"), ["doc", "idx"], "left_anti").select("doc", "idx", F.lit("missing_item").alias("code"))
    return found.unionByName(lost)


def bind_answers(rows: DataFrame, answers: DataFrame, ways: list[list[str]]) -> DataFrame:
    """``row_id, answer_id, way``: each way is an equi-join on some columns that binds only where both sides are unique."""
    left, right = rows, answers
    bound = None
    for i, keys in enumerate(ways):
        unique = [x.where(" and ".join(f"{k} is not null" for k in keys)).groupBy(*keys).agg(F.count("*").alias("n"), F.min(name).alias(name)).where("n = 1").drop("n") for x, name in ((left, "row_id"), (right, "answer_id"))]
        part = unique[0].join(unique[1], keys).select("row_id", "answer_id", F.lit(i + 1).alias("way"))
        bound = part if bound is None else bound.unionByName(part)
        left, right = left.join(part, "row_id", "left_anti"), right.join(part, "answer_id", "left_anti")
    return bound


def ledger_dedupe(rows: DataFrame) -> DataFrame:
    """The first of rows that repeat a document, identifier, text and position."""
    key = ["doc", "ref", "text", "entry_order"]
    return rows.groupBy(*key).agg(F.min("row_id").alias("row_id"))


def batches(rows: DataFrame, key: str, order: str, size: Column, max_rows: int, budget: int) -> DataFrame:
    """Batches in order, none above ``max_rows`` rows or ``budget`` of size: a fold over each group's ordered sizes."""
    entry = F.struct(F.col(order).alias("o"), size.cast("long").alias("s"))
    ordered = rows.groupBy(key).agg(F.array_sort(F.collect_list(entry)).alias("xs"))
    zero = F.struct(F.lit(0).alias("batch"), F.lit(0).alias("n"), F.lit(0).cast("long").alias("used"), F.array().cast("array<int>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        fits = (a["n"] < max_rows) & ((a["used"] + x["s"] <= budget) | (a["n"] == 0))
        batch = F.when(fits, a["batch"]).otherwise(a["batch"] + 1)
        return F.struct(
            batch.alias("batch"), F.when(fits, a["n"] + 1).otherwise(1).alias("n"), F.when(fits, a["used"] + x["s"]).otherwise(x["s"]).alias("used"), F.concat(a["out"], F.array(batch)).alias("out")
        )

    folded = ordered.select(key, "xs", F.aggregate("xs", zero, step, lambda a: a["out"]).alias("out"))
    return folded.select(key, F.inline(F.arrays_zip(F.transform("xs", lambda x: x["o"]).alias("o"), F.col("out")))).select(key, F.col("o").alias(order), F.col("out").alias("batch"))
