"""Predicates and projections over rows of documents and projects."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns over a document's title and file name, after dashes and underscores became spaces.
START, STOP = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
REQUIREMENT_SOURCE = r"(?:bilag\s*[12]|krav[\p{L}\d_-]*|requirements?|konkurransegrunnlag|rfp)"
STRONG_REQUIREMENT_SOURCE = r"(?:bilag\s*1|krav[\p{L}\d_-]*|requirements?|konkurransegrunnlag|rfp)"
CERTAIN_REQUIREMENT_SOURCE = r"(?:bilag\s*1|krav\s*(?:[-–—_:]\s*)?(?:spesifikasjon|dokument|grunnlag)|requirements?\s*(?:[-–—_:]\s*)?(?:specification|document|baseline)|konkurransegrunnlag|rfp)"
SOLUTION_RESPONSE = r"(?:krav\s*(?:[-–—_:]\s*)?(?:(?:og|&)\s*)?(?:svar|besvarelse|respons)|requirements?\s*(?:[-–—_:]\s*)?(?:response|answers?)|l[øo]snings\s*(?:[-–—_:]\s*)?besvarelse|solution\s*(?:[-–—_:]\s*)?response|tender\s*(?:[-–—_:]\s*)?response)"
# Names that stand for none, and the states of a project.
PROJECT_PLACEHOLDERS = ["", "ny analyse", "nytt prosjekt"]
CUSTOMER_PLACEHOLDERS = ["", "kunde ikke satt"]
READY = ["basic_ready", "enhanced_ready"]


def optional(df: DataFrame, **wanted) -> DataFrame:
    """The rows that equal every wanted value; None filters nothing."""
    given = [F.col(c) == v for c, v in wanted.items() if v is not None]
    return reduce(lambda d, test: d.where(test), given, df)


def without_keys(json: Column, *keys: str) -> Column:
    """A flat JSON object without the keys, for comparing rows that differ in them alone."""
    return F.to_json(F.map_filter(F.from_json(json, "map<string,string>"), lambda k, _: ~k.isin(*keys)))


# Keys whose values nobody should read.
SECRET_KEYS = "(?i)(code|token|secret|password|prompt|content|raw|base64|authorization|cookie)"


def sanitized(json: Column, keys: int = 30, length: int = 500) -> Column:
    """A flat JSON object with secret values hidden, long ones cut, and no more than so many keys."""
    entries = F.slice(F.map_entries(F.from_json(json, "map<string,string>")), 1, keys)
    clean = lambda e: F.struct(e["key"].alias("key"), F.when(e["key"].rlike(SECRET_KEYS), "[redacted]").otherwise(F.substring(e["value"], 1, length)).alias("value"))
    return F.to_json(F.map_from_entries(F.transform(entries, clean)))


def _found(text: Column, pattern: str) -> Column:
    return text.rlike(f"(?i){START}{pattern}{STOP}")


def document_classes(documents: DataFrame) -> DataFrame:
    """``documents(id, role, supporting_subtype, title, file_name, processing_status)`` with what each may be used for."""
    scope = F.trim(F.regexp_replace(F.regexp_replace(F.concat_ws(" ", "title", "file_name"), "[_‐‑‒–—-]+", " "), r"\s+", " "))
    kind = F.coalesce("supporting_subtype", F.lit(""))
    rows = documents.withColumn("_scope", scope)
    response, certain = _found(F.col("_scope"), SOLUTION_RESPONSE), _found(F.col("_scope"), CERTAIN_REQUIREMENT_SOURCE)
    historical = kind == "tidligere_losning"
    named = kind.isin("kravdokument", "rfp")
    signal = ~historical & (named | (~(response & ~certain) & _found(F.col("_scope"), REQUIREMENT_SOURCE)))
    formal = ~F.col("role").isin("primary_customer_document", "primary_solution_document") & signal
    ready = F.col("processing_status").isin(*READY)
    solution = (F.col("role") == "primary_solution_document") & ~historical & ~named & ~certain & (response | ~_found(F.col("_scope"), STRONG_REQUIREMENT_SOURCE))
    return rows.select(
        *documents.columns,
        historical.alias("historical"),
        signal.alias("requirement_signal"),
        formal.alias("formal_requirement"),
        (~historical & ((F.col("role") == "primary_customer_document") | formal)).alias("requirement"),
        ready.alias("ready"),
        (solution & ready).alias("solution_candidate"),
    )


def affects_analysis(role: Column, subtype: Column, legacy: Column) -> Column:
    """Whether a document's change makes the customer analysis stale."""
    former = F.coalesce(subtype, legacy, F.lit("")) == "tidligere_losning"
    return (role != "primary_solution_document") & ~((role == "supporting_document") & former)


def project_status(analysed: Column, customer: Column, solution: Column) -> Column:
    """The state that a project's list shows."""
    return F.when(analysed, "Kundeanalyse klar").when(customer | solution, "Dokument lastet opp").otherwise("Venter på dokument")


def inferred_over(current: Column, inferred: Column, placeholders: list[str]) -> Column:
    """The inferred value where there is one and the present one only holds its place."""
    vacant = F.coalesce(F.lower(F.trim(current)).isin(*placeholders), F.lit(True))
    return F.when(vacant & (F.trim(F.coalesce(inferred, F.lit(""))) != ""), inferred).otherwise(current)
