"""Filters and classifiers of documents and projects."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import predicates as P
from lodestone.plans.registry import fixture, query
from lodestone.sources.tables import table


@query("select o_orderkey from orders where o_orderstatus = 'F'")
def optional_filters(spark, d):
    """Two parameters, one of which is not given."""
    return P.optional(table(spark, d, "orders"), o_orderstatus="F", o_orderpriority=None).select("o_orderkey")


@query("select event_id, json_merge_patch(props, '{\"k\": null}')::varchar as rest, json_merge_patch(props, '{\"k\": null}') is distinct from '{}' as changed from events")
def json_key_removal(spark, d):
    rest = P.without_keys(F.col("props"), "k")
    return table(spark, d, "events").select("event_id", rest.alias("rest"), (~rest.eqNullSafe(F.lit("{}"))).alias("changed"))


def _rlike(pattern: str) -> str:
    return rf"regexp_matches(scope, '(?i)\b{pattern}\b')"


@query(
    f"""select id, historical, signal as requirement_signal, formal as formal_requirement, not historical and (role = 'primary_customer_document' or formal) as requirement, ready,
      role = 'primary_solution_document' and not historical and not named and not certain and (response or not strong) and ready as solution_candidate
    from (select *, role not in ('primary_customer_document', 'primary_solution_document') and signal as formal from (
      select *, not historical and (named or (not (response and not certain) and source)) as signal from (
        select *, kind = 'tidligere_losning' as historical, kind in ('kravdokument', 'rfp') as named, processing_status in ('basic_ready', 'enhanced_ready') as ready,
          {_rlike(P.REQUIREMENT_SOURCE)} as source, {_rlike(P.STRONG_REQUIREMENT_SOURCE)} as strong, {_rlike(P.CERTAIN_REQUIREMENT_SOURCE)} as certain, {_rlike(P.SOLUTION_RESPONSE)} as response
        from (select *, coalesce(supporting_subtype, '') as kind, trim(regexp_replace(regexp_replace(title || ' ' || file_name, '[_‐‑‒–—-]+', ' ', 'g'), '\\s+', ' ', 'g')) as scope from project_documents))))""",
    ("project_documents",),
)
def document_classes(spark, d):
    found = P.document_classes(fixture(spark, d, "project_documents"))
    return found.select("id", "historical", "requirement_signal", "formal_requirement", "requirement", "ready", "solution_candidate")


@query(
    """select id, role <> 'primary_solution_document' and not (role = 'supporting_document' and coalesce(supporting_subtype, legacy_subtype, '') = 'tidligere_losning') as affects from project_documents""",
    ("project_documents",),
)
def analysis_dependents(spark, d):
    return fixture(spark, d, "project_documents").select("id", P.affects_analysis(F.col("role"), F.col("supporting_subtype"), F.col("legacy_subtype")).alias("affects"))


@query(
    """select c_custkey, case when c_acctbal > 8000 then 'Kundeanalyse klar' when c_nationkey < 8 or c_mktsegment = 'BUILDING' then 'Dokument lastet opp' else 'Venter på dokument' end as status,
      case when c_custkey % 3 <> 0 and (c_custkey % 4 = 0 or c_custkey % 4 = 1) then c_name else case c_custkey % 4 when 0 then ' Ny analyse ' when 1 then null else c_mktsegment end end as name
    from customer"""
)
def project_labels(spark, d):
    current = F.expr("case c_custkey % 4 when 0 then ' Ny analyse ' when 1 then null else c_mktsegment end")
    inferred = F.expr("case when c_custkey % 3 <> 0 then c_name when c_custkey % 2 = 0 then ' ' end")
    return table(spark, d, "customer").select(
        "c_custkey",
        P.project_status(F.col("c_acctbal") > 8000, F.col("c_nationkey") < 8, F.col("c_mktsegment") == "BUILDING").alias("status"),
        P.inferred_over(current, inferred, P.PROJECT_PLACEHOLDERS).alias("name"),
    )


@query("""select event_id, '{"apiToken":"[redacted]","note":"' || repeat(event_type, 100)[:500] || '","k":"' || json_extract_string(props, '$.k') || '"}' as metadata from events""")
def sanitized_metadata(spark, d):
    json = F.concat(F.lit('{"apiToken":"x1","note":"'), F.repeat("event_type", 100), F.lit('","k":'), F.get_json_object("props", "$.k"), F.lit("}"))
    return table(spark, d, "events").select("event_id", P.sanitized(json).alias("metadata"))
