"""Versioned artifacts: which is the latest, and is it current given its recorded inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ["project_id", "artifact_type"]


def latest(artifacts: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """The newest row of each group, by version, creation and id; one partial aggregate, no sort."""
    order = F.struct("version", "created_at", "id")
    row = F.max_by(F.struct(*artifacts.columns), order).alias("row")
    return artifacts.groupBy(*keys).agg(row).select("row.*")


def with_currentness(artifacts: DataFrame, revisions: DataFrame) -> DataFrame:
    """``artifacts`` with ``is_latest``, ``inputs_match`` and ``is_current``, both of them.

    An artifact's inputs match if the revisions that it recorded are its project's present ones.
    """
    newest = latest(artifacts).select(*KEY, F.col("id").alias("latest_id"))
    now = revisions.select("project_id", F.col("source_revision").alias("now_source"), F.col("library_revision").alias("now_library"))
    joined = artifacts.join(newest, KEY).join(now, "project_id", "left")
    match = F.col("source_revision").eqNullSafe(F.col("now_source")) & F.col("library_revision").eqNullSafe(F.col("now_library"))
    return (
        joined.withColumn("is_latest", F.col("id") == F.col("latest_id"))
        .withColumn("inputs_match", match)
        .withColumn("is_current", F.col("is_latest") & F.col("inputs_match"))
        .drop("latest_id", "now_source", "now_library")
    )


def knowledge_manifest(artifacts: DataFrame, revisions: DataFrame, limit: int = 4) -> DataFrame:
    """One row a project: its newest ``limit`` current latest artifacts as an ordered array of structs."""
    good = with_currentness(artifacts, revisions).where("is_current")
    entry = F.struct((-F.unix_micros(F.col("created_at").cast("timestamp"))).alias("age"), "id", "artifact_type", "version")
    ordered = F.array_sort(F.collect_list(entry))  # at most one entry a type
    kept = F.transform(F.slice(ordered, 1, limit), lambda e: F.struct(e["id"].alias("id"), e["artifact_type"].alias("artifact_type"), e["version"].alias("version")))
    return good.groupBy("project_id").agg(kept.alias("manifest"))


def authority(artifacts: DataFrame, revisions: DataFrame) -> DataFrame:
    """One row a project: an ordered array of type, id, version and whether the source is current."""
    rows = with_currentness(artifacts, revisions).where("is_latest")
    entry = F.struct("artifact_type", "id", "version", F.col("inputs_match").alias("source_is_current"))
    return rows.groupBy("project_id").agg(F.array_sort(F.collect_list(entry)).alias("types"))


def manifest_matches(recorded: Column, recomputed: Column) -> Column:
    """Equality of two manifests, whatever order they were written in; two missing ones match."""
    return F.array_sort(recorded).eqNullSafe(F.array_sort(recomputed))


def propagate(revisions: DataFrame, changes: DataFrame) -> DataFrame:
    """Revisions after one step for each change of ``changes(project_id)``."""
    steps = changes.groupBy("project_id").agg(F.count("*").alias("steps"))
    return revisions.join(steps, "project_id", "left").select("project_id", (F.col("source_revision") + F.coalesce("steps", F.lit(0))).alias("source_revision"), F.coalesce("steps", F.lit(0)).alias("steps"))


def surviving(derived: DataFrame, changed: DataFrame) -> DataFrame:
    """Derived rows of projects without a change."""
    return derived.join(changed.select("project_id").distinct(), "project_id", "left_anti")


def next_versions(artifacts: DataFrame) -> DataFrame:
    """The version to give next, a group; 1 where there is none yet."""
    return artifacts.groupBy(*KEY).agg((F.coalesce(F.max("version"), F.lit(0)) + 1).alias("next_version"))


def version_guard(edits: DataFrame, artifacts: DataFrame, revisions: DataFrame) -> DataFrame:
    """``edits(edit_id, parent_id)`` with the code of the first rule that the parent breaks, or null."""
    state = with_currentness(artifacts, revisions).select(F.col("id").alias("parent_id"), "is_latest", "inputs_match")
    code = F.when(F.col("is_latest").isNull(), "parent_missing").when(~F.col("is_latest"), "parent_not_latest").when(~F.col("inputs_match"), "parent_stale")
    return edits.join(state, "parent_id", "left").select("edit_id", "parent_id", code.alias("code"))


def history(snapshots: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Snapshots that differ from a non-empty one before them, with that one."""
    from pyspark.sql import Window

    before = F.lag(value).over(Window.partitionBy(*keys).orderBy(*order))
    return snapshots.withColumn("previous", before).where(F.col("previous").isNotNull() & (F.col("previous") != "") & ~F.col("previous").eqNullSafe(F.col(value)))
