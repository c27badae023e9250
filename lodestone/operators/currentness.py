"""Whether derived rows are current: evaluations, knowledge manifests, summaries.

Every function takes whole tables and answers for all projects at once. A
dependency is the triple of id, update time and content hash; rows that lean on
one are current while the triple is still that of the latest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The artifact type that evaluations judge, and the type whose manifest is short.
DRAFT = "losningsutkast"
SHORT_TYPE = "gjennomforing_og_risiko"


def manifest_limit(artifact_type: Column) -> Column:
    """Newest candidates that a manifest of the type takes up: two or four."""
    return F.when(artifact_type == SHORT_TYPE, 2).otherwise(4)


def latest_artifacts(artifacts: DataFrame) -> DataFrame:
    """The artifact of each project and type with the highest version, then the newest, then the highest id."""
    newest = F.max_by(F.struct(*artifacts.columns), F.struct("version", "created_at", "id"))
    return artifacts.groupBy("project_id", "artifact_type").agg(newest.alias("row")).select("row.*")


def evaluation_dependencies(evaluations: DataFrame, artifacts: DataFrame) -> DataFrame:
    """The latest evaluation of each project, without those of a generated artifact that is gone."""
    known = artifacts.select(F.col("id").alias("evaluated_id"), "project_id", F.lit(True).alias("known"))
    there = evaluations.join(known, ["evaluated_id", "project_id"], "left").where("mode <> 'generated_artifact' or known").drop("known")
    newest = F.max_by(F.struct(*there.columns), F.struct("updated_at", "id"))
    return there.groupBy("project_id").agg(newest.alias("row")).select("row.*")


def knowledge_candidates(artifacts: DataFrame, revisions: DataFrame, dependencies: DataFrame) -> DataFrame:
    """Latest artifacts whose revisions are the project's and whose evaluation, if they used one, is still the latest."""
    latest = latest_artifacts(artifacts).alias("a")
    project = revisions.alias("r")
    current = latest.join(project, F.expr("a.project_id = r.project_id and a.source_revision = r.source_revision and a.library_revision = r.library_revision"))
    dep = dependencies.select("project_id", F.col("id").alias("dep_id"), F.col("updated_at").alias("dep_at"), F.col("content_hash").alias("dep_hash"), F.col("evaluated_id").alias("dep_artifact"))
    joined = current.select("a.*").join(dep, "project_id", "left")
    same = F.expr("input_evaluation_id = dep_id and input_evaluation_at = dep_at and input_evaluation_hash = dep_hash")
    used = F.coalesce((F.col("dep_artifact") == F.col("id")) | same, F.lit(False))
    return joined.where(~F.col("used_evaluation") | used).select(*artifacts.columns)


def base_manifests(candidates: DataFrame, targets: DataFrame) -> DataFrame:
    """``project_id, artifact_type, manifest``: for each of ``targets(project_id, artifact_type)`` the newest candidates of other types.

    A project has one candidate a type, so the join by project stays as small as the square of the number of types.
    """
    own = targets.select("project_id", F.col("artifact_type").alias("target")).distinct()
    offered = own.join(candidates, "project_id").where("artifact_type <> target")
    newest = Window.partitionBy("project_id", "target").orderBy(F.desc("created_at"), F.desc("id"))
    taken = offered.withColumn("place", F.row_number().over(newest)).where(F.col("place") <= manifest_limit(F.col("target")))
    entry = F.struct("place", F.struct("id", "artifact_type", "version", "content_hash").alias("entry"))
    ordered = F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["entry"])
    made = taken.groupBy("project_id", "target").agg(ordered.alias("manifest"))
    joined = own.join(made, ["project_id", "target"], "left")
    empty = F.array().cast(made.schema["manifest"].dataType)
    return joined.select("project_id", F.col("target").alias("artifact_type"), F.coalesce("manifest", empty).alias("manifest"))


def knowledge_current(artifacts: DataFrame, recorded: DataFrame, manifests: DataFrame) -> DataFrame:
    """``id, current``: whether an artifact's recorded manifest, without its own type, is what it would be now.

    ``recorded(artifact_id, ordinal, id, artifact_type, version, content_hash)``. One hop only: what is
    current does not depend on whether the entries are.
    """
    other = recorded.alias("e").join(artifacts.select(F.col("id").alias("artifact_id"), F.col("artifact_type").alias("own")), "artifact_id")
    entry = F.struct("ordinal", F.struct("e.id", "e.artifact_type", "e.version", "e.content_hash").alias("entry"))
    kept = other.where(~F.col("e.artifact_type").eqNullSafe(F.col("own"))).groupBy(F.col("artifact_id").alias("id")).agg(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["entry"]).alias("then"))
    joined = artifacts.select("id", "project_id", "artifact_type").join(kept, "id", "left").join(manifests, ["project_id", "artifact_type"], "left")
    empty = F.size("manifest") == 0
    return joined.select("id", F.coalesce(F.when(F.col("then").isNull(), empty).otherwise(F.col("then") == F.col("manifest")), F.lit(False)).alias("current"))


def evaluation_current(evaluations: DataFrame, artifacts: DataFrame, revisions: DataFrame, knowledge: DataFrame) -> DataFrame:
    """``project_id, id, current`` of each evaluation: always for documents alone; for an artifact, while it is the latest draft, at the project's revisions, on current knowledge."""
    drafts = latest_artifacts(artifacts).where(F.col("artifact_type") == DRAFT).alias("a")
    sound = drafts.join(revisions.alias("r"), F.expr("a.project_id = r.project_id and a.source_revision = r.source_revision and a.library_revision = r.library_revision")).select("a.id", "a.project_id")
    sound = sound.join(knowledge.where("current").select("id"), "id", "left_semi").select(F.col("id").alias("evaluated_id"), "project_id", F.lit(True).alias("sound"))
    joined = evaluations.join(sound, ["evaluated_id", "project_id"], "left")
    verdict = F.when(F.col("mode") == "document_only", True).when(F.col("mode") == "generated_artifact", F.coalesce("sound", F.lit(False))).otherwise(False)
    return joined.select("project_id", "id", verdict.alias("current"))


def current_summaries(summaries: DataFrame, dependencies: DataFrame) -> DataFrame:
    """The newest verified summary of each project that was made from its latest evaluation."""
    dep = dependencies.select("project_id", F.col("id").alias("input_id"), F.col("updated_at").alias("input_at"), F.col("content_hash").alias("input_hash"))
    sound = summaries.where("verified").join(dep, ["project_id", "input_id", "input_at", "input_hash"], "left_semi")
    newest = F.max_by(F.struct(*summaries.columns), F.struct("updated_at", "id"))
    return sound.groupBy("project_id").agg(newest.alias("row")).select("row.*")


def derived_snapshots(dependencies: DataFrame, summaries: DataFrame) -> DataFrame:
    """``project_id, snapshot``: the latest evaluation with the summary made from it, if there is one, as JSON."""
    summary = current_summaries(summaries, dependencies).select("project_id", F.struct("id", "updated_at").alias("summary"))
    joined = dependencies.select("project_id", F.struct("id", "mode", "content_hash").alias("evaluation")).join(summary, "project_id", "left")
    return joined.select("project_id", F.to_json(F.struct("evaluation", F.col("summary.id").alias("summary_id")), {"ignoreNullFields": "false"}).alias("snapshot"))


def stable_reads(reads: DataFrame, tries: int = 3) -> DataFrame:
    """The first of each project's ``reads(project_id, attempt, before, after)`` whose revisions agree; ``ok`` is false where none of the tries does."""
    agreed = F.min(F.when((F.col("before") == F.col("after")) & (F.col("attempt") <= tries), F.struct("attempt", "after")))
    found = reads.groupBy("project_id").agg(agreed.alias("first"))
    return found.select("project_id", "first.attempt", F.col("first.after").alias("revision"), F.col("first").isNotNull().alias("ok"))
