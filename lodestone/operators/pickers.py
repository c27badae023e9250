"""Which documents, services and facts are taken up: roles, source sets, rankings, round-robin picks, trusted texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FAR = 1_000_000_000  # stands for a missing place in an order


def first_by(rows: DataFrame, key: str, order: list[Column], where: Column) -> DataFrame:
    """The first row of each key that the condition admits."""
    return rows.where(where).withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_k = 1").drop("_k")


def document_roles(documents: DataFrame) -> DataFrame:
    """``project_id, id, part``: each project's customer and solution document, chosen by role or else by what else fits, and what supports them.

    Documents with the columns of ``document_classes``; historical ones are left out.
    """
    order = [F.col("id")]
    solution = first_by(documents, "project_id", order, F.col("role") == "primary_solution_document").select("project_id", F.col("id").alias("s"))
    rows = documents.join(solution, "project_id", "left")
    other = (F.col("role") != "primary_solution_document") & ~F.col("historical") & ~F.col("id").eqNullSafe(F.col("s"))
    primary = F.col("role") == "primary_customer_document"
    customer = first_by(rows, "project_id", [primary.desc(), F.col("id")], primary | other).select("project_id", F.col("id").alias("c"))
    rows = rows.join(customer, "project_id", "left")
    named = F.concat_ws(" ", "title", "file_name").rlike("(?i)løsn|losn|solution|arkitektur|architecture")
    spare = first_by(rows, "project_id", order, F.col("s").isNull() & ~F.col("id").eqNullSafe(F.col("c")) & ~F.col("historical") & ~F.col("formal_requirement") & named)
    rows = rows.join(spare.select("project_id", F.col("id").alias("s2")), "project_id", "left").withColumn("s", F.coalesce("s", "s2"))
    part = F.when(F.col("id") == F.col("c"), "customer").when(F.col("id") == F.col("s"), "solution").when(~F.col("historical"), "supporting")
    return rows.select("project_id", "id", part.alias("part")).where("part is not null")


def requirement_sources(documents: DataFrame, customer: DataFrame) -> DataFrame:
    """``project_id, id, place``: the customer document, then the formal requirement documents, each once."""
    both = customer.select("project_id", "id", F.lit(0).alias("class")).unionByName(documents.where("formal_requirement").select("project_id", "id", F.lit(1).alias("class")))
    once = both.groupBy("project_id", "id").agg(F.min("class").alias("class"))
    return once.select("project_id", "id", F.row_number().over(Window.partitionBy("project_id").orderBy("class", "id")).alias("place"))


def high_impact(role: Column, subtype: Column) -> Column:
    return (role == "primary_customer_document") | F.coalesce(subtype.isin("kravdokument", "rfp"), F.lit(False))


def service_documents(services: DataFrame, tokens: list[str], artifact_type: str) -> DataFrame:
    """The services whose texts hold most of the tokens: none, five or three, by the type of artifact."""
    limit = {"bilag1_rekonstruksjon": 0, "forbedret_kravsvar": 5}.get(artifact_type, 3)
    hay = F.lower(F.concat_ws(" ", "title", "summary"))
    score = reduce(lambda a, b: a + b, (hay.contains(t).cast("int") for t in tokens), F.lit(0))
    return services.withColumn("score", score).orderBy(F.desc("score"), "id").limit(limit)


def service_candidates(services: DataFrame, limit: int = 12) -> DataFrame:
    """Services by whether they are selected, recommended, how useful, and whether they have a context."""
    return services.orderBy(F.desc("selected"), F.desc("recommended"), F.desc("score"), F.desc("has_context"), "id").limit(limit)


def recommended(services: DataFrame, project: str, least: int = 40, limit: int = 5) -> DataFrame:
    """Each project's services of some use, the best of each name, five at most."""
    name = F.lower(F.trim("name"))
    best = services.where(F.col("usefulness") >= least).withColumn("_k", F.row_number().over(Window.partitionBy(project, name).orderBy(F.desc("usefulness"), "id")))
    placed = best.where("_k = 1").withColumn("place", F.row_number().over(Window.partitionBy(project).orderBy(F.desc("usefulness"), "id")))
    return placed.where(F.col("place") <= limit).drop("_k")


def round_robin(facts: DataFrame, project: str, categories: list[str]) -> DataFrame:
    """Facts picked in turn: the best of each document, then the best of each category in its order, up to nine and no more than seven above the documents.

    A pick's turn is known from its rank within document and category, so no group is walked.
    """
    own = Window.partitionBy(project, "document_id").orderBy(F.desc("score"), "id")
    order = F.array_position(F.array(*map(F.lit, categories)), F.col("category"))
    ranked = facts.withColumn("_d", F.row_number().over(own) == 1).withColumn("_o", F.when(order > 0, order).otherwise(FAR))
    per = Window.partitionBy(project, "category", "_d").orderBy(F.desc("score"), "id")
    turn = F.when(F.col("_d"), F.struct(F.lit(0).alias("a"), F.lit(0).alias("b"))).otherwise(F.struct(F.row_number().over(per).alias("a"), F.col("_o").cast("int").alias("b")))
    counts = facts.groupBy(project).agg(F.countDistinct("document_id").alias("_n"))
    placed = ranked.withColumn("_t", turn).withColumn("place", F.row_number().over(Window.partitionBy(project).orderBy("_t", F.desc("score"), "id")))
    cap = F.least(F.lit(9), F.greatest(F.lit(8), F.col("_n") + 7))
    return placed.join(counts, project).where(F.col("place") <= cap).drop("_d", "_o", "_t", "_n")


def requirement_order(rows: DataFrame, keys: list[str], parts: list[str]) -> DataFrame:
    """``rows`` with their place: by the parts of the order in turn, missing ones last, then by text.

    A total order where the comparison that it stands for may be undecided.
    """
    order = [F.coalesce(F.col(p), F.lit(FAR)) for p in parts]
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order, "text", "id")))


def trusted_text(generated: Column, local: Column) -> Column:
    """The local text in place of a generated one that holds it, or that it completes without a new list item."""
    key = lambda c: F.trim(F.regexp_replace(F.lower(F.regexp_replace(c, "[‐‑‒–—]", "-")), r"\s+", " "))
    g, t = key(generated), key(local)
    rest = F.substring(t, F.length(g) + 1, F.length(t))
    completes = F.startswith(t, g) & ~g.rlike("[.!?;:]$") & ~rest.rlike(r"^\s*(?:[-•*]|\|)")
    usable = local.isNotNull() & (F.length(local) >= 12) & (g != "")
    return F.when(usable & (F.contains(g, t) | completes), local).otherwise(generated)


def content_hash(text: Column, structure: Column) -> Column:
    """What a document's source is known by: its text and its structure."""
    return F.sha2(F.concat(text, F.lit("\n"), structure), 256)


def merged_sections(base: DataFrame, patch: DataFrame, key: str, owned: dict[str, list[str]]) -> DataFrame:
    """``base`` with the fields that each of ``patch(key, section, ...)`` owns taken from it, where it has them."""
    out = base
    for section, fields in owned.items():
        part = patch.where(F.col("section") == section).select(key, *[F.col(f).alias(f"_{f}") for f in fields])
        out = out.join(part, key, "left").withColumns({f: F.coalesce(f"_{f}", f) for f in fields}).drop(*[f"_{f}" for f in fields])
    return out
