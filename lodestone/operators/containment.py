"""Which texts lie in which: an exact containment join over an index of character runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.requirements import let
from lodestone.sources.scratch import materialize


def _runs(text: Column, n: Column) -> Column:
    """The distinct runs of ``n`` characters, hashed; none if the text is shorter. Characters are parted once, so that a long text costs no more a run than a short one."""
    places = F.sequence(F.lit(1), F.length(text) - n + 1)
    made = lambda chars: F.array_distinct(F.transform(places, lambda i: F.xxhash64(F.slice(chars, i, n))))
    return F.when(F.length(text) >= n, let(F.split(text, ""), made)).otherwise(F.array().cast("array<bigint>"))


def containments(needles: DataFrame, hays: DataFrame, on: list[str], needle: str, hay: str, text: str = "text", run: int = 12) -> DataFrame:
    """``on, needle, hay`` of every needle that lies in a hay of the same ``on``.

    A needle of at least ``run`` characters is looked up by its run that the
    fewest hays have, so that common beginnings bring nothing together; hays
    that lack one of its runs are ruled out with it. A shorter needle is looked
    up whole, among the hays' runs of its own length, of which there are fewer
    than ``run``. What meets is then compared. Counts are added up before they
    are shuffled, and nothing is gathered.

    Nulls and edges: empty and null texts lie nowhere and hold nothing; equal texts hold each other; repeated rows give one row.
    """
    size = F.least(F.length(text), F.lit(run))
    needles = materialize(needles.where(F.length(text) > 0).select(*on, needle, F.col(text).alias("_needle"), size.alias("_n")), "needles")
    lengths = [r["_n"] for r in needles.select("_n").distinct().collect()]  # at most ``run`` numbers
    hays = hays.where(F.length(text) > 0).select(*on, hay, F.col(text).alias("_hay"))
    sizes = F.array(*[F.lit(n) for n in sorted(lengths)]).cast("array<int>")
    index = hays.select(*on, hay, F.explode(F.flatten(F.transform(sizes, lambda n: F.transform(_runs(F.col("_hay"), n), lambda h: F.struct(n.alias("_n"), h.alias("_run")))))).alias("_r")).select(*on, hay, "_r.*")
    own = needles.select(*on, needle, "_needle", "_n", F.explode(_runs(F.col("_needle"), F.col("_n"))).alias("_run"))
    sought = materialize(own.select(*on, "_n", "_run").distinct(), "sought")  # its size is then known to the planner
    index = materialize(index.join(sought, [*on, "_n", "_run"], "left_semi"), "runs")
    counts = index.groupBy(*on, "_n", "_run").agg(F.count("*").alias("_hays"))
    rarest = own.join(counts, [*on, "_n", "_run"], "left").groupBy(*on, needle, "_needle", "_n").agg(F.min(F.struct(F.coalesce("_hays", F.lit(0)).alias("hays"), "_run")).alias("_least"))
    anchors = rarest.where("_least.hays > 0").select(*on, needle, "_needle", "_n", F.col("_least._run").alias("_run"))
    met = anchors.join(index, [*on, "_n", "_run"]).join(hays, [*on, hay])
    return met.where(F.contains("_hay", F.col("_needle"))).select(*on, needle, hay).distinct()
