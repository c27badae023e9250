"""Working tables are broadcast by the size of their rows, not of their files."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.sources.scratch import materialize


def test_large_rows_in_a_small_file_are_not_broadcast(spark):
    """300,000 equal rows make a file of some kilobytes (before: broadcast, with all of them in the driver)."""
    many = materialize(spark.range(300000).select((F.col("id") % 7).alias("k"), F.lit("the same text in every row").alias("t")), "many")
    few = materialize(spark.range(7).select(F.col("id").alias("k")), "few")
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString() + df._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" not in plan(few.join(many.select("k", "t"), "k", "left"))
    assert "BroadcastHashJoin" in plan(spark.range(100).withColumnRenamed("id", "k").join(few, "k"))


def test_empty_table(spark):
    assert materialize(spark.range(5).limit(0), "none").count() == 0
    assert materialize(spark.createDataFrame([], "a string, b array<int>"), "none").columns == ["a", "b"]
