"""Lines of glyphs are rebuilt page after page, and places in a source are searched once."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.sources.scans import glyph_lines, table_rows

SCHEMA = "page long, item_no int, x double, y double, width double, text string"


def test_pages_part_and_batches_do_not(spark):
    items = [(p, i, float(i % 4), float(100 - i // 4 * 5), 0.5, f"{p}.{i}") for p in (1, 2, 3) for i in range(12)] + [(4, 0, 0.0, 0.0, 1.0, " "), (5, 1, 9.0, 7.0, 1.0, "b"), (5, 0, 1.0, 8.0, 1.0, "a"), (5, 2, 2.0, 50.0, 1.0, None)]
    df = spark.createDataFrame(items, SCHEMA).repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 5)
    try:
        found = sorted(tuple(r) for r in glyph_lines(df, "page").collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert found == [(p, n + 1, "".join(f"{p}.{i}" for i in range(4 * n, 4 * n + 4))) for p in (1, 2, 3) for n in range(3)] + [(5, 1, "a b")]
    assert glyph_lines(spark.createDataFrame([], SCHEMA), "page").count() == 0


def test_pages_are_no_groups_of_their_own(spark):
    """Before: a Pandas frame a page."""
    plan = glyph_lines(spark.range(5).select(F.col("id").alias("page"), F.lit(1).alias("item_no"), *[F.lit(1.0).alias(c) for c in ("x", "y", "width")], F.lit("a").alias("text")), "page")
    assert "FlatMapGroups" not in plan._jdf.queryExecution().optimizedPlan().toString()


def test_each_place_is_searched_once(spark):
    """A value is sought whole and by its beginning, once each (before: each search stood in the plan several times)."""
    from lodestone.operators.alignment import source_offsets

    df = spark.createDataFrame([("en to tre", ["to", "tre", "to"])], "t string, v array<string>").select(source_offsets(F.col("t"), F.col("v")).alias("o"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("locate(") <= 2 and df.first()["o"] == [3, 6, None]


def test_sketch_and_exact_count_are_apart(spark, sf):
    """Before: one aggregation of both, which keeps a sketch for every pair of type and user."""
    from lodestone.plans.catalog import QUERIES

    plan = QUERIES["approximate_users"](spark, sf)._jdf.queryExecution().sparkPlan().toString()
    assert not [line for line in plan.splitlines() if "approx_count_distinct" in line and "user_id" in line.split("functions=")[0]]


def test_a_layout_table_is_read_in_its_own_row(spark):
    """Before: cells were windowed, grouped and joined with their names, and the JSON was parsed for both sides of that join."""
    import json

    cell = lambda text, row, col, head=False: {"text": text, "start_row_offset_idx": row, "start_col_offset_idx": col, "column_header": head}
    tables = {
        1: [cell(" a\n b", 0, 0), cell("A b", 0, 7), cell("", 0, 3), cell("x", 2, 7), cell("y", 2, 3), cell("z", 2, 7), cell("", 2, 0), cell(None, 4, 3), cell("w", 4, 0), cell("lost", None, 1)],
        2: [cell("n", 1, 1, True), cell("m", 0, 1, True), cell("v", 0, 2), cell("u", 5, 1), cell("t", 3, 2)],
        3: [cell("alone", 9, 4)],
        4: [],
    }
    rows = [(k, json.dumps({"table_cells": v})) for k, v in tables.items()] + [(3, json.dumps({"table_cells": [cell("more", 11, 2)]})), (5, "{"), (6, None)]
    df = table_rows(spark.createDataFrame(rows, "id long, j string").repartition(3), "id", "j")
    assert sorted(tuple(r) for r in df.collect()) == [(1, 2, "Kolonne 2: y | A b 2: x z"), (1, 4, "a b: w"), (2, 3, "v: t"), (2, 5, "m n: u"), (3, 11, "Kolonne 1: more")]
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1 and "Window" not in plan and "Join" not in plan
