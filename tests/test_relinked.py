"""Findings are linked to the one row that they quote."""

from __future__ import annotations

from lodestone.operators.guards import relinked


def test_pieces_stand_in_order_and_no_pattern_is_made_a_pair(spark):
    """Before: a LIKE pattern was compiled for every pair of finding and row."""
    rows = [(1, 0, "En to TRE 50%_a\\b og fire fem"), (1, 1, "en to tre fire"), (1, 2, "fire. En to tre"), (2, 0, "En to tre")]
    asked = [(1, 0, "«EN TO tre 50%_a\\b ... fem»"), (1, 1, "en to tre ... fire ... fem"), (1, 2, "en to tre ... fire"), (1, 3, "en to tre … tre"), (1, 4, "fire. en to tre"), (1, 5, "en to"), (2, 0, "en to tre")]
    found = relinked(spark.createDataFrame(asked, "e long, finding_id long, evidence string"), spark.createDataFrame(rows, "e long, idx long, evidence string"), ["e"])
    linked = {(r["e"], r["finding_id"]): r["idx"] for r in found.collect()}
    assert linked == {(1, 0): 0, (1, 1): 0, (1, 2): None, (1, 3): None, (1, 4): 2, (1, 5): None, (2, 0): 0}
    assert "LIKE" not in found._jdf.queryExecution().optimizedPlan().toString()
