"""Streams against the same rules in batch."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lodestone.sources.tables import table
from lodestone.streaming import breaker, limits


@pytest.fixture(scope="module")
def arriving(spark, sf, tmp_path_factory):
    """Events as three files, each later than the one before, read as a stream of one file a trigger."""
    folder = str(tmp_path_factory.mktemp("arriving"))
    events = table(spark, sf, "events").select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    low, high = events.agg(F.min(F.unix_timestamp("ts")), F.max(F.unix_timestamp("ts"))).first()
    part = F.least(F.floor((F.unix_timestamp("ts") - low) * 3 / (high - low)), F.lit(2))
    for i in range(3):
        events.where(part == i).coalesce(1).write.parquet(f"{folder}/{i}.parquet")
    schema = events.schema

    def stream():
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder)

    return events, stream


def run(spark, df, name: str, mode: str, folder) -> list:
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(folder)).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return spark.table(name).collect()


@pytest.mark.parametrize("count_denied", [True, False])
def test_rate_limit(spark, arriving, tmp_path, count_denied):
    events, stream = arriving
    found = run(spark, limits.decide_stream(stream(), 86400, 2, count_denied, late="40 days"), f"limits_{count_denied}".lower(), "append", tmp_path)
    expected = limits.decide(events, 86400, 2, count_denied).collect()
    assert {(r.event_id, r["count"], r.allowed) for r in found} == {(r.event_id, r["count"], r.allowed) for r in expected}
    assert len(found) == len(expected)


def test_windowed_counts(spark, arriving, tmp_path):
    events, stream = arriving
    found = {(r.start, r.event_type): r.n for r in run(spark, limits.windowed_counts(stream(), late="40 days"), "windows", "update", tmp_path)}
    assert found == {(r.start, r.event_type): r.n for r in limits.windowed_counts(events).collect()}


def test_breaker_backs_off():
    state, seen = ("closed", 0, 0.0), []
    for now, ok in ((0, False), (1, False), (2, False), (3, True), (7.5, False), (12, True), (18, True), (19, False)):
        state, let = breaker.step(state, ok, now, threshold=3, base=5.0, most=60.0)
        seen.append((state[0], let))
    assert seen == [("closed", True), ("closed", True), ("open", True), ("open", False), ("open", True), ("open", False), ("closed", True), ("closed", True)]
    assert breaker.step(("open", 20, 10.0), False, 11.0, 3, 5.0, 60.0)[0] == ("open", 21, 71.0)
