"""Versions, conflicts, tiers and files of a compacted dataset."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lodestone.llm.compaction import ConflictError, Dataset
from lodestone.sources.scratch import scratch_path


def made(spark, **kwargs) -> Dataset:
    schema = spark.range(0).select("id", F.lit("").alias("arrival"), F.lit("").alias("BATCH")).schema
    return Dataset(spark, scratch_path(spark, "shards"), schema, **kwargs)


def rows(spark, low: int, high: int):
    return spark.range(low, high, 1, 1).select("id", F.sha2(F.col("id").cast("string"), 512).alias("arrival"), F.lit(None).cast("string").alias("BATCH"))


def ids(df) -> list[int]:
    return sorted(r.id for r in df.select("id").collect())


def test_versions_stay_readable(spark):
    dataset = made(spark)
    assert dataset.version() == 0 and dataset.read().count() == 0
    assert dataset.append([rows(spark, 0, 10), rows(spark, 10, 10)]) == 1
    assert dataset.append_batches(rows(spark, 10, 50), F.pmod("id", F.lit(3))) == 2
    assert ids(dataset.read()) == list(range(50))
    assert ids(dataset.read(1)) == list(range(10))
    assert dataset.compact() == 3
    assert ids(dataset.read(2)) == ids(dataset.read()) == list(range(50))
    assert [(r["rows"], r["arrivals"]) for r in dataset.runs()] == [(50, 4)]
    assert dataset.compact() == 3
    dataset.vacuum()
    assert ids(dataset.read()) == list(range(50))
    assert dataset._names("runs") == [dataset.runs()[0]["run"]]


def test_of_two_writers_one_commits(spark):
    dataset, other = made(spark), None
    dataset.append([rows(spark, 0, 5)])
    other = Dataset(spark, dataset.path, dataset.schema)
    base, mine = dataset.version(), dataset.manifest().withColumn("run", F.lit("mine"))
    assert other._commit(other.manifest(), base) == base + 1
    with pytest.raises(ConflictError):
        dataset._commit(mine, base)
    assert dataset.version() == base + 1
    assert ids(dataset.read()) == list(range(5))
    assert sorted(dataset._names("versions")) == [f"{base:012d}", f"{base + 1:012d}"]


def test_stray_files_are_not_read(spark):
    dataset = made(spark)
    dataset.append([rows(spark, 0, 5)])
    run = dataset.runs()[0]["run"]
    rows(spark, 90, 95).write.mode("append").parquet(f"{dataset.path}/runs/{run}")
    rows(spark, 70, 75).write.parquet(f"{dataset.path}/runs/stray")
    assert ids(dataset.read()) == list(range(5))


def test_tiers_and_file_sizes(spark):
    dataset = made(spark, target_bytes=120_000, fanout=3, unit_bytes=10_000)
    for i in range(9):
        dataset.append([rows(spark, 400 * i, 400 * i + 400)])
        dataset.compact()
        tiers = [r["tier"] for r in dataset.runs()]
        assert all(tiers.count(t) < 3 for t in tiers)
    assert ids(dataset.read()) == list(range(3600))
    run = max(dataset.runs(), key=lambda r: r["bytes"])
    sizes = [r["bytes"] for r in dataset.manifest().where(F.col("run") == run["run"]).collect()]
    assert run["tier"] >= 2 and len(sizes) > 1 and max(sizes) < 2 * 120_000
    assert len({r["run"] for r in dataset.runs()}) == len(dataset.runs())


def test_large_runs_are_not_rewritten_with_small_ones(spark):
    dataset = made(spark, fanout=2, unit_bytes=5_000)
    dataset.append([rows(spark, 0, 4000)])
    large = dataset.runs()[0]["run"]
    dataset.append([rows(spark, 4000, 4010), rows(spark, 4010, 4020)])
    dataset.compact()
    assert large in {r["run"] for r in dataset.runs()} and len(dataset.runs()) == 2
