"""Table readers over a folder of Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.session import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """``{sf_dir}/{name}.parquet``, whatever file system the path names."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
