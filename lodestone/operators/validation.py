"""Violations of constraints as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def check(rows: DataFrame, name: str, key: Column, ok: Column) -> DataFrame:
    """``rule, key`` of the rows for which the test is false; null passes, as in SQL."""
    return rows.where(~F.coalesce(ok, F.lit(True))).select(F.lit(name).alias("rule"), key.cast("string").alias("key"))


def unique(rows: DataFrame, name: str, columns: list[str]) -> DataFrame:
    """``rule, key`` of the values that more than one row has."""
    repeated = rows.groupBy(*columns).agg(F.count("*").alias("n")).where("n > 1")
    return repeated.select(F.lit(name).alias("rule"), F.concat_ws("|", *columns).alias("key"))


def references(rows: DataFrame, name: str, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """``rule, key`` of values that the parent lacks; nulls pass."""
    known = parent.select(F.col(parent_column).alias(column)).distinct()
    lost = rows.where(F.col(column).isNotNull()).join(known, column, "left_anti")
    return lost.select(F.lit(name).alias("rule"), F.col(column).cast("string").alias("key"))


def manifest(rows: DataFrame, columns: list[str]) -> Column:
    """The digest of a row's fields in the order given."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
