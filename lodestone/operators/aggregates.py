"""Aggregates that are more than one built-in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def contiguity(rows: DataFrame, keys: list[str], index: str) -> DataFrame:
    """Whether each group's indices are 0 .. n - 1, each once."""
    found = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.countDistinct(index).alias("distinct_n"), F.min(index).alias("low"), F.max(index).alias("high"))
    return found.withColumn("contiguous", (F.col("n") == F.col("distinct_n")) & (F.col("low") == 0) & (F.col("high") == F.col("n") - 1))


def index_percentiles(values: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """For each name the element at floor(share * n) of the sorted values of a group, at most the last.

    Found by counts of distinct values, so no group is gathered in one place.
    """
    from pyspark.sql import Window

    counts = values.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*keys).orderBy(value)
    placed = counts.withColumns({"upto": F.sum("n").over(w), "rows": F.sum("n").over(Window.partitionBy(*keys))})
    at = {name: F.least(F.floor(F.col("rows") * share) + 1, F.col("rows")) for name, share in shares.items()}
    return placed.groupBy(*keys).agg(*[F.min(F.when(F.col("upto") >= i, F.col(value))).alias(name) for name, i in at.items()])


def nearest_rank(values: DataFrame, keys: list[str], value: str, percents: list[int]) -> DataFrame:
    """Nearest-rank percentiles by counts of distinct values, so no group is gathered in one place.

    ``rank(p)`` is the least value whose cumulative count reaches ``p`` percent of its group.
    """
    from pyspark.sql import Window

    counts = values.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*keys).orderBy(value)
    placed = counts.withColumns({"upto": F.sum("n").over(w), "rows": F.sum("n").over(Window.partitionBy(*keys))})
    reached = [F.min(F.when(F.col("upto") * 100 >= F.col("rows") * p, F.col(value))).alias(f"p{p}") for p in percents]
    return placed.groupBy(*keys).agg(*reached)


def table_digest(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Row count and an order-free content digest: sums of the halves of every row's SHA-256, mergeable at any scale."""
    cells = [F.when(F.col(c).isNull(), "00").otherwise(F.concat(F.lit("01"), F.sha2(F.col(c).cast("string"), 256))) for c in columns]
    digest = F.sha2(F.concat(*cells), 256)
    part = [F.conv(F.substring(digest, 1 + 12 * i, 12), 16, 10).cast("decimal(38,0)") for i in range(2)]
    return rows.agg(F.count("*").alias("rows"), *[F.sum(p).alias(f"digest{i}") for i, p in enumerate(part)])


def to_hundred(weights: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    """Shares in whole percent that add up to 100 a group: rounded, then one more or less for the first rows."""
    from pyspark.sql import Window

    every = Window.partitionBy(*keys)
    share = F.floor(F.col(value) * 100 / F.sum(value).over(every) + 0.5)
    rounded = weights.withColumn("share", share.cast("long"))
    off = rounded.withColumns({"off": 100 - F.sum("share").over(every), "place": F.row_number().over(every.orderBy(*order)) - 1})
    step = F.when(F.col("place") < F.abs("off"), F.signum(F.col("off").cast("double")).cast("long")).otherwise(0)
    return off.withColumn("share", F.col("share") + step).drop("off", "place")


def multiset_deficit(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """How many more of each key are expected than there are."""
    e, a = (x.groupBy(key).agg(F.count("*").alias(n)) for x, n in ((expected, "e"), (actual, "a")))
    missing = F.greatest(F.col("e") - F.coalesce("a", F.lit(0)), F.lit(0))
    return e.join(a, key, "left").select(key, missing.alias("missing")).where("missing > 0")
