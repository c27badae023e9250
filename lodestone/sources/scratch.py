"""Working tables in the folder that the whole cluster shares.

Lineage is cut by writing a Parquet table under ``spark.checkpoint.dir`` and
reading it back. Unlike ``checkpoint()`` the result is columnar, so later reads
prune columns and push filters, and lost executors cost no recomputation.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, MapType, StringType, StructType

from lodestone.session import ship

KEY = "spark.checkpoint.dir"
#: Bytes that a nested value is taken to have.
NESTED = 500


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new path below the shared folder; a local one is set only where the session names none and runs on one machine."""
    ship(spark)
    root = spark.conf.get(KEY, None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError(f"set {KEY} to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="lodestone-")
        spark.conf.set(KEY, root)
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/lodestone/{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex[:12]}"


def _width(df: DataFrame) -> Column:
    """About how many bytes a row has in memory: 16 and 8 a column, the text itself, and a flat sum for a nested value."""
    width = F.lit(16 + 8 * len(df.columns) + sum(NESTED for f in df.schema if isinstance(f.dataType, (ArrayType, MapType, StructType))))
    for f in df.schema:
        if isinstance(f.dataType, (StringType, BinaryType)):
            width = width + F.coalesce(F.octet_length(F.col(f"`{f.name}`")), F.lit(0))
    return width


def materialize(df: DataFrame, tag: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` to a working table and return a reader of it with the same columns.

    Repeated values make a file far smaller than its rows are, and the planner
    broadcasts by the file. Rows are therefore measured while they are written:
    a table whose rows are over the threshold is not broadcast by itself, and
    joins with it are merge joins.
    """
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    seen = Observation()
    writer = df.observe(seen, F.sum(_width(df)).alias("bytes")).write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    most = spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return found.hint("merge") if (seen.get.get("bytes") or 0) > most else found
