"""Making this package importable on the executors."""

from __future__ import annotations

import shutil
import tempfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the Python workers once an application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    package = Path(__file__).resolve().parent
    with tempfile.TemporaryDirectory() as folder:
        copy = Path(folder, "src", package.name)
        shutil.copytree(package, copy, ignore=shutil.ignore_patterns("__pycache__"))
        spark.sparkContext.addPyFile(shutil.make_archive(f"{tempfile.mkdtemp()}/lodestone", "zip", copy.parent))


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """``df.mapInArrow``, with the package sent before the plan is made."""
    ship(df.sparkSession)
    return df.mapInArrow(fn, schema)
