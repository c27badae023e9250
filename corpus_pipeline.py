"""The corpus pipeline: quality rules, line dedup, near-dedup, decontamination, encoding.

Every stage works on all that the one before it kept. Its result is written as
Parquet and read again, so lost executors repeat at most one stage.

Nulls and edges, by stage: a null, empty or wordless text fails the base rules
and goes at once; a null language or source is a group of its own; very long
texts are measured, split, compared and encoded whole. A row with a null doc_id
is no copy of another and stays until encoding. Of rows that repeat a doc_id
all stay or go together; of equal texts that with the smallest doc_id stays. A
document whose every line is boilerplate stays with an empty text. Columns that
documents have besides their own stay, whatever their names, up to encoding.
Empty tables give empty results.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import decontaminate, lines, neardup, pieces, quality
from lodestone.sources.scratch import materialize
from lodestone.sources.tables import table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and their group's adaptive thresholds."""
    return quality.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that over a tenth of their source's documents, and two of them, hold; n_chars follows."""
    found = lines.drop_boilerplate(docs, F.col("source"))
    return found.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest doc_id, of each class of shingle similarity 0.8 (five words); candidates by bit-sliced SimHash."""
    return neardup.keep_one(docs, shingle=5, similarity=0.8).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no 10-word window of a benchmark item occurs."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def piece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids and their byte spans in the text."""
    found = pieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return found.select("doc_id", "ids", "begins", "ends", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("piece_encoding", piece_encoding),
]

#: SQL can't express near-duplicate classes or piece encoding; tests/llm/test_pipeline.py holds every stage against plain Python or SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
