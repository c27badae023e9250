"""Importance resampling towards a target corpus, over hashed runs of words.

A text's features are all its runs of one to ``longest`` words, hashed to
buckets by the CRC-32 of their bytes. A bucket's gain is the logarithm of how
much more of the target than of the source falls into it; a document's weight
is the sum of its features' gains. Documents are drawn without replacement by
adding Gumbel noise, made from the id, to the weight and taking the highest.

Texts are never cut into strings. A batch's Arrow buffer is one run of bytes: a
table of 256 classes lower-cases it and tells word bytes from others, words
begin and end where the class differs from the neighbour's, and documents end
at the buffer's offsets. The CRC's automaton then advances over all words at
once, a byte a step, the words ordered by length so that those still running
are a prefix. A run of words goes on from the state that its words but the last
have reached. The few words of over ``STEPS`` bytes end in zlib's CRC, the same
automaton.

Two scans of the documents: one for the counts, of which a task sends one row a
bucket, and one for the weights. The gains are one long a bucket, whatever the
input. Ranks come from one range partitioning of ids and scores, and from the
number of rows in each range; no task sees all of them.

Nulls and edges: a null text has no words and weight 0; fewer words than
``longest`` give the runs that there are; a null doc_id has the noise of an
empty id and comes last among equals; repeated rows count each and are drawn
each, in any order among themselves; very long texts and words are hashed
whole; an empty target or source has zero counts; an empty table gives an empty
result; columns other than doc_id and text are not read in ``resample`` and
stay as they are in ``keep_drawn``, so their names can't clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.bytewords import bytes_of, pieces_of
from lodestone.session import map_arrow
from lodestone.sources.scratch import materialize


def bucket_counts(texts: DataFrame, buckets: int = 10_000, longest: int = 3, text: str = "text") -> DataFrame:
    """``bucket, n``: how many features of all texts fall into each bucket that has some."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(buckets, np.int64)
        for b in batches:
            for _, words in pieces_of(b.column(0)):
                for _, crc in words.features(longest):
                    n += np.bincount(crc % np.uint32(buckets), minlength=buckets)
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(n[used])], ["bucket", "n"])

    return map_arrow(texts.select(bytes_of(text).alias("text")), run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Each bucket's gain in thousandths: how much likelier it is in the target, with one added to every count."""
    s_all, t_all, n = float(source.sum()), float(target.sum()), len(source)
    ratios = ((t + 1.0) * (s_all + n) / ((s + 1.0) * (t_all + n)) for s, t in zip(source.tolist(), target.tolist(), strict=True))
    return np.array([math.floor(1000 * math.log(r)) for r in ratios], np.int64)


def _counted(texts: DataFrame, buckets: int, longest: int) -> np.ndarray:
    n = np.zeros(buckets, np.int64)
    for r in bucket_counts(texts, buckets, longest).collect():  # a row a bucket
        n[r["bucket"]] = r["n"]
    return n


def weights(docs: DataFrame, gain: np.ndarray, longest: int = 3) -> DataFrame:
    """``doc_id, n_words, n_features, weight`` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_words, n_features, weight = (np.zeros(b.num_rows, np.int64) for _ in range(3))
            for at, words in pieces_of(b.column(1)):
                here = slice(at, at + len(words.counts))
                n_words[here] = words.counts
                for last, crc in words.features(longest):
                    text = words.text[last]  # rises, so that a text's features are a range
                    sums = np.concatenate([np.zeros(1, np.int64), np.cumsum(gain[crc % np.uint32(len(gain))])])
                    edges = np.searchsorted(text, np.arange(len(words.counts) + 1))
                    n_features[here] += np.diff(edges)
                    weight[here] += np.diff(sums[edges])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_words), pa.array(n_features), pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), bytes_of().alias("text")), run, "doc_id long, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int = 42) -> Column:
    """Gumbel noise in thousandths, from the first 32 bits of the SHA-256 of ``seed:doc_id``."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def ranked(scored: DataFrame, drawn: Column, percent: int) -> DataFrame:
    """``scored`` with ``rank``: 1, 2, 3 ... for that percentage of the rows for which ``drawn`` is true, by falling score and rising doc_id."""
    rows = scored.withColumn("_in", F.coalesce(drawn, F.lit(False)))
    order = [F.desc("_in"), F.desc("score"), F.asc_nulls_last("doc_id")]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    number = F.monotonically_increasing_id()  # the partition in the bits from 33 up, the row below
    placed = materialize(placed.withColumn("_at", number).withColumns({"_part": F.shiftright("_at", 33), "_row": F.col("_at").bitwiseAND((1 << 33) - 1)}).drop("_at"), "placed")
    sizes = sorted((r["_part"], r["n"], r["k"]) for r in placed.groupBy("_part").agg(F.count("*").alias("n"), F.count_if("_in").alias("k")).collect())  # a row a partition
    top = percent * sum(k for *_, k in sizes) // 100
    bases, so_far = [], 0
    for part, n, _ in sizes:
        bases.append((part, so_far))
        so_far += n
    base = F.broadcast(rows.sparkSession.createDataFrame(bases, "_part long, _base long"))  # a row a partition
    rank = F.col("_base") + F.col("_row") + 1
    return placed.join(base, "_part").withColumn("rank", F.when(rank <= top, rank)).drop("_in", "_part", "_row", "_base")


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, min_words: int = 20, buckets: int = 10_000, longest: int = 3, seed: int = 42) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score, rank`` of every row; rank is null for rows that are not drawn."""
    gain = gains(_counted(docs, buckets, longest), _counted(target, buckets, longest))
    scored = weights(docs, gain, longest).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    scored = materialize(scored, "scores")  # range partitioning reads its input twice
    return ranked(scored, F.col("n_words") >= min_words, percent)


def keep_drawn(docs: DataFrame, target: DataFrame, **kwargs) -> DataFrame:
    """The rows of ``docs`` whose doc_id is drawn, as they are."""
    drawn = resample(docs, target, **kwargs).where("rank is not null").select(F.col("doc_id").alias("_drawn")).distinct()
    key = next(k for k in ("_" * i + "drawn_id" for i in range(1, 99)) if k not in {c.lower() for c in docs.columns})
    drawn = materialize(drawn.withColumnRenamed("_drawn", key), "drawn")
    return docs.join(drawn, docs["doc_id"].cast("long").eqNullSafe(drawn[key]), "left_semi")
