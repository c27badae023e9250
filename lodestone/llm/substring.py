"""Substring dedup: seed and extend over winnowed anchors.

Seed. A window of ``window`` words has one anchor, the least hash of its
``seed_words``-word grams; equal windows have equal anchors. A run of windows
with one anchor is a segment: the anchor extended both ways as far as it rules.

Extend. Equal segments are one grouped minimum, so a group of copies costs one
row a task. Where one anchor has different segments (copies that part, a shared
passage in different surroundings), the windows on both sides of the anchor are
compared one by one, but only those of the first document with each segment,
as every later document of a segment loses all of it.

Windows are known by two 64-bit hashes built by doubling (about 2**-100 for two
unequal windows). Nothing is paired inside a group, capped or dropped.

Nulls and edges: a null or wordless text has no words and an empty result;
rows with a null doc_id neither remove nor lose words; repeated rows with one
doc_id do not remove each other; texts shorter than a window are kept whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.session import map_arrow
from lodestone.sources.scratch import materialize

LONGEST = 32  # windows in a segment
FAMILIES = ((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F), (0xD6E8FEB86659FD93, 0xA0761D6478BD642F))


def _join(a: np.ndarray, b: np.ndarray, family: int) -> np.ndarray:
    """Hash of two neighbouring spans from the hashes of each."""
    x, y = (np.uint64(c) for c in FAMILIES[family])
    h = a * x + (b ^ (b >> np.uint64(29))) * y
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xE7037ED1A0B428DB)
    return h ^ (h >> np.uint64(29))


def gram_hashes(words: np.ndarray, length: int, family: int) -> np.ndarray:
    """Hash of every ``length`` consecutive word hashes, by doubling."""
    n = len(words) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, covered, power, span = None, 0, words, 1
    while span <= length:
        if length & span:
            part = power[covered:]
            out = part[:n] if out is None else _join(out[:n], part[:n], family)
            covered += span
        if span * 2 <= length:
            power = _join(power[:-span], power[span:], family)
        span *= 2
    return out[:n]


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    n = len(x) - width + 1
    if n <= 0:
        return x[:0]
    span = 1
    while span * 2 <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[:n], x[width - span : width - span + n])


def word_hashes(text: bytes | None) -> np.ndarray:
    words = (text or b"").split()  # bytes: ASCII white space only
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def segments(words: np.ndarray, window: int, seed_words: int) -> tuple[np.ndarray, ...]:
    """Start, windows, anchor, hash of the first and of the last window, of every segment."""
    anchors = sliding_min(gram_hashes(words, seed_words, 0), window - seed_words + 1)
    n = len(anchors)
    if n == 0:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),) * 3
    run = np.flatnonzero(np.r_[True, anchors[1:] != anchors[:-1]])
    within = np.arange(n) - np.repeat(run, np.diff(np.r_[run, n]))
    start = np.flatnonzero(within % LONGEST == 0)
    count = np.diff(np.r_[start, n])
    return start, count, anchors[start], gram_hashes(words, window, 0)[start], gram_hashes(words, window, 1)[start + count - 1]


def _longs(*columns: np.ndarray) -> list[pa.Array]:
    return [pa.array(np.ascontiguousarray(c).view(np.int64)) for c in columns]


def _seed_rows(window: int, seed_words: int):
    names = ["doc_id", "row_key", "start", "count", "anchor", "first", "last"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [segments(word_hashes(t.as_py()), window, seed_words) for t in b.column(2)]
            sizes = [len(f[0]) for f in found]
            if sum(sizes):
                ids, keys = (np.repeat(np.asarray(b.column(i)), sizes) for i in (0, 1))
                yield pa.RecordBatch.from_arrays(_longs(ids, keys, *(np.concatenate([f[i] for f in found]) for i in range(5))), names)

    return run, ", ".join(f"{n} long" for n in names)


def _window_rows(window: int):
    names = ["doc_id", "row_key", "start", "w1", "w2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc, key, text, at in zip(*(b.column(i) for i in range(4)), strict=True):
                packed = np.asarray(at.values)
                count = packed % 64
                start = np.repeat(packed // 64, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                words = word_hashes(text.as_py())
                out.append((np.full(len(start), doc.as_py()), np.full(len(start), key.as_py()), start, gram_hashes(words, window, 0)[start], gram_hashes(words, window, 1)[start]))
            if out:
                yield pa.RecordBatch.from_arrays(_longs(*(np.concatenate([o[i] for o in out]) for i in range(5))), names)

    return run, ", ".join(f"{n} long" for n in names)


def keyed_texts(docs: DataFrame) -> DataFrame:
    """``doc_id, row_key, text`` (bytes); row_key tells rows with one doc_id apart, and is zero where no doc_id repeats."""
    repeats = docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1")
    key = F.lit(0).cast("long") if repeats.isEmpty() else F.xxhash64("text")
    return docs.select(F.col("doc_id").cast("long"), key.alias("row_key"), F.col("text").cast("binary").alias("text"))


def removed_windows(texts: DataFrame, window: int = 50, seed_words: int = 22) -> DataFrame:
    """``doc_id, row_key, start, count``: runs of windows of ``keyed_texts`` that also start in a document with a smaller doc_id."""
    texts = texts.where("doc_id is not null and text is not null")
    seeds = materialize(map_arrow(texts, *_seed_rows(window, seed_words)), "seeds")
    segment = ["anchor", "first", "last", "count"]
    classes = materialize(seeds.groupBy(*segment).agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")), "segments")
    parting = classes.groupBy("anchor").agg(F.count("*").alias("n"), F.min("low").alias("a"), F.max("high").alias("b"))
    parting = parting.where("n > 1 and a < b").select("anchor", F.lit(True).alias("parting"))
    repeated = classes.join(parting, "anchor", "left").where("parting or low < high").select(*segment, "low", "parting")
    met = seeds.join(repeated, segment).where("doc_id > low or parting")
    met = materialize(met.select("doc_id", "row_key", "start", "count", (F.col("doc_id") > F.col("low")).alias("whole")), "met")
    sought = met.where("not whole").distinct().groupBy("doc_id", "row_key").agg(F.collect_list(F.col("start") * 64 + F.col("count")).alias("at"))
    windows = map_arrow(texts.join(sought, ["doc_id", "row_key"]).select("doc_id", "row_key", "text", "at"), *_window_rows(window))
    windows = materialize(windows, "windows")
    first = windows.groupBy("w1", "w2").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").drop("high")
    single = windows.join(first, ["w1", "w2"]).where("doc_id > low").select("doc_id", "row_key", "start", F.lit(1).cast("long").alias("count"))
    return met.where("whole").select("doc_id", "row_key", "start", "count").unionByName(single)


def covered(at: np.ndarray, words: int, window: int) -> np.ndarray:
    """Which of the words lie in a window of the runs packed as start * 64 + count."""
    edge = np.zeros(words + 1, np.int64)
    np.add.at(edge, at // 64, 1)
    np.add.at(edge, at // 64 + at % 64 + window - 1, -1)
    return np.cumsum(edge[:-1]) > 0


def _removed(window: int, emit):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text, at in zip(b.column("text"), b.column("at"), strict=True):
                words = (text.as_py() or b"").split()
                gone = covered(np.asarray(at.values), len(words), window) if at.is_valid else np.zeros(len(words), bool)
                rows.append(emit(words, gone))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c) for c in zip(*rows, strict=True))], ["doc_id", "n_words", "n_removed", "kept"])

    return run


def remove_repeats(docs: DataFrame, window: int = 50, seed_words: int = 22, digest: bool = False) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_removed`` and ``kept``: the words left, joined by one space.

    digest: give the lowercase hex SHA-256 of the kept text in place of the text.
    """
    texts = keyed_texts(docs)
    runs = removed_windows(texts, window, seed_words)
    at = runs.distinct().groupBy("doc_id", "row_key").agg(F.collect_list(F.col("start") * 64 + F.col("count")).alias("at"))

    def emit(words: list[bytes], gone: np.ndarray) -> tuple:
        text = b" ".join(words if not gone.any() else [w for w, g in zip(words, gone.tolist(), strict=True) if not g])
        return len(words), int(gone.sum()), hashlib.sha256(text).hexdigest() if digest else text.decode()

    joined = texts.join(at, ["doc_id", "row_key"], "left").select("doc_id", "text", "at")
    return map_arrow(joined, _removed(window, emit), "doc_id long, n_words long, n_removed long, kept string")
