"""Benchmark decontamination: a prefix-filtered containment join of item windows with documents.

Items are cut into windows of ``window`` words. The elements of a window are its
``shingle``-word shingles, ordered by rarity over all documents; as a window is
contained only where all its shingles are, its rarest one is a sufficient
prefix. Documents are joined with windows on prefix shingles alone. A match
fixes where the window would have to start (positional bound) and end (length
bound), and its words are then compared with the document's, one by one.

All of it is Spark joins over working tables: windows, shingles and matches are
never on the driver, and a side is broadcast only if its size is below the
planner's threshold. Two scans of the documents, whatever the benchmark's size:
one for the counts and one for the matches. A scan gives only the places whose
shingle may be one sought, by a bitmap of at most ``BITMAP`` bits; the joins
that follow are exact.

Nulls and edges: a null text has no words; a null or wordless item has no
window; an item shorter than a window is one window; rows that repeat an
item_id count as one item; items with a null item_id mark words but are not
listed; an empty benchmark marks nothing; repeated rows of documents are rows
each; a very long text gives its places only; columns of ``docs`` may have any
names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.bytewords import FULL, Words, bytes_of, pieces_of
from lodestone.session import map_arrow
from lodestone.sources.scratch import materialize

BITMAP = 1 << 29
SLICE = 1 << 12  # bits of the bitmap that one row holds
ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


class Texts:
    """The words of some texts with the hashes of their runs. Words are hashed once, for all texts together."""

    def __init__(self, words: Words):
        self.words = words
        self.hashes = (words.advance(np.full(len(words.starts), FULL)) ^ FULL).astype(np.uint64)
        self.first = np.concatenate([np.zeros(1, np.int64), np.cumsum(words.counts)])  # each text's first word

    def runs(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """First word and hash of every k consecutive words of one text."""
        n = max(0, len(self.hashes) - k + 1)
        whole = np.flatnonzero(self.words.text[:n] == self.words.text[k - 1 : k - 1 + n])
        h = np.zeros(len(whole), np.uint64)
        for i in range(k):
            h = (h ^ self.hashes[whole + i]) * np.uint64(ODD[0])
            h ^= h >> np.uint64(29)
        return whole, h * np.uint64(ODD[1])

    def said(self, low: int, high: int) -> bytes:
        """The words from ``low`` up to ``high``, space-joined."""
        ends = self.words.starts[high - 1] + self.words.lengths[high - 1]
        return b" ".join(self.words.bytes[self.words.starts[low] : ends].tobytes().replace(b"\0", b" ").split())


def _texts(column: pa.Array) -> Iterator[tuple[int, Texts]]:
    for at, words in pieces_of(column):
        yield at, Texts(words)


def _windows(benchmark: DataFrame, size: int, shingle: int) -> DataFrame:
    """``item, window`` (its words, space-joined)``, n, k, grams``: a row for every window of every item."""
    kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.list_(pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, texts in _texts(b.column(1)):
                made = []
                for i, count in enumerate(texts.words.counts.tolist()):
                    n, k, first = min(size, count), min(shingle, count), int(texts.first[i])
                    if not count:
                        continue
                    places, hashes = texts.runs(k)
                    grams = hashes[np.searchsorted(places, first) :].view(np.int64)  # the text's own runs come first
                    item = b.column(0)[at + i].as_py()
                    made += [(item, texts.said(first + j, first + j + n).decode(), n, k, grams[j : j + n - k + 1]) for j in range(count - n + 1)]
                for low in range(0, len(made), 4096):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made[low : low + 4096], strict=True), kinds, strict=True)], ["item", "window", "n", "k", "grams"])

    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), bytes_of().alias("text")).distinct()
    return map_arrow(items, run, "item string, window string, n int, k int, grams array<long>")


class _Sieve:
    """Which of many hashes may be among the sought ones, by a bitmap over their first bits."""

    def __init__(self, hashes: DataFrame, column: str):
        n = hashes.count()
        self.bits = min(max(16, (16 * max(n, 1)).bit_length()), BITMAP.bit_length() - 1)
        slot = F.shiftrightunsigned(F.col(column), 64 - self.bits)
        sliced = hashes.select(slot.alias("slot")).distinct().groupBy(F.shiftright("slot", 12).alias("slice")).agg(F.collect_list(F.col("slot").bitwiseAND(F.lit(SLICE - 1))).alias("on"))

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                out = []
                for on in b.column(1):
                    row = np.zeros(SLICE, bool)
                    row[np.asarray(on.values)] = True
                    out.append(np.packbits(row, bitorder="little").tobytes())
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["slice", "bits"])

        self.map = np.zeros((1 << self.bits) // 8, np.uint8)
        width = SLICE // 8
        for row in map_arrow(sliced, pack, "slice long, bits binary").toLocalIterator():  # the bitmap's own size in all
            self.map[row["slice"] * width : (row["slice"] + 1) * width] = np.frombuffer(row["bits"], np.uint8)

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        """Places of the hashes that may be sought."""
        slot = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        return np.flatnonzero((self.map[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1)


def _seen(docs: DataFrame, sieve: _Sieve, lengths: list[int]) -> DataFrame:
    """``gram``: the distinct shingles of each document that may be sought."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, texts in _texts(b.column(0)):
                for k in lengths:
                    places, hashes = texts.runs(k)
                    at = sieve(hashes)
                    own, grams = texts.words.text[places[at]], hashes[at]
                    order = np.lexsort((grams, own))
                    own, grams = own[order], grams[order]
                    new = np.ones(len(own), bool)
                    new[1:] = (own[1:] != own[:-1]) | (grams[1:] != grams[:-1])
                    yield pa.RecordBatch.from_arrays([pa.array(grams[new].view(np.int64))], ["gram"])

    return map_arrow(docs.select(bytes_of().alias("text")), run, "gram long")


def _places(docs: DataFrame, sieve: _Sieve, lengths: list[int], window: int) -> DataFrame:
    """``doc_id, row_key, n_words`` of every row, and ``places``: where a prefix may stand, with the words around it."""
    kind = pa.list_(pa.struct([("gram", pa.int64()), ("pos", pa.int32()), ("before", pa.int32()), ("around", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, texts in _texts(b.column(2)):
                rows: list[list] = [[] for _ in texts.words.counts]
                for k in lengths:
                    places, hashes = texts.runs(k)
                    hits = sieve(hashes)
                    for p, gram in zip(places[hits].tolist(), hashes[hits].view(np.int64).tolist(), strict=True):
                        own = int(texts.words.text[p])
                        first, stop = int(texts.first[own]), int(texts.first[own + 1])
                        low = max(first, p - window)
                        rows[own].append({"gram": gram, "pos": p - first, "before": p - low, "around": texts.said(low, min(stop, p + window)).decode()})
                n = len(rows)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, n), b.column(1).slice(at, n), pa.array(texts.words.counts, pa.int64()), pa.array(rows, kind)], ["doc_id", "row_key", "n_words", "places"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row_key"), bytes_of().alias("text"))
    return map_arrow(texts, run, "doc_id long, row_key long, n_words long, places array<struct<gram:bigint,pos:int,before:int,around:string>>")


def _same(a: str, b: str) -> Column:
    return F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}.row_key") == F.col(f"{b}.row_key"))


def _union(starts: Column) -> Column:
    """Words covered by spans (start, n) in order of start."""
    zero = F.struct(F.lit(0).alias("covered"), F.lit(0).alias("end"))
    step = lambda s, x: F.struct((s["covered"] + F.greatest(F.lit(0), x["start"] + x["n"] - F.greatest(s["end"], x["start"]))).alias("covered"), F.greatest(s["end"], x["start"] + x["n"]).alias("end"))
    return F.aggregate(F.array_sort(starts), zero, step, lambda s: s["covered"].cast("long"))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, shingle: int = 3) -> tuple[DataFrame, DataFrame]:
    """``doc_id, row_key, n_words`` of every row, and ``doc_id, row_key, n_hit, items`` (sorted ids) of those that hold a window."""
    owned = materialize(_windows(benchmark, window, shingle), "windows")
    windows = materialize(owned.groupBy("window").agg(F.first("n").alias("n"), F.first("k").alias("k"), F.first("grams").alias("grams")), "distinct")
    lengths = sorted(r["k"] for r in windows.select("k").distinct().collect())  # no more than a shingle has words
    grams = materialize(windows.select("window", "n", F.posexplode("grams").alias("offset", "gram")), "grams")
    sought = grams.select("gram").distinct()
    counts = _seen(docs, _Sieve(sought, "gram"), lengths).groupBy("gram").agg(F.count("*").alias("docs"))
    counted = grams.join(materialize(counts, "rarity"), "gram", "left")
    least = F.min(F.struct(F.coalesce("docs", F.lit(0)).alias("docs"), "offset", "gram", "n"))
    prefixes = counted.groupBy("window").agg(least.alias("p")).where("p.docs > 0").select("window", "p.offset", "p.gram", "p.n")  # a shingle that no document has rules a window out
    prefixes = materialize(prefixes, "prefixes")
    places = materialize(_places(docs, _Sieve(prefixes.select("gram"), "gram"), lengths, window), "places")
    rows = places.select("doc_id", "row_key", "n_words", F.explode("places").alias("p")).select("doc_id", "row_key", "n_words", "p.*")
    start = F.col("pos") - F.col("offset")
    met = rows.join(prefixes, "gram").where((start >= 0) & (start + F.col("n") <= F.col("n_words")))
    there = F.array_join(F.slice(F.split("around", " "), F.col("before") - F.col("offset") + 1, F.col("n")), " ")
    hits = materialize(met.where((F.col("before") >= F.col("offset")) & (there == F.col("window"))).select("doc_id", "row_key", "window", start.alias("start"), "n"), "hits")
    # Rows that repeat give equal hits, which the sets below hold once.
    spans = hits.groupBy("doc_id", "row_key").agg(_union(F.collect_set(F.struct("start", "n"))).alias("n_hit"))
    items = hits.select("doc_id", "row_key", "window").distinct().join(owned.select("window", "item").distinct(), "window").groupBy("doc_id", "row_key").agg(F.array_sort(F.collect_set("item")).alias("items"))
    found = spans.alias("s").join(items.alias("i"), _same("s", "i"), "left").select("s.*", F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    return places.select("doc_id", "row_key", "n_words"), materialize(found, "found")


def report(docs: DataFrame, benchmark: DataFrame, **kwargs) -> DataFrame:
    """Per document: words, words hit, items found, and whether it is contaminated."""
    rows, found = contamination(docs, benchmark, **kwargs)
    joined = rows.alias("r").join(found.alias("f"), _same("r", "f"), "left")
    items = F.coalesce("items", F.array().cast("array<string>"))
    return joined.select(
        "r.doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", items), 256).alias("items_sha256"),
        F.col("n_hit").isNotNull().alias("contaminated"),
    )


def _free(name: str, df: DataFrame) -> str:
    """The name, with underscores before it until no column has it."""
    while name.lower() in {c.lower() for c in df.columns}:
        name = f"_{name}"
    return name


def keep_clean(docs: DataFrame, benchmark: DataFrame, **kwargs) -> DataFrame:
    """The rows of ``docs`` in which no window of an item occurs."""
    doc, key = (_free(f"_{name}", docs) for name in ("doc", "key"))
    hit = contamination(docs, benchmark, **kwargs)[1].select(F.col("doc_id").alias(doc), F.col("row_key").alias(key)).distinct()
    return docs.join(hit, docs["doc_id"].eqNullSafe(hit[doc]) & (F.xxhash64(docs["text"]) == hit[key]), "left_anti")
