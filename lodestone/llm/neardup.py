"""Near-duplicate classes by word-shingle similarity: bit-sliced SimHash, exact links.

Two texts link if the sets of their word shingles have a Jaccard similarity of
``similarity`` or more. Texts with equal words are one node before that. Each
node has a SimHash of 512 bits over its set of shingles.

Deal. Nodes meet in buckets: 24 bands of five minimum hashes, of which a pair
at 0.8 shares one with probability 0.9999, whatever the number of rows. This
takes the place of masks over fingerprint bits, of which a radius this wide
needs more the more rows there are.

Compare. A bucket's fingerprints are bit planes, and distances are added up as
in ``simhash``. The radius is the distance expected at ``similarity`` and three
and a half deviations more, so a pair at the threshold passes with probability
0.9998. Nodes that are not of a bucket's largest component ask, the others are
asked. A bucket of over ``BLOCK`` nodes is a grid of blocks of that size.

Verify. What passes is decided by the intersection of the two sets; no link is
an estimate, only the candidate search is.

Only nodes of different components are compared. While a large group of copies
would give many pairs, its nodes first meet the smallest node of a bucket (one
candidate a node and round). Then each node meets the ``NEAREST`` ones of a
bucket, in a join with the sets. Where a bucket had more within the radius, its
nodes that are still apart are dealt once more, together with their sets, and
compared and verified in one place, which gives links and no pairs. No
candidate is skipped unless its ends are connected by links that hold.

Shingles and nodes are 64-bit hashes. Nulls and edges: null and wordless texts
are one node; fewer words than a shingle are one shingle; rows with a null
doc_id link nothing; repeated rows share a class; an empty table gives an
empty result; a very long text is one set, held by one task at a time; columns
other than doc_id and text are not read, so their names can't clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.simhash import SEED, majority, pairs_within, shingle_hashes, signed, whole_buckets
from lodestone.operators.graph import connected_components
from lodestone.session import map_arrow
from lodestone.sources.scratch import materialize

BANDS = 24
DEPTH = 5
WORDS = 8  # of 64 fingerprint bits
BLOCK = 1024  # nodes of a bucket that are compared in one piece
FEW = 512  # pairs a bucket row that are compared without further rounds
NEAREST = 4
PRINTS = [f"f{i}" for i in range(WORDS)]
_DRAWN = np.random.default_rng(SEED).integers(0, 1 << 64, (2, BANDS * DEPTH, 1), np.uint64)
TIMES, PLUS = _DRAWN[0] | np.uint64(1), _DRAWN[1]


def shingles(text: bytes | None, k: int) -> tuple[int, np.ndarray]:
    """A hash of the words, and the sorted distinct hashes of the shingles."""
    tokens = (text or b"").lower().split()  # bytes: ASCII letters and ASCII white space only
    joined = b" ".join(tokens)
    node = xxhash.xxh64_intdigest(joined, SEED + 1)
    return node, np.unique(shingle_hashes(tokens, joined, k)) if tokens else np.zeros(0, np.uint64)


def band_keys(found: np.ndarray) -> list[int]:
    """One key a band of the shingle hashes, signed; none without shingles."""
    if not len(found):
        return []
    least = np.full(BANDS * DEPTH, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), 4096):  # bounded memory for very long texts
        least = np.minimum(least, (found[at : at + 4096] * TIMES + PLUS).min(axis=1))
    rows = least.reshape(BANDS, DEPTH)
    return [signed(xxhash.xxh64_intdigest(rows[i].tobytes(), i)) for i in range(BANDS)]


def radius_at(similarity: float, deviations: float = 3.5) -> int:
    """Bits in which fingerprints of sets so similar differ, and some deviations more."""
    bits, angle = 64 * WORDS, math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi
    return round(bits * angle + deviations * math.sqrt(bits * angle * (1 - angle)))


def _signatures(docs: DataFrame, shingle: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [shingles(t.as_py(), shingle) for t in b.column(1)]
            prints = np.array([majority(s, WORDS) if len(s) else [0] * WORDS for _, s in made], np.uint64).reshape(len(made), WORDS).view(np.int64)
            cols = [pa.array([signed(n) for n, _ in made], pa.int64()), pa.array([len(s) for _, s in made], pa.int64()), pa.array([band_keys(s) for _, s in made], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols, *(pa.array(np.ascontiguousarray(c)) for c in prints.T)], ["doc_id", "node", "n", "keys", *PRINTS])

    return map_arrow(docs, run, "doc_id long, node long, n long, keys array<long>, " + ", ".join(f"{p} long" for p in PRINTS))


def _sets(docs: DataFrame, shingle: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in b.column(1):
                node, found = shingles(t.as_py(), shingle)
                yield pa.RecordBatch.from_arrays([pa.array([signed(node)], pa.int64()), pa.array([found.view(np.int64)], pa.list_(pa.int64()))], ["node", "found"])

    return map_arrow(docs, run, "node long, found array<long>")


def _near_size(n: Column, m: Column, similarity: float) -> Column:
    """Whether sets of n and m members can be so similar."""
    return F.least(n, m) >= similarity * F.greatest(n, m)


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v) whose sets are so similar."""
    a, b = sets.select(F.col("node").alias("u"), F.col("found").alias("a")), sets.select(F.col("node").alias("v"), F.col("found").alias("b"))
    both = pairs.join(a, "u").join(b, "v").withColumn("i", F.size(F.array_intersect("a", "b")))
    return both.where(F.col("i") >= similarity * (F.size("a") + F.size("b") - F.col("i"))).select("u", "v")


def _leads(left: DataFrame, similarity: float) -> DataFrame:
    """One candidate (u, v) of each node: the smallest node of the bucket's smallest component, where most buckets name it."""
    low = left.groupBy("key").agg(F.min(F.struct("comp", "node", "n")).alias("lead"))
    met = left.join(low, "key").where(F.col("comp") > F.col("lead.comp")).where(_near_size(F.col("n"), F.col("lead.n"), similarity))
    return met.groupBy("node", F.col("lead.node").alias("other")).agg(F.count("*").alias("c")).select("node", "other", "c")


def _near(cell: list[np.ndarray], radius: int, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows (u, v) of different components within the radius, nearest first for each u, and their distances."""
    key, block, rank, _, n, comp, *words = cell
    prints = np.array(words).view(np.uint64)
    bucket = np.cumsum(np.r_[False, (key[1:] != key[:-1]) | (block[1:] != block[:-1])])
    for u, v in pairs_within(prints, bucket, rank > 0, np.arange(64 * WORDS), radius):
        fits = (comp[u] != comp[v]) & (rank[u] + rank[v] < 4) & (np.minimum(n[u], n[v]) >= similarity * np.maximum(n[u], n[v]))
        u, v = u[fits], v[fits]
        apart = np.bitwise_count(prints[:, u] ^ prints[:, v]).sum(0)
        order = np.lexsort((apart, u))
        if len(order):
            yield u[order], v[order], apart[order]


def _nearest(radius: int, similarity: float, nearest: int):
    """Candidates (u, v), the nearest of each node; and, with a null u, the key of every bucket that has more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in whole_buckets(batches):
            key, node = cell[0], cell[3]
            for u, v, _ in _near(cell, radius, similarity):
                first = np.flatnonzero(np.r_[True, u[1:] != u[:-1]])
                take = np.arange(len(u)) - np.repeat(first, np.diff(np.r_[first, len(u)])) < nearest
                more = np.unique(key[u[~take]])
                a, b = node[u[take]], node[v[take]]
                top, low = np.r_[np.maximum(a, b), more], np.r_[np.minimum(a, b), more]
                yield pa.RecordBatch.from_arrays([pa.array(top, mask=np.arange(len(top)) >= len(a)), pa.array(low)], ["u", "v"])

    return run


def similar(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether two sorted sets are so similar."""
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared >= similarity * (len(a) + len(b) - shared)


def _verified_links(radius: int, similarity: float):
    """Links (u, v) that connect all pairs of a cell that are so similar; the rows have the sets as their last column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in whole_buckets(batches):
            node, comp, sets = cell[3], cell[5], cell.pop()
            root: dict[int, int] = {}

            def find(x: int) -> int:
                while (up := root.get(x, x)) != x:
                    x = up
                return x

            links = []
            for us, vs, _ in _near(cell, radius, similarity):
                for u, v in zip(us.tolist(), vs.tolist(), strict=True):
                    a, b = find(comp[u]), find(comp[v])
                    if a != b and similar(sets[u], sets[v], similarity):
                        root[max(a, b)] = min(a, b)
                        links.append((node[u], node[v]))
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*links, strict=True)], ["u", "v"])

    return run


def _cells() -> Column:
    """The cells (block, rank) of a row of a bucket with ``s`` nodes, ``s - c`` of which ask.

    A bucket of one block is one cell. A larger one is a grid: blocks of nodes by pieces of those that ask.
    """
    blocks, pieces = F.ceil(F.col("s") / BLOCK).cast("int"), F.greatest(F.ceil((F.col("s") - F.col("c")) / BLOCK).cast("int"), F.lit(1))
    block, piece = F.pmod(F.xxhash64("node"), blocks).cast("int"), F.pmod(F.xxhash64(F.lit(1), "node"), pieces).cast("int")
    asks = F.col("comp") != F.col("major")

    def cell(at: Column, rank: Column) -> Column:
        return F.struct(at.cast("int").alias("block"), rank.alias("rank"))

    stays = F.transform(F.sequence(F.lit(0), pieces - 1), lambda j: cell(block * pieces + j, F.lit(0)))
    visits = F.transform(F.sequence(F.lit(0), blocks - 1), lambda i: cell(i * pieces + piece, F.lit(2)))
    return F.when(blocks == 1, F.array(cell(F.lit(0), F.when(asks, 1).otherwise(0)))).when(asks, F.concat(stays, visits)).otherwise(stays)


def _dealt(left: DataFrame, sized: DataFrame, members: DataFrame) -> DataFrame:
    """Rows of open buckets by cell, with what ``members(node, ...)`` has of each node.

    rank: 0 for nodes that don't ask in a cell, 1 for those that ask and are asked, 2 for those that only ask.
    """
    rows = left.join(sized.select("key", "s", "c", "major"), "key").join(members, "node")
    extra = [c for c in members.columns if c != "node"]
    dealt = rows.withColumn("cell", F.explode(_cells())).select("key", "cell.block", "cell.rank", "node", "n", "comp", *extra)
    return dealt.repartition("key", "block").sortWithinPartitions("key", "block", "rank", "node")


def _open(labelled: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of buckets with several components, and for each such bucket its rows ``s``, those ``c`` of the largest component ``major``, and squares ``q``."""
    mixed = labelled.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select("key")
    left = materialize(labelled.join(mixed, "key"), "open")
    counts = left.groupBy("key", "comp").agg(F.count("*").alias("c"))
    sized = counts.groupBy("key").agg(F.sum("c").alias("s"), F.sum(F.expr("c * c")).alias("q"), F.max(F.struct("c", "comp")).alias("most"))
    return left, materialize(sized.select("key", "s", "q", "most.c", F.col("most.comp").alias("major")), "buckets")


def _relabelled(dealt: DataFrame, links: DataFrame) -> DataFrame:
    return dealt.join(connected_components(links), "node", "left").select("key", "node", "n", F.coalesce("component", "node").alias("comp"))


def _links(dealt: DataFrame, prints: DataFrame, sets: DataFrame, similarity: float) -> DataFrame | None:
    """Links (u, v) that connect what the candidates of ``dealt(key, node, n)`` connect; None without candidates."""
    radius = radius_at(similarity)
    labelled, links, tested, before = dealt.withColumn("comp", F.col("node")), None, None, None
    while True:
        left, sized = _open(labelled)
        rows, candidates = sized.agg(F.coalesce(F.sum("s"), F.lit(0)), F.coalesce(F.sum(F.expr("(s * s - q) div 2")), F.lit(0))).first()
        if not candidates:
            return links
        if candidates <= FEW * rows or (before is not None and 2 * candidates > before):
            break
        pairs = _leads(left, similarity).select(F.greatest("node", "other").alias("u"), F.least("node", "other").alias("v"), "node", "c")
        pairs = pairs if tested is None else pairs.join(tested, ["u", "v"], "left_anti")
        pairs = materialize(pairs.groupBy("node").agg(F.max(F.struct("c", "u", "v")).alias("p")).select("p.u", "p.v").distinct(), "candidates")
        found = materialize(_verified(pairs, sets, similarity), "verified")
        links, tested = (x if y is None else y.unionByName(x) for x, y in ((found, links), (pairs, tested)))
        labelled, before = _relabelled(dealt, links), candidates
    met = materialize(map_arrow(_dealt(left, sized, prints), _nearest(radius, similarity, NEAREST), "u long, v long").distinct(), "candidates")
    pairs = met.where("u is not null")
    pairs = pairs if tested is None else pairs.join(tested, ["u", "v"], "left_anti")
    found = materialize(_verified(pairs, sets, similarity), "verified")
    links = found if links is None else links.unionByName(found)
    crowded = materialize(met.where("u is null").select(F.col("v").alias("key")), "crowded")
    if crowded.isEmpty():
        return links
    left, sized = _open(_relabelled(dealt.join(crowded, "key", "left_semi"), links))
    rest = map_arrow(_dealt(left, sized, prints.join(sets, "node")), _verified_links(radius, similarity), "u long, v long")
    return links.unionByName(materialize(rest, "verified"))


def near_classes(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """``doc_id`` and ``component_id``, the smallest doc_id that links reach, of every row with a doc_id."""
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")).where("doc_id is not null")
    rows = materialize(_signatures(texts, shingle), "signatures")
    nodes = materialize(rows.groupBy("node").agg(F.min("doc_id").alias("first"), *(F.first(c).alias(c) for c in ("n", "keys", *PRINTS))), "nodes")
    keys = nodes.select(F.explode("keys").alias("key"), "node", "n")
    shared = keys.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key")
    dealt = materialize(keys.join(shared, "key"), "bands")
    wanted = materialize(nodes.join(dealt.select("node").distinct(), "node", "left_semi").select("node", "first", *PRINTS), "members")
    # A merge join at every size: where it is small the members might be broadcast, and the plan at 0.1 GB would say nothing of that at 30.
    chosen = texts.join(wanted.select(F.col("first").alias("doc_id")).distinct().hint("merge"), "doc_id", "left_semi")
    sets = _sets(chosen, shingle).join(wanted.select("node"), "node", "left_semi").groupBy("node").agg(F.first("found").alias("found"))
    links = _links(dealt, wanted.select("node", *PRINTS), materialize(sets, "sets"), similarity)
    if links is None:
        named = nodes.select("node", F.col("first").alias("component_id"))
    else:
        grouped = nodes.join(connected_components(links), "node", "left").select("node", "first", F.coalesce("component", "node").alias("component"))
        least = grouped.groupBy("component").agg(F.min("first").alias("component_id"))
        named = grouped.join(least, "component").select("node", "component_id")
    return rows.select("doc_id", "node").join(named, "node").select("doc_id", "component_id")


def keep_one(docs: DataFrame, **kwargs) -> DataFrame:
    """``docs`` without the rows whose near-duplicate class has a smaller doc_id.

    Rows with a null doc_id stay. Of rows that repeat the smallest doc_id all stay.
    """
    drop = near_classes(docs, **kwargs).where("component_id < doc_id").select("doc_id").distinct()
    return docs.join(drop, "doc_id", "left_anti")
