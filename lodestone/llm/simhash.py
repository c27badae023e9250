"""SimHash near-duplicate classes by bit-sliced comparison.

Fingerprints are made where the text is read. Distinct fingerprints are dealt
to tables by masks over their bits; inside a bucket they are stored vertically
(one 64-lane word per bit plane), a query's distances to 64 lanes are added up
with carry-save bitwise counters, and words whose lanes all exceed the radius
are abandoned, which is looked at every four planes. A bucket gives a spanning
forest of its links, never all pairs.

``exact_masks`` finds every pair within the radius (pigeonhole over byte-sized
blocks): a bucket of the radius-2 form holds at most 2**16 distinct
fingerprints whatever the input. Word-shingle similarity, which needs wide
fingerprints and large radii, is in ``neardup``; it compares by the same code.

Nulls and edges: a null or wordless text has fingerprint zero; rows with a null
doc_id keep their fingerprint and take the class of their text, which is null
if only such rows have it; repeated rows share a class; an empty table gives
an empty result; columns other than doc_id and text are not read, so their
names can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.graph import connected_components
from lodestone.session import map_arrow
from lodestone.sources.scratch import materialize

SEED = 42
CHUNK = 1 << 16
LARGE = 4096
ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th further 64-bit hash made from ``h``."""
    x = h + np.uint64(0x9E3779B97F4A7C15 * k & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(tokens: list[bytes], joined: bytes, shingle: int) -> np.ndarray:
    """XXH64 of every ``shingle`` consecutive tokens, space-joined; of all of them if there are fewer."""
    k = min(shingle, len(tokens))
    ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
    stops, starts = ends[k - 1 :].tolist(), [0, *(ends[: len(tokens) - k] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)), np.uint64, len(stops))


def majority(h: np.ndarray, words: int) -> list[int]:
    """``words`` 64-bit words, unsigned; a bit is set where over half of the hashes have it."""
    out = []
    for w in range(words):
        x = _mixed(h, w) if w else h
        total = np.zeros(64, np.int64)
        for at in range(0, len(h), 1 << 15):  # bounded memory for very long texts
            part = x[at : at + (1 << 15)]
            total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out.append(int(np.packbits(total * 2 > len(h), bitorder="little").view(np.uint64)[0]))
    return out


def fingerprint(text: bytes | None, shingle: int) -> int:
    """The 64-bit fingerprint of one text, unsigned."""
    tokens = (text or b"").lower().split()  # bytes: ASCII letters and ASCII white space only
    return majority(shingle_hashes(tokens, b" ".join(tokens), shingle), 1)[0] if tokens else 0


def with_fingerprints(docs: DataFrame, shingle: int) -> DataFrame:
    """``doc_id`` and the long column ``f0`` of every row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints = np.array([fingerprint(t.as_py(), shingle) for t in b.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(prints.view(np.int64))], ["doc_id", "f0"])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")), run, "doc_id long, f0 long")


def exact_masks(radius: int, bits: int = 64) -> list[int]:
    """Masks over one word such that any two words within ``radius`` agree under one of them.

    Bits fall into ``radius + 6`` blocks; a mask keeps all blocks but ``radius``.
    """
    n = radius + 6
    edges = [bits * i // n for i in range(n + 1)]
    blocks = [sum(1 << b for b in range(edges[i], edges[i + 1])) for i in range(n)]
    return [((1 << bits) - 1) & ~sum(blocks[i] for i in gone) for gone in combinations(range(n), radius)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _forest(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """For each of n nodes the smallest node that the pairs reach."""
    label = np.arange(n)
    while len(u):
        low = np.minimum(label[u], label[v])
        before = label.copy()
        np.minimum.at(label, u, low)
        np.minimum.at(label, v, low)
        label = label[label]
        if (label == before).all():
            break
    return label


def _within(query: np.ndarray, planes: np.ndarray, at: np.ndarray, lanes: np.ndarray, bits: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Lanes within the radius. query: (words, n) fingerprints; planes: (bit, word); at: the word each query reads; lanes: its lanes of interest.

    Returns the indices of the queries with such lanes, and the lanes.
    """
    levels = max(2, radius.bit_length())
    alive = np.flatnonzero(lanes)
    lanes, at, query = lanes[alive], at[alive], query[:, alive]
    count = [np.zeros(len(alive), np.uint64) for _ in range(levels)]
    over = ~lanes

    def exceeding() -> np.ndarray:
        more, equal = np.zeros(len(alive), np.uint64), np.full(len(alive), ONES)
        for k in range(levels - 1, -1, -1):
            if radius >> k & 1:
                equal = equal & count[k]
            else:
                more = more | (equal & count[k])
                equal = equal & ~count[k]
        return more

    def differs(p: int) -> np.ndarray:
        return planes[p][at] ^ (np.uint64(0) - ((query[p >> 6] >> np.uint64(p & 63)) & np.uint64(1)))

    order = bits.tolist()
    for i in range(0, len(order), 2):
        a = differs(order[i])
        b = differs(order[i + 1]) if i + 1 < len(order) else np.zeros(len(alive), np.uint64)
        x = count[0] ^ a  # carry-save: three planes of weight one become a sum and a carry
        carry = (count[0] & a) | (x & b)
        count[0] = x ^ b
        for k in range(1, levels):
            count[k], carry = count[k] ^ carry, count[k] & carry
        over |= carry
        if i % 4 == 2:
            over |= exceeding()
            keep = np.flatnonzero(over != ONES)  # abandon the blocks whose lanes all exceed the radius
            if len(keep) == 0:
                return alive[:0], lanes[:0]
            if len(keep) < 0.8 * len(alive):
                alive, lanes, at, query, over = alive[keep], lanes[keep], at[keep], query[:, keep], over[keep]
                count = [c[keep] for c in count]
    hits = lanes & ~over & ~exceeding()
    found = np.flatnonzero(hits)
    return alive[found], hits[found]


def _lanes_of(hits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.nonzero(np.unpackbits(hits.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))


def sliced(prints: np.ndarray, lane: np.ndarray, starts: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Bit planes of the fingerprints: one 64-lane word for each run that begins at ``starts``."""
    planes = np.zeros((64 * len(prints), len(starts)), np.uint64)
    for p in bits.tolist():
        planes[p] = np.bitwise_or.reduceat(((prints[p >> 6] >> np.uint64(p & 63)) & np.uint64(1)) << lane, starts)
    return planes


def pairs_within(prints: np.ndarray, bucket: np.ndarray, asks: np.ndarray, bits: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indices (u, v), in pieces, of the pairs of each bucket within the radius: u asks, and v comes before it.

    prints: (words, n) uint64; bucket: (n,), equal values adjacent; asks: (n,) bool; bits: the planes to compare.
    All pairs of one u are in one piece.
    """
    n = len(bucket)
    if not n:
        return
    first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    own = np.diff(np.r_[first, n])
    words = -(-own // 64)
    local = np.arange(n) - np.repeat(first, own)
    base = np.repeat(np.cumsum(words) - words, own)
    word, lane = base + local // 64, (local % 64).astype(np.uint64)
    starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
    planes = sliced(prints, lane, starts, bits)
    reads = np.where(asks, local // 64 + 1, 0)  # a row reads the words up to its own, so each pair is met once
    stop = np.cumsum(reads)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(stop, (stop[lo - 1] if lo else 0) + CHUNK, "right")))
        q = np.repeat(np.arange(lo, hi), reads[lo:hi])
        k = np.arange(len(q)) - np.repeat(np.cumsum(reads[lo:hi]) - reads[lo:hi], reads[lo:hi])
        at = base[q] + k
        lanes = np.where(at == word[q], (np.uint64(1) << lane[q]) - np.uint64(1), ONES)
        got, hits = _within(prints[:, q], planes, at, lanes, bits, radius)
        i, j = _lanes_of(hits)
        if len(i):
            yield q[got[i]], starts[at[got[i]]] + j
        lo = hi


def linked(prints: np.ndarray, bucket: np.ndarray, bits: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices (u, v) of links that connect, within each bucket, what the radius connects."""
    n = len(bucket)
    first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if n else np.zeros(0, np.int64)
    size = np.diff(np.r_[first, n])
    us, vs = [], []
    some = np.flatnonzero((np.repeat(size, size) >= 2) & (np.repeat(size, size) <= LARGE))
    for u, v in pairs_within(prints[:, some], bucket[some], np.ones(len(some), bool), bits, radius):
        nodes, ends = np.unique(np.r_[u, v], return_inverse=True)
        label = _forest(ends[: len(u)], ends[len(u) :], len(nodes))
        moved = np.flatnonzero(label != np.arange(len(nodes)))
        us.append(some[nodes[moved]])
        vs.append(some[nodes[label[moved]]])
    for a, s in zip(first[size > LARGE], size[size > LARGE], strict=True):
        u, v = _spread(prints[:, a : a + s], bits, radius)
        us.append(a + u)
        vs.append(a + v)
    none = np.zeros(0, np.int64)
    return (np.concatenate(us), np.concatenate(vs)) if us else (none, none)


def _spread(f: np.ndarray, bits: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of one large bucket: breadth first, comparing with lanes not reached yet."""
    m = f.shape[1]
    lane = (np.arange(m) % 64).astype(np.uint64)
    starts = np.arange(0, m, 64)
    planes = sliced(f, lane, starts, bits)
    left = np.bitwise_or.reduceat(np.uint64(1) << lane, starts)
    us, vs, front, seed = [], [], [], 0
    while True:
        if not front:
            rest = np.flatnonzero(left)
            if not len(rest):
                break
            seed = int(rest[0]) * 64 + int(left[rest[0]] & (~left[rest[0]] + np.uint64(1))).bit_length() - 1
            left[seed // 64] &= ~(np.uint64(1) << np.uint64(seed % 64))
            front = [seed]
        batch, front = front[:64], front[64:]
        open_words = np.flatnonzero(left)
        if not len(open_words):
            break
        q, at = np.repeat(batch, len(open_words)), np.tile(open_words, len(batch))
        got, hits = _within(f[:, q], planes, at, left[at], bits, radius)
        i, j = _lanes_of(hits)
        u, v = q[got[i]], at[got[i]] * 64 + j
        v, once = np.unique(v, return_index=True)
        us.append(u[once])
        vs.append(v)
        np.bitwise_and.at(left, v // 64, ~(np.uint64(1) << (v % 64).astype(np.uint64)))
        front += v.tolist()
    none = np.zeros(0, np.int64)
    return (np.concatenate(us), np.concatenate(vs)) if us else (none, none)


def _values(column: pa.Array) -> np.ndarray:
    """A column as an array; of arrays if it is one of lists."""
    if not pa.types.is_list(column.type):
        return np.asarray(column)
    out = np.empty(len(column), object)
    for i, x in enumerate(column):
        out[i] = np.asarray(x.values)
    return out


def whole_buckets(batches: Iterator[pa.RecordBatch], keys: int = 2) -> Iterator[list[np.ndarray]]:
    """The columns of the batches, cut where the first ``keys`` columns change, so that no bucket is parted."""
    held: list[np.ndarray] | None = None
    for batch in batches:
        cols = [_values(batch.column(i)) for i in range(batch.num_columns)]
        if held is not None:
            cols = [np.concatenate([x, y]) for x, y in zip(held, cols, strict=True)]
        fresh = np.zeros(max(len(cols[0]) - 1, 0), bool)
        for c in cols[:keys]:
            fresh |= c[1:] != c[:-1]
        cut = int(np.flatnonzero(np.r_[True, fresh])[-1]) if len(cols[0]) else 0
        held = [x[cut:] for x in cols]  # the last bucket may go on in the next batch
        if cut:
            yield [x[:cut] for x in cols]
    if held is not None and len(held[0]):
        yield held


def fingerprint_links(classes: DataFrame, radius: int) -> DataFrame:
    """Links (u, v) between the ``node`` values of ``classes(node, f0)`` that the radius connects."""
    masks = exact_masks(radius)
    keys = F.array(*(F.col("f0").bitwiseAND(F.lit(signed(m))) for m in masks))
    dealt = classes.select("node", "f0", F.posexplode(keys).alias("t", "key"))
    free = [np.array([b for b in range(64) if not m >> b & 1]) for m in masks]  # equal keys mean equal bits under the mask

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, key, node, f0 in whole_buckets(batches):
            prints = f0.view(np.uint64).reshape(1, -1)
            for table in np.unique(t):
                a, b = np.searchsorted(t, [table, table + 1])
                u, v = linked(prints[:, a:b], key[a:b], free[table], radius)
                if len(u):
                    yield pa.RecordBatch.from_arrays([pa.array(node[a:b][u]), pa.array(node[a:b][v])], ["u", "v"])

    ordered = dealt.repartition("t", "key").sortWithinPartitions("t", "key").select("t", "key", "node", "f0")
    return map_arrow(ordered, run, "u long, v long")


def simhash_classes(docs: DataFrame, shingle: int = 3, radius: int = 2) -> DataFrame:
    """``doc_id``, ``f0``, and ``component_id``: the smallest doc_id that links of ``radius`` bits or fewer reach."""
    prints = materialize(with_fingerprints(docs, shingle), "fingerprints")
    classes = materialize(prints.groupBy("f0").agg(F.min("doc_id").alias("node")), "classes").where("node is not null")
    groups = connected_components(fingerprint_links(classes, radius))
    named = classes.join(groups, "node", "left").select("f0", F.coalesce("component", "node").alias("component_id"))
    return prints.join(named, "f0", "left")
