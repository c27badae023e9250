"""Vector code compression: product codes whose nearest entries are found in vantage-point trees.

A component becomes ``floor(scale * x)``, so that all that follows is whole
numbers: squared distances, sums and quotients are exact and alike on every
machine. Vectors are cut into ``parts`` equal parts, each with a codebook of
its own. A round is one job: tasks assign their rows and send the sums and
counts of each entry (``parts * entries`` rows a task, whatever they read);
these are added up by Spark, and only the new codebooks come to the driver.

An entry is found in a vantage-point tree over the part's codebook. A subtree
keeps the least and greatest distance of its entries from the vantage point,
rounded outwards to whole numbers; a point's own distance is rounded outwards
too. By the triangle inequality a subtree can be left out where the gap exceeds
the best distance so far, itself rounded up. Subtrees at exactly that distance
are visited, as they may hold an equal distance at a lower index; the squared
distances that decide are compared as integers.

Nulls and edges: a vector that is null, empty, holds a null or non-finite
component, has no multiple of ``parts`` components, or another number of them
than the kept vector of the least id, is dropped. A null id is a row like any
other, and last in order; of rows that repeat an id the lesser vector is first.
Ties go to the lower index. With fewer vectors than entries there are as many
entries as vectors; repeated vectors give equal entries, of which the first is
used. Components beyond 2**36 count as that, distances beyond 2**62 in all as
that, and a label's error beyond a long is null. Null labels are one label. An
empty table gives an empty result. Columns other than the id, the vector and
the label are not read, so their names can't clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from lodestone.session import map_arrow
from lodestone.sources.scratch import materialize

WIDEST = 1 << 36
FARTHEST = 1 << 62
SAFE = 1 << 26  # squares of components up to here can't leave a long


def whole(vector: Column, scale: int = 4096) -> Column:
    """The components as whole numbers; null if one of them is null or not finite, or if there is none."""
    fit = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    floors = F.transform(vector, lambda x: F.floor(F.least(F.greatest(x.cast("double") * scale, F.lit(float(-WIDEST))), F.lit(float(WIDEST)))))
    return F.when(fit & (F.size(vector) > 0), floors)


def _roots(squares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Square roots rounded down and up."""
    down = np.sqrt(squares.astype(np.float64)).astype(np.int64)
    down -= down * down > squares
    down += (down + 1) * (down + 1) <= squares
    return down, down + (down * down < squares)


class VantageTree:
    """Nearest entries of one part's codebook."""

    def __init__(self, entries: np.ndarray, farthest: int = FARTHEST, leaf: int = 3):
        self.entries, self.farthest, self.leaf = entries, farthest, leaf
        self.wide = bool(len(entries)) and int(np.abs(entries).max()) > SAFE
        self.root = self._build(np.arange(len(entries)))

    def _build(self, own: np.ndarray) -> tuple:
        """(leaf entries,) or (vantage entry, cut, inner and outer child with their radii)."""
        if len(own) <= self.leaf:
            return (own.tolist(),)
        around = self._squares(self.entries[own], self.entries[own].sum(0) // len(own))
        vantage = own[np.argmax(around)]  # far out, so that distances from it differ
        rest = own[own != vantage]
        squares = self._squares(self.entries[rest], self.entries[vantage])
        cut = int(np.sort(squares)[(len(rest) - 1) // 2])
        children = []
        for side in (squares <= cut, squares > cut):
            if side.any():
                down, up = _roots(squares[side])
                children.append((int(down.min()), int(up.max()), self._build(rest[side])))
        return int(vantage), cut, children

    def _squares(self, points: np.ndarray, entry: np.ndarray) -> np.ndarray:
        gap = points - entry
        exact = np.einsum("ij,ij->i", gap, gap)
        if self.wide:
            rough = np.square(gap.astype(np.float64)).sum(1)
            exact = np.where(rough < self.farthest, np.minimum(exact, self.farthest), self.farthest)
        return exact

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of each point's nearest entry, the lowest of equals, and the squared distance."""
        own = self.wide
        self.wide = own or (len(points) > 0 and int(np.abs(points).max()) > SAFE)
        best, at = np.full(len(points), np.iinfo(np.int64).max), np.full(len(points), len(self.entries))

        def offer(rows: np.ndarray, entry: int) -> np.ndarray:
            squares = self._squares(points[rows], self.entries[entry])
            better = (squares < best[rows]) | ((squares == best[rows]) & (entry < at[rows]))
            best[rows[better]], at[rows[better]] = squares[better], entry
            return squares

        def visit(node: tuple, rows: np.ndarray) -> None:
            if len(node) == 1:
                for entry in node[0]:
                    offer(rows, entry)
                return
            vantage, cut, children = node
            squares = offer(rows, vantage)
            down, up = _roots(squares)
            inner = squares <= cut
            for side, order in ((inner, children), (~inner, children[::-1])):  # each point's own side first
                here, low, high = rows[side], down[side], up[side]
                for least, greatest, child in order:
                    reach = _roots(best[here])[1]
                    open_ = (low - greatest <= reach) & (least - high <= reach)
                    if open_.any():
                        visit(child, here[open_])

        if len(points) and len(self.entries):
            visit(self.root, np.arange(len(points)))
        self.wide = own
        return at, best


class Codebooks:
    """The entries of every part: ``values`` is (part, entry, position)."""

    def __init__(self, values: np.ndarray, scale: int):
        self.values, self.scale = values, scale
        self._trees: list[VantageTree] | None = None

    def __getstate__(self) -> dict:
        return {"values": self.values, "scale": self.scale, "_trees": None}  # each worker builds its trees

    @property
    def digest(self) -> str:
        """SHA-256 of all components, by part, entry and position, as decimal numbers joined by commas."""
        return hashlib.sha256(",".join(map(str, self.values.ravel().tolist())).encode()).hexdigest()

    def assign(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, part) indexes and squared distances of whole-number vectors."""
        parts, _, width = self.values.shape
        if self._trees is None:
            self._trees = [VantageTree(v, FARTHEST // parts) for v in self.values]
        found = [tree.nearest(np.ascontiguousarray(rows[:, p * width : (p + 1) * width])) for p, tree in enumerate(self._trees)]
        return np.stack([a for a, _ in found], 1), np.stack([d for _, d in found], 1)


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _sums(rows: DataFrame, books: Codebooks) -> DataFrame:
    """``part, entry, n, sums``: how many parts an entry has and their sums, over all rows."""
    parts, entries, width = books.values.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros(parts * entries, np.int64), np.zeros((parts * entries, width), np.int64)
        for b in batches:
            points = _vectors(b.column(0), parts * width)
            for p, at in enumerate(books.assign(points)[0].T):
                order = np.argsort(at, kind="stable")
                used, first = np.unique(at[order], return_index=True)
                sums[p * entries + used] += np.add.reduceat(points[order, p * width : (p + 1) * width], first, axis=0)
                n += np.bincount(p * entries + at, minlength=len(n))
        used = np.flatnonzero(n)
        columns = [pa.array(used // entries, pa.int32()), pa.array(used % entries, pa.int32()), pa.array(n[used]), pa.array(list(sums[used]), pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, ["part", "entry", "n", "sums"])

    partial = map_arrow(rows.select("ints"), run, "part int, entry int, n long, sums array<long>")
    exact = [F.sum(F.get("sums", F.lit(i)).cast("decimal(38,0)")).alias(f"s{i}") for i in range(width)]
    return partial.groupBy("part", "entry").agg(F.sum("n").alias("n"), *exact).select("part", "entry", "n", F.array(*[f"s{i}" for i in range(width)]).alias("sums"))


def prepare(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label", parts: int = 8, scale: int = 4096) -> tuple[DataFrame, int]:
    """A working table ``id, label, ints`` of the kept vectors, and their number of components (0 if there are none)."""
    label = F.col(f"`{label_col}`") if label_col else F.lit(None).cast("int")
    rows = vectors.select(F.col(f"`{id_col}`").alias("id"), label.alias("label"), whole(F.col(f"`{vector_col}`"), scale).alias("ints"))
    rows = materialize(rows.where(F.col("ints").isNotNull() & (F.size("ints") % parts == 0)), "vectors")
    first = rows.orderBy(F.asc_nulls_last("id"), "ints").select(F.size("ints").alias("dim")).first()
    dim = first["dim"] if first else 0
    return rows.where(F.size("ints") == dim), dim


def train(rows: DataFrame, dim: int, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> Codebooks:
    """Codebooks after ``rounds`` of assignment and replacement by floored means, from the parts of the ``entries`` least ids."""
    if entries > 256:
        raise ValueError("a code has one byte a part")
    start = rows.orderBy(F.asc_nulls_last("id"), "ints").limit(entries).collect()  # at most 256 rows
    width = dim // parts
    values = np.array([r["ints"] for r in start], np.int64).reshape(len(start), parts, width).transpose(1, 0, 2).copy()
    for _ in range(rounds if len(start) else 0):
        for r in _sums(rows, Codebooks(values, scale)).collect():  # at most parts * entries rows
            values[r["part"], r["entry"]] = [int(s) // r["n"] for s in r["sums"]]
    return Codebooks(values, scale)


def encode(rows: DataFrame, books: Codebooks) -> DataFrame:
    """``id, label``, ``code`` (one byte a part) and ``error`` (squared distances summed over the parts) of every row."""
    dim = books.values.shape[0] * books.values.shape[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, squares = books.assign(_vectors(b.column(2), dim))
            codes = pa.array([c.tobytes() for c in at.astype(np.uint8)], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), codes, pa.array(squares.sum(1))], ["id", "label", "code", "error"])

    schema = StructType([rows.schema["id"], rows.schema["label"], StructField("code", BinaryType()), StructField("error", LongType())])
    return map_arrow(rows.select("id", "label", "ints"), run, schema)


def decode(codes: DataFrame, books: Codebooks) -> DataFrame:
    """``codes`` with ``vector``: the middles of the cells of the entries that each code names."""
    parts, places = books.values.shape[0], np.arange(books.values.shape[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.frombuffer(b"".join(b.column("code").to_pylist()), np.uint8).reshape(-1, parts)
            vectors = (books.values[places, at].reshape(len(at), -1) + 0.5) / books.scale
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(list(vectors.astype(np.float32)), pa.list_(pa.float32()))], [*b.schema.names, "vector"])

    return map_arrow(codes, run, StructType([*codes.schema.fields, *codes.sparkSession.range(0).selectExpr("cast(null as array<float>) as vector").schema.fields]))


def compress(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096, **columns: str) -> DataFrame:
    """``id, label, code, error``, ``label_error`` (the error of all rows of the label) and ``codebooks_sha256``."""
    rows, dim = prepare(vectors, parts=parts, scale=scale, **columns)
    books = train(rows, dim, parts, entries, rounds, scale)
    codes = materialize(encode(rows, books), "codes")
    labels = materialize(codes.groupBy("label").agg(F.try_sum("error").alias("label_error")), "labels")  # its size is then known to the planner
    joined = codes.alias("c").join(labels.alias("l"), F.expr("c.label <=> l.label"), "left")
    return joined.select("c.*", "label_error", F.lit(books.digest).alias("codebooks_sha256"))
