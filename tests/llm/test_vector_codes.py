"""Vantage-point trees against a look at every entry; codes, decoding and edges."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import vectorcodes
from lodestone.llm.vectorcodes import Codebooks, VantageTree


def looked_up(entries, points):
    squares = [[sum((int(a) - int(b)) ** 2 for a, b in zip(p, e, strict=True)) for e in entries] for p in points]
    return [min(range(len(entries)), key=lambda k: (row[k], k)) for row in squares], [min(row) for row in squares]


@pytest.mark.parametrize("spread", [2, 50, 100_000, 1 << 29])
@pytest.mark.parametrize("entries", [1, 3, 16, 200])
def test_nearest_entries(spread, entries):
    rng = np.random.default_rng(entries)
    own, points = (rng.integers(-spread, spread + 1, (n, 4)) for n in (entries, 300))
    at, squares = VantageTree(own).nearest(np.concatenate([points, own]))
    assert (at.tolist(), squares.tolist()) == looked_up(own, np.concatenate([points, own]))


def test_subtrees_are_left_out(monkeypatch):
    rng = np.random.default_rng(3)
    own = np.concatenate([rng.integers(-20, 21, (64, 4)) + 10_000 * k for k in range(4)])
    points, met = own + 1, []
    tree = VantageTree(own)
    measure = VantageTree._squares
    monkeypatch.setattr(VantageTree, "_squares", lambda self, p, e: (met.append(len(p)), measure(self, p, e))[1])
    tree.nearest(points)
    assert sum(met) < 0.5 * len(points) * len(own)


def test_distances_beyond_a_long_count_as_the_farthest():
    own = np.array([[vectorcodes.WIDEST, 0], [0, 0]])
    at, squares = VantageTree(own).nearest(np.array([[-vectorcodes.WIDEST, 0], [vectorcodes.WIDEST, 3]]))
    assert at.tolist() == [0, 0] and squares.tolist() == [vectorcodes.FARTHEST, 9]


def test_codes_name_the_entries_that_decode_gives(spark, sf):
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows, dim = vectorcodes.prepare(vectors, parts=4)
    books = vectorcodes.train(rows, dim, parts=4, entries=32, rounds=3)
    assert books.values.shape == (4, 32, dim // 4)
    found = vectorcodes.decode(vectorcodes.encode(rows, books), books).join(rows.select("id", "ints"), "id").collect()
    for r in found:
        gap = np.floor(np.array(r.vector, np.float64) * 4096) - np.array(r.ints)
        assert int((gap**2).sum()) == r.error and len(r.code) == 4


def test_more_rounds_do_not_raise_the_error_much(spark, sf):
    rows, dim = vectorcodes.prepare(spark.read.parquet(f"{sf}/embeddings.parquet"))
    errors = [vectorcodes.encode(rows, vectorcodes.train(rows, dim, rounds=n)).agg({"error": "sum"}).first()[0] for n in (0, 2, 6)]
    assert errors[0] > errors[1] > errors[2]


def test_edges(spark):
    schema = "vec_id long, embedding array<double>, label string"
    one = [0.5] * 8
    rows = [(5, one, "a"), (5, [0.25] * 8, "a"), (None, one, None), (1, [0.1] * 16, "b"), (2, [0.1] * 9, "b"), (7, [1e300] * 8, None), (0, one, "b")]
    found = {(r.id, r.code.hex(), r.error, r.label_error) for r in vectorcodes.compress(spark.createDataFrame(rows, schema), rounds=0).collect()}
    # In order: id 0, id 5 with the lesser vector, id 5, id 7, the null id; vectors of another length go.
    assert {(i, c) for i, c, *_ in found} == {(0, "00" * 8), (5, "01" * 8), (5, "00" * 8), (7, "03" * 8), (None, "00" * 8)}
    assert all((e, total) == (0, 0) for *_, e, total in found)
    assert Codebooks(np.array([[[1, 2], [3, 4]], [[-5, 6], [7, 8]]]), 1).digest == hashlib.sha256(b"1,2,3,4,-5,6,7,8").hexdigest()


def test_whole_numbers(spark):
    rows = [([0.1, -0.1, 0.0, -1 / 4096, 3.4e38],), ([None],), ([float("-inf")],), ([],), (None,)]
    found = spark.createDataFrame(rows, "v array<float>").select(vectorcodes.whole(F.col("v")).alias("w"))
    values = [r.w for r in found.collect()]
    assert values == [[409, -410, 0, -1, vectorcodes.WIDEST], None, None, None, None]
