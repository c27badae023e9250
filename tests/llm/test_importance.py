"""The byte automaton against zlib and a pattern; ranks, noise and edges."""

from __future__ import annotations

import random
import zlib
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.llm import bytewords, importance
from tests.llm import brute


def texts(seed: int) -> list[str]:
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcXYZ019éß漢😀") for _ in range(rng.choice((1, 2, 3, 9, 70, 130))))
    made = ["".join(rng.choice((word(), " ", "\n", "-", "\0", "'", "\x7f")) for _ in range(rng.randrange(60))) for _ in range(80)]
    return ["", "a", " ", "a", "", "b" * 64, "c" * 65, "d" * 5000, "x" * 63 + " " + "y" * 64, *made, ""]


@pytest.mark.parametrize("piece", [1, 50, 1 << 20])
@pytest.mark.parametrize("kind", [pa.binary(), pa.large_binary()])
def test_features(monkeypatch, piece, kind):
    monkeypatch.setattr(bytewords, "PIECE", piece)
    given = texts(piece)
    column = pa.array([t.encode() for t in ["before", *given, "after"]], kind).slice(1, len(given))
    found = [Counter() for _ in given]
    for at, words in bytewords.pieces_of(column):
        for n, (last, crc) in enumerate(words.features(4), 1):
            for k, c in zip(last.tolist(), crc.tolist(), strict=True):
                found[at + words.text[k]][n, c] += 1
    for text, own in zip(given, found, strict=True):
        words = brute.FOLDED.findall(brute.lower(text))
        assert own == Counter((n, zlib.crc32(" ".join(words[i : i + n]).encode())) for n in range(1, 5) for i in range(len(words) - n + 1))


def test_ranks_over_many_partitions(spark):
    rng = random.Random(1)
    rows = [(i if i % 50 else None, rng.randrange(40), rng.random() < 0.8) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, score long, fit boolean").repartition(7)
    found = importance.ranked(df, F.col("fit"), 30).collect()
    assert len(found) == 3000
    drawn = sorted((r for r in found if r["rank"]), key=lambda r: r["rank"])
    wanted = sorted((-s, d is None, d or 0) for d, s, fit in rows if fit)
    assert [r["rank"] for r in drawn] == list(range(1, 30 * len(wanted) // 100 + 1))
    assert [(-r["score"], r["doc_id"] is None, r["doc_id"] or 0) for r in drawn] == wanted[: len(drawn)]


def test_edges(spark):
    long = " ".join(f"w{i % 7}" for i in range(50_000))
    rows = [(None, "a b c " * 9, "x"), (None, None, "x"), (4, "a b c " * 9, "x"), (4, "a b c " * 9, "x"), (6, long, "x"), (7, "", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, rank string")
    target = spark.createDataFrame([(None,), ("A b-C",)], "text string")
    found = importance.resample(docs, target, percent=100).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_features) for r in found) == [(False, 4, 27, 78), (False, 4, 27, 78), (False, 6, 50_000, 149_997), (False, 7, 0, 0), (True, 0, 0, 0), (True, 0, 27, 78)]
    assert sorted(r["rank"] for r in found if r["rank"]) == [1, 2, 3, 4]
    kept = importance.keep_drawn(docs, target, percent=50)
    assert kept.columns == docs.columns and kept.count() == 2
    assert {r.weight for r in importance.resample(docs, target.limit(0)).collect() if r.n_words == 0} == {0}


def test_the_target_is_preferred(spark):
    rng = random.Random(4)
    say = lambda words: " ".join(rng.choice(words) for _ in range(40))
    near, far = [f"near{i}" for i in range(30)], [f"far{i}" for i in range(30)]
    docs = spark.createDataFrame([(i, say(near if i % 10 == 0 else far)) for i in range(400)], "doc_id long, text string")
    target = spark.createDataFrame([(say(near),) for _ in range(30)], "text string")
    drawn = [r.doc_id for r in importance.resample(docs, target, percent=10).where("rank is not null").collect()]
    assert len(drawn) == 40 and all(d % 10 == 0 for d in drawn)
