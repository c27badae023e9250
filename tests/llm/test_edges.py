"""Null and repeated ids, missing sides, ties and planted junk, as the docstrings define them."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodestone.llm import chat, lines, quality, queries

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
TURNS = "pair_id long, side string, turn long, role string, text string, chosen string, n_prefix string"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents and pages with null ids, rows that repeat an id with the same and with another text."""
    path = str(tmp_path_factory.mktemp("edges"))
    rng = random.Random(3)
    passage = " ".join(f"w{rng.randrange(400)}" for _ in range(90))
    rows = [(None, passage), (None, passage), (None, None), (5, passage), (5, passage), (5, "another text"), (7, passage + " tail"), (8, None), (8, None)]
    docs = spark.createDataFrame([(d, t, "en", None, None) for d, t in rows], DOCS)
    docs.write.parquet(f"{path}/documents.parquet")
    docs.select(F.col("doc_id").alias("page_id"), F.lit("http://h.org/a").alias("url"), F.col("text").alias("html")).write.parquet(f"{path}/pages.parquet")
    spark.createDataFrame([(None, passage), (1, " ".join(passage.split()[:12])), (1, " ".join(passage.split()[:12]))], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def rows_of(df, *columns) -> Counter:
    return Counter(tuple(r) for r in df.select(*columns).collect())


def test_simhash(spark, folder):
    found = queries.op2_simhash(spark, folder)
    ids = rows_of(found, "doc_id", "component_id")
    assert found.count() == 9
    assert ids[(None, 5)] == 2 and ids[(5, 5)] >= 2 and ids[(8, 8)] == 2 and ids[(None, 8)] == 1


def test_quality(spark, folder):
    assert rows_of(queries.op3_quality(spark, folder), "doc_id", "n_words") == Counter({(None, 90): 2, (None, 0): 1, (5, 90): 2, (5, 2): 1, (7, 91): 1, (8, 0): 2})


def test_token_files(spark, folder):
    found = sorted((r.start, r.doc_id, r.n_tokens) for r in queries.op4_token_files(spark, folder).collect())
    assert [d for _, d, _ in found] == [None, None, None, 5, 5, 5, 7, 8, 8]
    assert [s for s, _, _ in found] == [sum(n for _, _, n in found[:i]) for i in range(9)]


def test_pieces(spark, folder):
    found = queries.op5_pieces(spark, folder)
    assert rows_of(found, "doc_id") == Counter({(None,): 3, (5,): 3, (7,): 1, (8,): 2})
    assert found.where("n_tokens = 0").count() == 3 and found.where("not spans_ok").isEmpty()


def test_contamination(spark, folder):
    found = rows_of(queries.op6_decontaminate(spark, folder), "doc_id", "n_words", "n_hit", "n_items", "contaminated")
    assert found == Counter({(None, 90, 90, 1, True): 2, (None, 0, 0, 0, False): 1, (5, 90, 90, 1, True): 2, (5, 2, 0, 0, False): 1, (7, 91, 90, 1, True): 1, (8, 0, 0, 0, False): 2})


def test_warc(spark, folder):
    found = rows_of(queries.op7_warc(spark, folder), "page_id", "record_type", "refers_to")
    assert found == Counter({(None, "revisit", 5): 2, (5, "response", None): 3, (7, "response", None): 1, (8, "response", None): 2, (None, "revisit", 8): 1})


def test_repeats(spark, folder):
    found = rows_of(queries.op9_substrings(spark, folder), "doc_id", "n_words", "n_removed")
    assert found == Counter({(None, 90, 0): 2, (None, 0, 0): 1, (5, 90, 0): 2, (5, 2, 0): 1, (7, 91, 90): 1, (8, 0, 0): 2})


def test_compaction(spark, folder):
    assert rows_of(queries.op8_compaction(spark, folder), "doc_id", "compacted") == Counter({(None, True): 3, (5, True): 3, (7, True): 1, (8, True): 2})


def test_lines_at_the_ratio_stay(spark):
    pages = spark.createDataFrame([(i, "a" if i < 20 else "b", f"own {i}\n  twice \nmenu" if i in (0, 1) else f"own {i}\nmenu" if i < 19 else f"own {i}" if i < 21 else None) for i in range(23)], "id long, host string, text string")
    found = {r.id: r.text for r in lines.drop_boilerplate(pages, F.col("host")).collect()}
    assert found[0] == "own 0\n  twice "  # on two of twenty pages: a tenth, not more
    assert found[5] == "own 5" and found[19] == "own 19" and found[20] == "own 20" and found[22] is None
    tight = {r.id: r.text for r in lines.drop_boilerplate(pages, F.col("host"), ratio=0.09).collect()}
    assert tight[0] == "own 0"


def test_each_measure_can_reject(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(3, 8)))
    clean = [" ".join(word() for _ in range(120)) + "\n" + "\n".join(" ".join(word() for _ in range(9)) for _ in range(10)) for _ in range(120)]
    junk = {
        "symbols": " ".join(word() + ("#$" if i % 3 == 0 else "") for i in range(120)),
        "long words": " ".join(word() * 4 for _ in range(120)),
        "lines": "\n".join([word() + " " + word()] * 8 + [" ".join(word() for _ in range(30)) for _ in range(6)]),
        "repeats": " ".join((run := [word() for _ in range(16)]) + [word() for _ in range(80)] + run),
    }
    rows = [(i, t, "en", "web", 0) for i, t in enumerate(clean)] + [(1000 + i, t, "en", "web", 0) for i, t in enumerate(junk.values())]
    found = {r.doc_id: (r.base_failed, r.kept) for r in quality.quality(spark.createDataFrame(rows, DOCS)).collect()}
    assert [found[1000 + i] for i in range(4)] == [(False, False)] * 4
    assert all(found[i] == (False, True) for i in range(120))


def test_fences_follow_their_group(spark, sf):
    """Every measure has a fence of its own in at least three groups, and one that a group with more of it moves."""
    docs = spark.read.parquet(sf.replace("sf0.001", "sf0.01") + "/documents.parquet")
    limits = quality.thresholds(quality.sketches(quality.measured(docs))).collect()
    for m in quality.RATES:
        assert len({r[f"{m}_high"] for r in limits}) >= 3, m
    rng = random.Random(2)
    line = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(9))

    def text(repeats: int) -> str:
        again = line()[:8]  # few words, so that the base rules pass
        return "\n".join([line() for _ in range(30 - repeats)] + [again] * repeats)

    rows = [(i, text(0 if i % 10 else 9), "en", "plain" if i < 400 else "lists", 0) for i in range(400)] + [(500 + i, text(12 if i % 10 else 16), "en", "lists", 0) for i in range(400)]
    fences = {r.source: r.line_rate_high for r in quality.thresholds(quality.sketches(quality.measured(spark.createDataFrame(rows, DOCS)))).collect()}
    assert fences["lists"] > fences["plain"] + 100


def test_small_groups_lean_on_their_language(spark):
    words = lambda n, size: " ".join("x" * size + str(i) for i in range(n))
    rows = [(i, words(60, 4 + i % 2), "en", "large", 0) for i in range(100)] + [(500, words(60, 30), "en", "small", 0)]
    found = {r.doc_id: r.kept for r in quality.quality(spark.createDataFrame(rows, DOCS)).collect()}
    assert not found[500] and all(found[i] for i in range(100))


def test_preferences(spark):
    def turns(pair, side, *said):
        return [(pair, side, i, role, text, "x", "y") for i, (role, text) in enumerate(said)]

    hi, answer = ("user", "hi"), ("assistant", "a")
    rows = [
        *turns(1, "chosen", ("system", None), hi, answer), *turns(1, "rejected", ("system", ""), hi, ("assistant", "b"), ("user", "c")),
        *turns(2, "chosen", hi, answer), *turns(2, "rejected", hi, answer),
        *turns(3, "chosen", hi),
        *turns(4, "chosen", hi, answer), *turns(4, "rejected", hi),
        (5, "chosen", 0, None, "same", "x", "y"), (5, "chosen", 0, None, "same", "x", "y"), (5, "rejected", 0, None, "same", "x", "y"),
        (None, "chosen", 0, "user", "lost", "x", "y"), (6, None, 0, "user", "lost", "x", "y"),
    ]
    found = {r.pair_id: r for r in chat.format_pairs(spark.createDataFrame(rows, TURNS)).collect()}
    assert set(found) == {1, 2, 3, 4, 5}
    say = lambda role, text: f"<|im_start|>{role}\n{text}<|im_end|>\n"
    assert (found[1].n_prefix, found[1].prompt) == (2, say("system", "") + say("user", "hi"))
    assert (found[1].chosen, found[1].rejected) == (say("assistant", "a"), say("assistant", "b") + say("user", "c"))
    assert [(s.text, s.train) for s in found[1].rejected_segments] == [("<|im_start|>assistant\n", False), ("b<|im_end|>\n", True), ("<|im_start|>user\n", False), ("c<|im_end|>\n", False)]
    assert (found[2].n_prefix, found[2].chosen, found[2].rejected) == (2, "", "")
    assert (found[3].n_prefix, found[3].chosen, found[3].rejected, found[3].rejected_segments) == (0, say("user", "hi"), None, None)
    assert (found[4].n_prefix, found[4].chosen, found[4].rejected) == (1, say("assistant", "a"), "")
    assert (found[5].n_prefix, found[5].chosen, found[5].rejected) == (1, say("", "same"), "")
