"""Near-duplicate classes of the pipeline against all pairs of shingle sets."""

from __future__ import annotations

import random
from itertools import combinations

import corpus_pipeline
from lodestone.llm.neardup import near_classes

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def drifting() -> list[tuple]:
    """Copies with more and more words changed, some of them a large group, short and empty texts, exact copies."""
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(5000)}"
    texts = [None, "", "one two", "One  two", "one two three"]
    for _ in range(40):
        text = [word() for _ in range(rng.choice([12, 40, 120, 300]))]
        texts.append(" ".join(text))
        for _ in range(rng.randrange(1, 7)):
            for at in rng.sample(range(len(text)), max(1, round(len(text) * rng.choice([0.01, 0.02, 0.025, 0.03, 0.06])))):
                text[at] = word()
            texts.append(" ".join(text))
    hub = [word() for _ in range(200)]
    for _ in range(120):
        copy = list(hub)
        for at in rng.sample(range(200), rng.randrange(9)):
            copy[at] = word()
        texts.append(" ".join(copy))
    rng.shuffle(texts)
    return [(i, t, "en", "web", len(t or "")) for i, t in enumerate(texts)] + [(None, texts[3], "en", "web", 0), (0, texts[0], "en", "web", 0)]


def shingle_set(text: str | None) -> frozenset:
    words = (text or "").lower().split()
    k = min(5, len(words))
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if words else frozenset()


def classes(rows: list[tuple]) -> dict[int, int]:
    sets = {i: shingle_set(t) for i, t, *_ in rows if i is not None}
    root = {i: i for i in sets}

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x == y or 5 * len(x & y) >= 4 * len(x | y):
            low, high = sorted((find(a), find(b)))
            root[high] = low
    return {i: find(i) for i in sets}


def test_classes_are_those_of_all_pairs(spark):
    rows = drifting()
    found = {r.doc_id: r.component_id for r in near_classes(spark.createDataFrame(rows, DOCS)).collect()}
    expected = classes(rows)
    assert len(set(expected.values())) > 40
    missed = [i for i in expected if found[i] > expected[i]]
    false = [i for i in expected if found[i] < expected[i]]
    assert (len(missed), len(false)) == (0, 0)


def test_stage_keeps_the_smallest_of_each_class(spark, sf):
    rows = drifting()
    kept = [r.doc_id for r in corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, DOCS), sf).collect()]
    expected = classes(rows)
    assert sorted(i for i in kept if i is not None) == sorted([i for i, c in expected.items() if i == c] + [0])
    assert kept.count(None) == 1


def test_rounds_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr("lodestone.llm.neardup.FEW", 0)
    rows = drifting()
    found = {r.doc_id: r.component_id for r in near_classes(spark.createDataFrame(rows, DOCS)).collect()}
    assert found == classes(rows)


def test_blocks_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr("lodestone.llm.neardup.BLOCK", 16)
    monkeypatch.setattr("lodestone.llm.neardup.NEAREST", 1)
    rows = drifting()
    found = {r.doc_id: r.component_id for r in near_classes(spark.createDataFrame(rows, DOCS)).collect()}
    assert found == classes(rows)


def test_empty_table(spark):
    assert near_classes(spark.createDataFrame([], DOCS)).count() == 0
