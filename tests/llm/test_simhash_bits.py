"""Bit-sliced comparison on fingerprints alone."""

from __future__ import annotations

import numpy as np

from lodestone.llm import simhash


def families(rng, n: int, words: int) -> np.ndarray:
    """Fingerprints, half of them a few bits from another one."""
    prints = rng.integers(0, 1 << 64, (words, n), np.uint64)
    for i in range(n // 2 or 1, n):
        prints[:, i] = prints[:, rng.integers(0, i)]
        for bit in rng.integers(0, 64 * words, rng.integers(0, 5)):
            prints[bit >> 6, i] ^= np.uint64(1) << np.uint64(bit & 63)
    return prints


def parts(pairs: list[tuple[int, int]], n: int) -> list[int]:
    label = list(range(n))
    for _ in range(n):
        before = list(label)
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
        if label == before:
            break
    return label


def near(prints: np.ndarray, bucket: np.ndarray, radius: int) -> list[tuple[int, int]]:
    apart = lambda i, j: int(np.bitwise_count(prints[:, i] ^ prints[:, j]).sum())
    n = len(bucket)
    return [(i, j) for i in range(n) for j in range(i) if bucket[i] == bucket[j] and apart(i, j) <= radius]


def test_links_connect_what_the_radius_connects(monkeypatch):
    rng = np.random.default_rng(1)
    for words, radius, large in ((1, 2, 4096), (1, 2, 5), (2, 5, 4096), (2, 5, 3), (8, 9, 64)):
        monkeypatch.setattr(simhash, "LARGE", large)
        for n in (0, 1, 2, 150):
            prints, bucket = families(rng, n, words), np.sort(rng.integers(0, 3, n))
            u, v = simhash.linked(prints, bucket, np.arange(64 * words), radius)
            assert parts(list(zip(u.tolist(), v.tolist(), strict=True)), n) == parts(near(prints, bucket, radius), n), (words, radius, large, n)


def test_pairs_are_those_that_ask(monkeypatch):
    rng = np.random.default_rng(2)
    monkeypatch.setattr(simhash, "CHUNK", 3)
    prints, bucket, asks = families(rng, 200, 1), np.sort(rng.integers(0, 4, 200)), rng.random(200) < 0.5
    found = [(a, b) for u, v in simhash.pairs_within(prints, bucket, asks, np.arange(64), 3) for a, b in zip(u.tolist(), v.tolist(), strict=True)]
    assert len(found) == len(set(found))
    assert set(found) == {(i, j) for i, j in near(prints, bucket, 3) if asks[i]}


def test_far_blocks_are_abandoned_after_four_planes():
    class Counted(list):
        reads = 0

        def __getitem__(self, i):
            Counted.reads += 1
            return super().__getitem__(i)

    query, others = np.array([[0]], np.uint64), np.full((1, 64), simhash.ONES)
    planes = Counted(simhash.sliced(others, np.arange(64).astype(np.uint64), np.array([0]), np.arange(64)))
    got, hits = simhash._within(query, planes, np.array([0]), np.array([simhash.ONES]), np.arange(16), 2)
    assert len(got) == len(hits) == 0
    assert Counted.reads == 4
