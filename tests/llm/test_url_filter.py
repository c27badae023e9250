"""The trie and the join against a look at every entry."""

from __future__ import annotations

import random

import pytest

from lodestone.llm import urlfilter
from tests.llm import brute

LABELS = ["a", "b", "com", "net", "", "co"]
SEGMENTS = ["", "en", "e", "x", "en-us", "%20", "."]


def made(seed: int) -> tuple[list[tuple[str, str, str]], list[str | None]]:
    rng = random.Random(seed)
    host = lambda n: ".".join(rng.choice(LABELS) for _ in range(rng.randrange(1, n)))
    path = lambda n: "".join("/" + rng.choice(SEGMENTS) for _ in range(rng.randrange(n)))
    rules = [(host(4), path(4), rng.choice(("allow", "block"))) for _ in range(60)]
    urls = [f"{rng.choice(('http://', 'https://', '//', '', 'a://b://'))}{rng.choice((str.lower, str.upper))(host(6))}{path(6)}{rng.choice(('', '?q=/en/', '#/x', '?', '#'))}" for _ in range(600)]
    return rules, [*urls, None, "", "://", "http://", "http://net", "http://NET?x", "http://b.net:80/en/", "http://u@net/", "x" * 5000 + "://a." + "b." * 3000 + "net/" + "en/" * 3000]


@pytest.mark.parametrize("trie_bytes", [1 << 20, 0], ids=["trie", "join"])
@pytest.mark.parametrize("seed", [1, 2])
def test_against_every_entry(spark, trie_bytes, seed):
    rules, urls = made(seed)
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    found = urlfilter.judge(pages, spark.createDataFrame(rules, "host string, path string, verdict string"), trie_bytes=trie_bytes)
    assert found.columns == ["page_id", "url", "host", "path", "rule", "verdict"]
    assert {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in found.collect()} == {(i, *brute.url_verdict(u, rules)) for i, u in enumerate(urls)}


@pytest.mark.parametrize("trie_bytes", [1 << 20, 0], ids=["trie", "join"])
def test_edges(spark, trie_bytes):
    rules = [("Ex.org", None, "block"), (None, "/", "block"), ("com", "/", None), ("com", "/", "no"), ("a.org", "/x", "allow"), ("a.org", "/x", "block"), ("a.org", "/x", "block")]
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://ex.org", "c"), (1, "http://ex.org", "c"), (None, "http://b.com/", "c"), (2, "http://a.org/xy", "c"), (3, None, "c")], "id long, url string, host string")
    found = urlfilter.judge(pages, table, default="unknown", trie_bytes=trie_bytes)
    assert sorted(map(tuple, found.collect()), key=repr) == sorted([(1, "http://ex.org", "ex.org", "", "ex.org", "block")] * 2 + [(None, "http://b.com/", "b.com", "/", None, "unknown"), (2, "http://a.org/xy", "a.org", "/xy", "a.org/x", "block"), (3, None, "", "", None, "unknown")], key=repr)
    kept = urlfilter.keep_allowed(pages, table, trie_bytes=trie_bytes)
    assert kept.columns == pages.columns and sorted(r.host for r in kept.collect()) == ["c", "c"]
    assert urlfilter.judge(pages, table.limit(0), trie_bytes=trie_bytes).where("verdict <> 'allow' or rule is not null").isEmpty()
