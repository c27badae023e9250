"""Every contract against plain Python: over the small tables, and over rows made to break it."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lodestone.llm import queries
from lodestone.llm.quality import MEASURES
from lodestone.sources.tables import table
from tests.llm import brute

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def awkward() -> list[tuple]:
    """Nulls, empty and very long texts, ties, repeats, odd white space and letters."""
    rng = random.Random(5)
    words = "the quick brown fox jumps over a lazy dog while rain falls on old stone walls near river banks".split()
    passage = " ".join(rng.choice(words) + str(rng.randrange(90)) for _ in range(80))
    long = " ".join(rng.choice(words) + str(rng.randrange(500)) for _ in range(30_000))
    noise = lambda n: " ".join(rng.choice(words) + str(rng.randrange(900)) for _ in range(n))
    texts = [
        None, "", " ", "\n\t \x0b\x0c\r", "one", "one two", "  one  two\n\n three ", "ÅÄÖ Straße ΣΑΣ İstanbul ﬁne é   nbsp em \x85 x\x1cy",
        "<|endoftext|> <s> ▁ ▁▁ </s> <unk> <0x0A>", "a\0b", "tab\tand  double   spaces \n new\n\n\nlines ", "😀 emoji 👩‍👩‍👧 漢字かな", passage, passage.upper(), noise(30) + " " + passage + " " + noise(30),
        noise(10) + "\n" + passage.replace(" ", "\n") + " " + noise(5), passage + " " + passage, long, long + " tail", noise(5) + " " + long, ("same line here\n" * 40), "x " * 3000, "word " * 49, "word " * 50, "word " * 51, "word " * 200,
    ]
    rows = [(7 * i + 3, t, None if i % 5 == 0 else "en", "web" if i % 3 else None, len(t or "")) for i, t in enumerate(texts)]
    return rows + [(1000 + i, t, "en", "web", len(t or "")) for i, t in enumerate(reversed(texts))]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The awkward rows as tables, with columns whose names clash with those that the operators add."""
    path = str(tmp_path_factory.mktemp("awkward"))
    docs = spark.createDataFrame(awkward(), DOCS).withColumns({c: F.lit("x") for c in ("node", "h", "words", "row", "t", "key", "f0", "component_id", "n_words", "kept", "text_key", "at", "site", "part", "run")})
    docs.repartition(3).write.parquet(f"{path}/documents.parquet")
    docs.select(F.col("doc_id").alias("page_id"), F.concat(F.lit("http://h"), (F.col("doc_id") % 3).cast("string"), F.lit(".org/x")).alias("url"), F.col("text").alias("html"), F.lit("x").alias("sha"), F.lit("y").alias("first"), F.lit("z").alias("record")).write.parquet(f"{path}/pages.parquet")
    texts = [r[1] for r in awkward()]
    items = [(1, None), (2, ""), (3, "quick"), (4, "the quick"), (5, texts[12]), (6, " ".join((texts[17] or "").split()[500:530])), (7, "one two three"), (8, "word " * 12)]
    spark.createDataFrame([(i, t, "clash") for i, t in items], "item_id long, text string, doc_id string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame(vectors(), "vec_id long, embedding array<float>, label int, id string, code string, ints string, error string").repartition(3).write.parquet(f"{path}/embeddings.parquet")
    return path


def vectors() -> list[tuple]:
    """Nulls, values that are not finite, ties, repeated and very large components."""
    rng = random.Random(8)
    grid = [[rng.choice((-0.5, 0.0, 0.25, 0.5)) for _ in range(16)] for _ in range(60)]
    odd = [None, [], [None] * 16, [0.1] * 15 + [None], [float("nan")] * 16, [0.1] * 15 + [float("inf")], [0.0] * 16, [0.0] * 16, [1e4] * 16, [-3e5] + [0.0] * 15, [-1e-9] * 16]
    return [(i, v, None if i % 7 == 0 else i % 3, "x", "y", "z", "w") for i, v in enumerate(odd + grid + grid[:20])]


@pytest.fixture(scope="module")
def empty(spark, sf, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("empty"))
    for name in ("documents", "pages", "benchmark", "conversations", "embeddings"):
        table(spark, sf, name).limit(0).write.parquet(f"{path}/{name}.parquet")
    return path


@pytest.fixture(params=["small", "awkward"])
def where(request, sf):
    return sf if request.param == "small" else request.getfixturevalue("folder")


def rows(spark, where, name="documents", key="doc_id", text="text"):
    return [(r[0], r[1]) for r in table(spark, where, name).select(key, text).collect()]


def got(df, *columns):
    found = [tuple(r) for r in df.select(*columns).collect()]
    assert len(found) == len(set(found))
    return set(found)


def test_simhash(spark, where):
    assert got(queries.op2_simhash(spark, where), "doc_id", "fingerprint", "component_id") == brute.simhash(rows(spark, where))


def test_quality(spark, where):
    found = got(queries.op3_quality(spark, where), "doc_id", *MEASURES, "base_failed")
    assert found == {(d, *brute.measures(t)) for d, t in rows(spark, where)}
    assert queries.op3_quality(spark, where).where("kept and base_failed").isEmpty()


def test_token_files(spark, where):
    assert got(queries.op4_token_files(spark, where), "doc_id", "start", "n_tokens", "ids_crc32") == brute.token_files(rows(spark, where))


def test_pieces(spark, where):
    found = queries.op5_pieces(spark, where)
    assert got(found, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == brute.pieces(rows(spark, where))
    assert found.where("not spans_ok").isEmpty()


def test_contamination(spark, where):
    found = got(queries.op6_decontaminate(spark, where), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert found == brute.contamination(rows(spark, where), rows(spark, where, "benchmark", "item_id"))


def test_warc(spark, where):
    found = got(queries.op7_warc(spark, where), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert found == brute.warc(rows(spark, where, "pages", "page_id", "html"))


def test_repeats(spark, where):
    assert got(queries.op9_substrings(spark, where), "doc_id", "n_words", "n_removed", "kept_sha256") == brute.repeats(rows(spark, where))


def test_lines(spark, where):
    from lodestone.llm import lines

    pages = [tuple(r) for r in table(spark, where, "pages").select("page_id", lines.host(F.col("url")), lines.page_text(F.col("html"))).collect()]
    left = brute.boilerplate(pages)
    found = got(queries.op10_lines(spark, where), "page_id", "kept_sha256")
    assert found == {(k, brute.sha(t or "")) for k, t in left.items()}


def test_compaction(spark, where):
    found = got(queries.op8_compaction(spark, where), "doc_id", "text_sha256")
    assert found == {(d, None if t is None else brute.sha(t)) for d, t in rows(spark, where)}


def test_vector_codes(spark, where):
    embeddings = [tuple(r) for r in table(spark, where, "embeddings").select("vec_id", "embedding", "label").collect()]
    assert got(queries.op11_vector_codes(spark, where), "vec_id", "code", "error", "label_error", "codebooks_sha256") == brute.vector_codes(embeddings)


def test_importance(spark, where):
    found = got(queries.op12_importance(spark, where), "doc_id", "n_features", "weight", "score", "rank")
    assert found == brute.importance(rows(spark, where), [t for _, t in rows(spark, where, "benchmark", "item_id")])


def test_url_filter(spark, where):
    found = got(queries.op13_url_filter(spark, where), "page_id", "host", "path", "rule", "verdict")
    assert found == {(k, *brute.url_verdict(u, queries.URL_RULES)) for k, u in rows(spark, where, "pages", "page_id", "url")}


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_empty_tables(spark, empty, name):
    assert queries.QUERIES[name](spark, empty).collect() == []
