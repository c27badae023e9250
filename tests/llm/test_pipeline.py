"""Every stage of the pipeline against plain Python or SQL, on its own input, over small, awkward and empty tables."""

from __future__ import annotations

import duckdb
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from lodestone.llm.oracles import QUALITY
from lodestone.sources.tables import table
from tests.llm import brute
from tests.llm.test_contracts import DOCS, awkward
from tests.llm.test_neardup import classes

CLASHES = ("node", "key", "row", "site", "gone", "h", "n_lines", "kept", "hits", "component_id", "n_words", "_doc", "f0")


def rows(df) -> list[tuple]:
    return [tuple(r) for r in df.select("doc_id", "text", "lang", "source", "n_chars").collect()]


def good(found: list[tuple]) -> set[int]:
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar, lang varchar, source varchar, n_chars bigint)")
    con.executemany("insert into documents values (?, ?, ?, ?, ?)", found)
    return {r[0] for r in con.sql(f"select doc_id from ({QUALITY}) where kept").fetchall()}


@pytest.fixture(params=["small", "awkward"])
def given(request, spark, sf):
    """Documents and benchmark; the awkward ones with columns whose names clash with working columns."""
    if request.param == "small":
        return table(spark, sf, "documents"), [(r.item_id, r.text) for r in table(spark, sf, "benchmark").collect()], sf
    docs = spark.createDataFrame(awkward(), DOCS).withColumns({c: F.lit("x") for c in CLASHES})
    return docs, [(r.item_id, r.text) for r in table(spark, sf, "benchmark").collect()], sf


def test_stages(spark, given):
    docs, items, folder = given
    stages = dict(corpus_pipeline.STAGES)
    before = rows(docs)

    docs = stages["quality_rules"](spark, docs, folder)
    assert set(docs.columns) >= {"doc_id", "text", "lang", "source", "n_chars"}
    after = rows(docs)
    wanted = good(before)
    assert sorted(after) == sorted(r for r in before if r[0] in wanted)

    before, docs = after, stages["line_dedup"](spark, docs, folder)
    after = rows(docs)
    left = brute.boilerplate([(r[0], r[3], r[1]) for r in before])
    assert sorted(after) == sorted((d, left[d], lang, source, len(left[d])) for d, _, lang, source, _ in before)

    before, docs = after, stages["near_dedup"](spark, docs, folder)
    after = rows(docs)
    group = classes(before)
    assert sorted(after) == sorted(r for r in before if group[r[0]] == r[0])

    before, docs = after, stages["decontamination"](spark, docs, folder)
    after = rows(docs)
    hit = {r[0] for r in brute.contamination([r[:2] for r in before], items) if r[5]}
    assert sorted(after) == sorted(r for r in before if r[0] not in hit)

    found = {r.doc_id: r for r in stages["piece_encoding"](spark, docs, folder).collect()}
    own = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert set(found) == {r[0] for r in after}
    for doc, text, *_ in after:
        assert found[doc].ids == own.encode(text)
        assert found[doc].decoded_sha256 == brute.sha(own.decode(own.encode(text)))
        assert len(found[doc].begins) == len(found[doc].ends) == len(found[doc].ids)


def test_empty_tables(spark, sf, tmp_path):
    for name in ("documents", "benchmark"):
        table(spark, sf, name).limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_null_and_repeated_ids_pass_through(spark, sf):
    """Of four rows of one source two are equal, so their line is boilerplate there; without it they stay, as empty texts."""
    text = " ".join(f"word{i} and{i} so{i}" for i in range(60))
    made = [(None, text + " null", "en", "web", 1), (1, text, "en", "web", 1), (1, text, "en", "web", 1), (2, text, None, None, None), (3, text + " more words", "en", "web", 1)]
    docs, all_ids = spark.createDataFrame(made, DOCS), ["1", "1", "2", "3", "None"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert sorted(str(r.doc_id) for r in docs.collect()) == (all_ids if name in ("quality_rules", "line_dedup") else ["1", "1", "2", "None"]), name
    assert {r.text for r in docs.where("doc_id = 1").collect()} == {""}
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() == 4
