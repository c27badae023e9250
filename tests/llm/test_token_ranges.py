"""Grammar compression and random access, on ids alone and on written files."""

from __future__ import annotations

import json

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodestone.llm import tokenfiles
from lodestone.llm.tokenfiles import SCHEMA, Encoder, Ranges, compress, expand, fetch, write
from lodestone.sources.scratch import scratch_path
from lodestone.sources.tables import table

PATH = public_tokenizers.path("word_bpe_49k.json")


def shard(ids: np.ndarray, vocabulary: int) -> dict:
    rules, lengths, sequence = compress(ids, vocabulary)
    assert (expand(sequence, rules, vocabulary) == ids).all()
    return {"vocabulary": vocabulary, "rules": rules.tobytes(), "lengths": lengths.tobytes(), "sequence": sequence.tobytes()}


def test_any_range_is_decoded():
    rng = np.random.default_rng(3)
    phrases = [rng.integers(0, 50, n).astype(np.uint32) for n in (3, 5, 9)]
    cases = [np.concatenate([phrases[i] for i in rng.integers(0, 3, 400)]), np.full(501, 7, np.uint32), np.zeros(0, np.uint32), np.array([4], np.uint32)]
    for ids in cases:
        at = Ranges(shard(ids, 60))
        for _ in range(60):
            a, b = sorted(rng.integers(0, len(ids) + 1, 2).tolist())
            assert (at(a, b) == ids[a:b]).all(), (len(ids), a, b)


def test_rules_are_expanded_once_a_shard(monkeypatch):
    """Before: once more for every range of a shard that is read whole."""
    rng = np.random.default_rng(5)
    phrases = [rng.integers(0, 50, n).astype(np.uint32) for n in (3, 5, 9)]
    ids = np.concatenate([phrases[i] for i in rng.integers(0, 3, 400)])
    sizes = [7, 0, 300, 1, 40, *[13] * 20]
    sizes.append(len(ids) - sum(sizes))
    row, calls = shard(ids, 60) | {"doc_tokens": sizes}, []
    monkeypatch.setattr(tokenfiles, "expand", lambda *x: calls.append(1) or expand(*x))
    for rows in (row, shard(np.array([4, 5], np.uint32), 60) | {"doc_tokens": [2]}):
        found = list(tokenfiles._documents(rows, group_tokens=50))
        assert [len(x) for _, x in found] == rows["doc_tokens"] and len(calls) == 1
        calls.clear()
    assert (np.concatenate([x for _, x in tokenfiles._documents(row, group_tokens=50)]) == ids).all()


def test_marks_behind_words_are_cut_out():
    words = pa.array(["av", "ord...", "ø!?", "", "æøå,", "slutt)"], pa.large_string())
    for low in (0, 1, 2):
        at = np.array([1, 2, 4, 5]) - low
        at = at[at >= 0]
        sizes = np.array([{"ord...": 3, "ø!?": 2}.get(words[int(i) + low].as_py(), 1) for i in at])
        want = [words[int(i) + low].as_py()[-int(n) :] for i, n in zip(at, sizes, strict=True)]
        assert tokenfiles._tails(words.slice(low), at, sizes).to_pylist() == want
    assert tokenfiles._tails(words, np.zeros(0, np.int64), np.zeros(0, np.int64)).to_pylist() == []


def test_no_pair_is_left_that_repeats():
    rng = np.random.default_rng(4)
    passage = rng.integers(0, 900, 300).astype(np.uint32)
    ids = np.concatenate([np.concatenate([passage, rng.integers(0, 900, 40).astype(np.uint32)]) for _ in range(40)])
    rules, lengths, sequence = compress(ids, 1000)
    pairs, count = np.unique(np.stack([sequence[:-1], sequence[1:]]), axis=1, return_counts=True)
    assert count[pairs[0] != pairs[1]].max() < 4
    assert lengths.max() >= 200  # one symbol for most of the passage


def test_documents_are_fetched_from_the_files(spark, sf):
    docs = table(spark, sf, "documents")
    path = scratch_path(spark, "tokens")
    write(docs, path, PATH, shard_tokens=3000, parts=3)
    assert spark.read.schema(SCHEMA).parquet(path).count() > 6
    wanted = [r.doc_id for r in docs.where("doc_id % 7 = 0").collect()]
    own = Tokenizer.from_file(PATH)
    texts = {r.doc_id: r.text for r in docs.where(F.col("doc_id").isin(wanted)).collect()}
    found = {r.doc_id: r.ids for r in fetch(spark, path, wanted).collect()}
    assert found == {d: [*own.encode(t or "", add_special_tokens=False).ids, 1] for d, t in texts.items()}


def test_other_set_ups_are_encoded_whole(spark, sf):
    texts = [r.text or "" for r in table(spark, sf, "documents").select("text").collect()][:60] + ["Ünï's don't 12ab 3.14 x--y", "A  B\n C"]
    changed = json.loads(open(PATH, encoding="utf-8").read())
    changed["normalizer"]["normalizers"].pop()  # no lower case
    others = [open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read(), json.dumps(changed)]
    for spec, by_words in [*((s, False) for s in others), (open(PATH, encoding="utf-8").read(), True)]:
        own, plain = Encoder(spec), Tokenizer.from_str(spec)
        assert own.by_words is by_words
        for text, ids in zip(texts, own.encode(texts), strict=True):
            assert np.frombuffer(ids, np.uint32).tolist() == plain.encode(text, add_special_tokens=False).ids


def test_a_full_table_of_words_is_begun_anew(spark, sf, monkeypatch):
    from lodestone.llm import pieces, tokenfiles

    monkeypatch.setattr(tokenfiles, "CACHE", 60)
    monkeypatch.setattr(pieces, "CACHE", 60)
    texts = [r.text or "" for r in table(spark, sf, "documents").select("text").collect()][:40]
    own, plain = Encoder(open(PATH, encoding="utf-8").read()), Tokenizer.from_file(PATH)
    codec = pieces.Codec(pieces.model_bytes(public_tokenizers.path("piece_bpe_32k.model")))
    for text in texts:
        assert np.frombuffer(own.encode([text])[0], np.uint32).tolist() == plain.encode(text, add_special_tokens=False).ids
        assert codec.encode(text).tolist() == codec.model.encode(text)
    assert len(own.words) < 3000 and len(codec.parts) < 3000


def test_words_are_kept_without_their_marks(monkeypatch):
    """Before: a word was kept once more for all marks behind it. Ids stay right when kept words are dropped between runs."""
    from lodestone.llm import tokenfiles

    own = Encoder(open(PATH, encoding="utf-8").read())
    texts = ["ouèai, ouèai. ouèai## 3.14## (ouèai)", " it's it' 's x1! ½. ² ", "", "ouèai,! nton"]
    assert own.encode(texts) == own._direct(texts)
    assert "ouèai" in own.words and "ouèai," not in own.words and "3.14##" in own.words
    monkeypatch.setattr(tokenfiles, "CACHE", 5)
    for _ in range(2):
        assert own.encode(texts[::-1]) == own._direct(texts[::-1])
