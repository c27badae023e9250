"""The queries of this subpackage and their DuckDB counterparts."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import chat, decontaminate, importance, lines, pieces, tokenfiles, urlfilter, vectorcodes, warc
from lodestone.llm.compaction import Dataset
from lodestone.llm.oracles import ORACLES
from lodestone.llm.quality import MEASURES, quality
from lodestone.llm.simhash import simhash_classes
from lodestone.llm.substring import remove_repeats
from lodestone.sources.scratch import scratch_path
from lodestone.sources.tables import table


def op1_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompt and masked completions of every conversation and its alternative with another last answer."""
    found = chat.format_pairs(chat.alternatives(table(spark, sf_dir, "conversations")))

    def trained(side: str) -> Column:
        parts = F.filter(f"{side}_segments", lambda s: s["train"])
        return F.coalesce(F.length(F.array_join(F.transform(parts, lambda s: s["text"]), "")), F.lit(0)).cast("long")

    return found.select(
        "pair_id", "chosen_turns", "rejected_turns", "n_prefix", "prompt", "chosen", "rejected", trained("chosen").alias("chosen_trained"), trained("rejected").alias("rejected_trained")
    )


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of documents whose 64-bit fingerprints of 3-word shingles link at two bits."""
    found = simhash_classes(table(spark, sf_dir, "documents"), shingle=3, radius=2)
    return found.select("doc_id", F.lpad(F.lower(F.hex("f0")), 16, "0").alias("fingerprint"), "component_id")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of every document."""
    return quality(table(spark, sf_dir, "documents"), carry=["doc_id"]).select("doc_id", *MEASURES, "base_failed", "kept")


def op4_token_files(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """Every document's place in the token files and the CRC of the ids read back from them."""
    tokenizer = tokenizer or public_tokenizers.path("word_bpe_49k.json")
    return tokenfiles.round_trip(table(spark, sf_dir, "documents"), tokenizer, end_id=1)


def op5_pieces(spark: SparkSession, sf_dir: str, model: str | None = None) -> DataFrame:
    """Digests of every document's piece ids and of the text that they decode to."""
    model = model or public_tokenizers.path("piece_bpe_32k.model")
    return pieces.encode_digests(table(spark, sf_dir, "documents"), model)


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie in a 10-word window of a benchmark item."""
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of every page's record, read back from the archives."""
    return warc.round_trip(table(spark, sf_dir, "pages"), dedup_bytes=0)


def op8_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as read from the compacted dataset, and whether no tier has as many runs as it may.

    The documents arrive in eight batches, by source, so that sizes differ.
    """
    docs = table(spark, sf_dir, "documents")
    dataset = Dataset(spark, scratch_path(spark, "shards"), docs.schema)
    dataset.append_batches(docs, F.pmod(F.xxhash64("source"), F.lit(8)))
    dataset.compact()
    dataset.vacuum()
    tiers = [r["tier"] for r in dataset.runs()]
    compacted = all(tiers.count(t) < dataset.fanout for t in tiers)
    return dataset.read().select("doc_id", "lang", "source", "n_chars", F.sha2("text", 256).alias("text_sha256"), F.lit(compacted).alias("compacted"))


def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the 50-word passages that start in an earlier one."""
    found = remove_repeats(table(spark, sf_dir, "documents"), window=50, digest=True)
    return found.select("doc_id", "n_words", "n_removed", F.col("kept").alias("kept_sha256"))


def op10_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's text without the lines that over a tenth of its host's pages, and two of them, hold."""
    pages = table(spark, sf_dir, "pages").select("page_id", lines.host(F.col("url")).alias("host"), lines.page_text(F.col("html")).alias("text"))
    found = lines.drop_boilerplate(pages, F.col("host"))
    return found.select("page_id", "host", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product codes of every vector, with its error, its label's and the codebooks' digest."""
    found = vectorcodes.compress(table(spark, sf_dir, "embeddings"), parts=8, entries=16, rounds=6, scale=4096)
    return found.select(F.col("id").alias("vec_id"), F.lower(F.hex("code")).alias("code"), "error", "label_error", "codebooks_sha256")


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight and score of every document against the benchmark, and the rank of the five percent drawn."""
    found = importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), percent=5, min_words=20)
    return found.select("doc_id", "n_features", "weight", "score", "rank")


#: Entries of the production filter: host, beginning of the path, verdict.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The deciding entry and verdict of every page's URL."""
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urlfilter.judge(table(spark, sf_dir, "pages"), rules).select("page_id", "host", "path", "rule", "verdict")


__all__ = ["ORACLES", "QUERIES"]

QUERIES = {
    "op1_preferences": op1_preferences,
    "op2_simhash": op2_simhash,
    "op3_quality": op3_quality,
    "op4_token_files": op4_token_files,
    "op5_pieces": op5_pieces,
    "op6_decontaminate": op6_decontaminate,
    "op7_warc": op7_warc,
    "op8_compaction": op8_compaction,
    "op9_substrings": op9_substrings,
    "op10_lines": op10_lines,
    "op11_vector_codes": op11_vector_codes,
    "op12_importance": op12_importance,
    "op13_url_filter": op13_url_filter,
}
