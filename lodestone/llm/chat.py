"""Preference formatting of chat pairs, in DataFrame functions.

A pair is a chosen and a rejected conversation. Their longest common prefix of
turns (equal role and text) is rendered once as the prompt; what follows is
rendered as each side's completion, as segments with a loss mask: assistant
text and its end mark are trained on, everything else is masked.

All turns of a pair meet in one group, which is as long as two conversations;
no pairs are made inside a group, so a first turn that many conversations share
costs nothing.

Nulls and edges: a null role or text is an empty one; turns are ordered by
turn, then role, then text, nulls first; repeated turn rows are turns each; a
pair with one side missing has an empty prefix and a null completion for that
side; equal conversations have empty completions; rows with a null pair or side
are left out; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, STOP = "<|im_start|>", "<|im_end|>"


def _turn(t: Column) -> Column:
    return F.concat(F.lit(START), t["role"], F.lit("\n"), t["text"], F.lit(STOP + "\n"))


def _segments(turns: Column) -> Column:
    """Text and mask of each stretch of the turns: the head of a turn is masked, an assistant's text and end mark are not."""
    return F.flatten(
        F.transform(
            turns,
            lambda t: F.array(
                F.struct(F.concat(F.lit(START), t["role"], F.lit("\n")).alias("text"), F.lit(False).alias("train")),
                F.struct(F.concat(t["text"], F.lit(STOP + "\n")).alias("text"), (t["role"] == "assistant").alias("train")),
            ),
        )
    )


def format_pairs(turns: DataFrame) -> DataFrame:
    """``turns(pair_id, side, turn, role, text)``, side chosen or rejected, to one row a pair.

    ``n_prefix, prompt, chosen, rejected`` (texts), ``chosen_segments,
    rejected_segments`` (array of text and train), and the turns of each side.
    """
    clean = turns.where("pair_id is not null and side in ('chosen', 'rejected')").select(
        "pair_id",
        "side",
        F.struct(F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"),
    )
    sides = [F.array_sort(F.collect_list(F.when(F.col("side") == s, F.col("t")))).alias(s) for s in ("chosen", "rejected")]
    pairs = clean.groupBy("pair_id").agg(*sides)
    same = F.zip_with("chosen", "rejected", lambda a, b: (a["role"] == b["role"]) & (a["text"] == b["text"]))
    differs = F.array_position(F.transform(same, lambda s: F.coalesce(s, F.lit(False))), False)
    shorter = F.least(F.size("chosen"), F.size("rejected")).cast("long")
    counted = pairs.withColumn("n_prefix", F.when(differs == 0, shorter).otherwise(F.least(differs - 1, shorter)))

    def rest(side: str) -> Column:
        return F.slice(F.col(side), F.col("n_prefix").cast("int") + 1, F.greatest(F.size(side), F.lit(1)))

    def completion(side: str, value: Column) -> Column:
        return F.when(F.size(side) > 0, value)

    return counted.select(
        "pair_id",
        "n_prefix",
        F.array_join(F.transform(F.slice("chosen", F.lit(1), F.col("n_prefix").cast("int")), _turn), "").alias("prompt"),
        *[completion(s, F.array_join(F.transform(rest(s), _turn), "")).alias(s) for s in ("chosen", "rejected")],
        *[completion(s, _segments(rest(s))).alias(f"{s}_segments") for s in ("chosen", "rejected")],
        *[F.size(s).cast("long").alias(f"{s}_turns") for s in ("chosen", "rejected")],
    )


def alternatives(conversations: DataFrame) -> DataFrame:
    """Turns of ``format_pairs``: every conversation is chosen as it stands, and rejected with its last answer replaced by that of the conversation with the next id.

    A conversation without an answer, or without a next one that has any, is its
    own alternative. Last answers are one row a conversation, met by an equi-join.
    """
    last = conversations.where("role = 'assistant' and conv_id is not null").groupBy("conv_id").agg(F.max("turn").alias("_turn"), F.max_by("text", F.struct("turn", "text")).alias("_text"))
    other = last.select((F.col("conv_id") - 1).alias("conv_id"), F.col("_text").alias("_other"))
    swaps = last.join(other, "conv_id").select("conv_id", "_turn", "_other")
    turns = conversations.select("conv_id", "turn", "role", "text").join(swaps, "conv_id", "left")
    swapped = F.coalesce((F.col("role") == "assistant") & (F.col("turn") == F.col("_turn")), F.lit(False)) & F.col("_other").isNotNull()
    sides = F.array(F.struct(F.lit("chosen").alias("side"), F.col("text").alias("text")), F.struct(F.lit("rejected").alias("side"), F.when(swapped, F.col("_other")).otherwise(F.col("text")).alias("text")))
    return turns.select(F.col("conv_id").alias("pair_id"), "turn", "role", F.explode(sides).alias("s")).select("pair_id", "s.side", "turn", "role", "s.text")
