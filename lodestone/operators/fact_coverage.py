"""Facts that documents state and an analysis leaves out, value by value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.requirements import let
from lodestone.functions.text import SENSITIVE, compared, same_said

SIMILARITY = 0.65
# Headings whose values stand as sentences of their own, and the heading of a fact without one.
BARE = ["Dokumenterte tekniske grenseverdier", "Dokumenterte arkitektur- og kontrollføringer", "Dokumenterte effektmål", "Dokumenterte milepæler"]
UNNAMED = "Dokumentert fakta"


def judged(content: Column, value: Column) -> Column:
    """A value with its ``key``, ``sensitive`` words and distinct ``tokens``, each made once, and whether a compared text has it: whole, or four fifths of its tokens and at least two."""
    hits = lambda ts: F.size(F.filter(ts, lambda t: F.contains(content, t)))
    digit = lambda w: w.rlike("[0-9]")

    def made(key: Column, ws: Column, ts: Column) -> Column:
        has = F.contains(content, key) | ((F.size(ts) > 0) & (hits(ts) >= F.greatest(F.lit(2), F.floor((F.size(ts) * 4 + 4) / 5))))
        said = F.array_join(F.filter(ws, lambda w: w.isin(SENSITIVE) | digit(w)), "\x00")
        return F.struct(value.alias("v"), key.alias("key"), said.alias("sensitive"), F.array_distinct(ts).alias("tokens"), has.alias("has"))

    return let(compared(value), lambda key: let(F.split(key, " "), lambda ws: let(F.filter(ws, lambda w: (F.length(w) > 2) | digit(w)), lambda ts: made(key, ws, ts))))


def _values(body: Column) -> Column:
    """The values of a fact's body: parted by bars where it has one, else by semicolons, without the dots behind them."""
    parts = F.when(F.contains(body, F.lit(" | ")), F.split(body, r" \| ")).otherwise(F.split(body, ";"))
    return F.filter(F.transform(parts, lambda v: F.trim(F.regexp_replace(F.regexp_replace(v, r"[.\s]+$", ""), r"^\s+", ""))), lambda v: v != "")


def left_out(content: Column, body: Column) -> Column:
    """The values of ``body`` that are not in the compared text ``content``, are not like one that is, and are not like an earlier one left out."""
    like = lambda values, x: F.exists(values, lambda y: same_said(x, y, SIMILARITY))

    def parted(marked: Column) -> Column:
        lack = F.filter(marked, lambda x: ~x["has"])
        new = let(F.filter(marked, lambda x: x["has"]), lambda have: F.filter(lack, lambda x: ~like(have, x)))
        return let(new, lambda n: F.transform(F.filter(n, lambda x, i: ~like(F.slice(n, F.lit(1), i), x)), lambda x: x["v"]))

    return let(F.transform(_values(body), lambda v: judged(content, v)), parted)


def missing_facts(facts: DataFrame, targets: DataFrame, on: list[str]) -> DataFrame:
    """``on, field, category, fact, added``: what each field of an analysis lacks of its documents' facts, as the sentence to add.

    facts: ``on, fact, category, text``, a heading, a colon and values;
    targets: ``on, field, category, text``, the fields that take facts of a
    category, with what they say now. A fact meets only the fields of its own
    analysis and category, in one join on both; its values are then judged
    within the row. A field's text is compared once, before the join.

    Nulls and edges: null and empty facts add nothing; a null text lacks every value; a value of marks alone is in every text; repeated rows
    give repeated rows; an empty table gives an empty result.
    """
    said = targets.select(*on, "field", "category", compared(F.coalesce("text", F.lit(""))).alias("_content"))
    at = F.instr(F.col("text"), ":")
    head = F.when(at > 0, F.trim(F.substring("text", F.lit(1), at - 1))).otherwise(UNNAMED)
    split = facts.where("text is not null").select(*on, "fact", "category", head.alias("_head"), F.when(at > 0, F.substring("text", at + 1, F.length("text"))).otherwise(F.col("text")).alias("_body"))
    # Exploded, not filtered: a filter would be pushed below the column and judge all values once more.
    lacking = F.filter(F.array(left_out(F.col("_content"), F.col("_body"))), lambda left: F.size(left) > 0)
    met = split.join(said, [*on, "category"]).withColumn("_left", F.explode(lacking))
    between = F.when(F.contains(F.col("_body"), F.lit(" | ")), " | ").otherwise("; ")
    added = F.when(F.col("_head").isin(BARE), F.concat(F.array_join("_left", ". "), F.lit("."))).otherwise(F.concat("_head", F.lit(": "), F.array_join("_left", "\x01"), F.lit(".")))
    return met.select(*on, "field", "category", "fact", F.replace(added, F.lit("\x01"), between).alias("added"))
