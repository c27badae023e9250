"""Grounding what was said about documents in their own words: exact places first, then the best scored one."""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.requirements import let
from lodestone.functions.text import CUT, MONTH, NUMBERED, compared, marked, sentences, unmarked, words
from lodestone.operators.containment import containments
from lodestone.session import ship
from lodestone.sources.scratch import materialize

# Words that say nothing of a place.
STOP_WORDS = ["alle", "eller", "etter", "for", "fra", "har", "ikke", "kan", "kunden", "med", "skal", "som", "til", "ved"]
LEAST, MOST, TOKENS = 12, 500, 40
EXCERPT_HITS, TEXT_HITS = 3, 4
EXCERPT_WEIGHT, TITLE_AFFINITY, REFERENCE_AFFINITY = 3, 4, 2


def _flat(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def bounded(text: Column) -> Column:
    """At most 500 characters, cut at a space unless it would cut off a quarter."""

    def cut(head: Column) -> Column:
        at = F.length(F.regexp_extract(head, r"^(.*)\s\S*$", 1))
        return F.rtrim(F.substring(head, F.lit(1), F.when(at >= MOST * 0.75, at).otherwise(MOST)))

    return F.when(F.length(text) <= MOST, text).otherwise(let(F.substring(text, 1, MOST + 1), cut))


def passages(documents: DataFrame, entries: DataFrame, project: str) -> DataFrame:
    """``project, passage, doc, title, reference, text, key, structured``: the sentences of a project's entries, lines, and runs of two and three lines.

    ``passage`` orders them: by document, entries first, then lines, then runs.
    Of passages that are alike in title, reference and text the first counts.
    """
    lines = F.filter(F.transform(F.split("text", r"\r?\n"), lambda x: F.trim(x)), lambda x: x != "")
    split = documents.select(project, "doc", "title", lines.alias("_l"))
    place = lambda kind, i, n: F.struct(F.lit(kind).alias("kind"), i.cast("int").alias("i"), F.lit(n).alias("n"))
    cut = lambda t: F.transform(let(_flat(t), lambda t: let(sentences(t), lambda s: F.when(F.size(s) > 0, s).otherwise(F.array(t)))), bounded)
    passage = lambda at, s, x: F.struct(at.alias("at"), s.cast("int").alias("s"), bounded(unmarked(x)).alias("text"))
    parts = lambda m: F.filter(F.split(m, CUT), lambda x: x != "")
    read = lambda m: F.struct(parts(m).alias("parts"), m.rlike("[.!?]$").alias("ends"), m.rlike(NUMBERED).alias("number"), m.rlike(f"(?i)^{MONTH}").alias("month"))
    none = F.slice(F.array(passage(place(2, F.lit(1), 2), F.lit(0), F.lit(""))), 1, 0)

    def every(m: Column) -> Column:
        """Sentences of lines, and those of runs that go on over a line's end: a run says nothing else that its lines, or a shorter run, didn't say."""
        line = lambda i: F.get(m, i - 1)
        said = lambda x: F.size(x["parts"]) > 0
        on = lambda a, b: said(a) & said(b) & (~a["ends"] | (a["number"] & b["month"]))
        last, first = lambda x: F.element_at(x["parts"], -1), lambda x: F.get(x["parts"], F.lit(0))

        def runs(i: Column) -> Column:
            a, b, c = line(i), line(i + 1), line(i + 2)
            two = F.when(on(a, b), F.array(passage(place(2, i, 2), F.lit(0), F.concat_ws(" ", last(a), first(b)))))
            over = F.when(~said(b), F.when(on(a, c), F.concat_ws(" ", last(a), first(c))))
            over = over.when(on(b, c), F.when(on(a, b) & (F.size(b["parts"]) == 1), F.concat_ws(" ", last(a), first(b), first(c))).otherwise(F.concat_ws(" ", last(b), first(c))))
            three = F.when(F.size(m) >= i + 2, F.when(over.isNotNull(), F.array(passage(place(2, i, 3), F.lit(0), over))))
            return F.concat(F.coalesce(two, none), F.coalesce(three, none))

        alone = F.flatten(F.transform(m, lambda x, i: F.transform(x["parts"], lambda t, j: passage(place(1, i, 1), j, t))))
        return F.when(F.size(m) >= 2, F.concat(alone, F.flatten(F.transform(F.sequence(F.lit(1), F.size(m) - 1), runs)))).otherwise(alone)

    raw = split.select(project, "doc", "title", F.explode(let(F.transform("_l", lambda x: let(marked(_flat(x)), read)), every)).alias("_p")).select(project, "doc", "title", F.col("title").alias("reference"), F.lit(False).alias("structured"), "_p.at", "_p.s", "_p.text")
    titled = documents.select(project, "doc", "title")
    listed = entries.select(project, "doc", "entry", "reference", F.col("text").alias("t")).join(titled, [project, "doc"])
    listed = listed.select(project, "doc", "title", F.coalesce(F.nullif("reference", F.lit("")), "title").alias("reference"), F.lit(True).alias("structured"), place(0, F.col("entry"), 1).alias("at"), F.posexplode(cut(F.col("t"))).alias("s", "text"))
    found = raw.unionByName(listed).where(F.length("text") >= LEAST)
    found = found.withColumns({"key": compared(F.col("text")), "passage": F.struct("doc", "at", "s")}).where(F.length("key") >= LEAST)
    same = [project, compared(F.col("title")).alias("_t"), compared(F.col("reference")).alias("_r"), "key"]
    first = found.groupBy(*same).agg(F.min_by(F.struct("passage", "doc", "title", "reference", "text", "structured"), "passage").alias("f"))
    return first.select(project, "f.*", "key", "_t", "_r")


def _refers(a: Column, b: Column) -> Column:
    """Whether one of two keys holds the other, and neither is empty."""
    return (a != "") & (b != "") & (F.contains(a, b) | F.contains(b, a))


def _tokens(text: Column) -> Column:
    return F.slice(F.filter(words(text), lambda w: ~w.isin(STOP_WORDS)), 1, TOKENS)


def _standing(needles: DataFrame, hays: DataFrame, on: list[str], needle: str, hay: str) -> DataFrame:
    """As ``containments``, of ``text`` in compared form: a needle of three words is looked up by the inner one that the fewest hays have."""
    words = F.split("text", " ")
    inner = materialize(needles.select(*on, needle, "text", F.array_distinct(F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0)))).alias("_inner")), "inner")
    own = inner.select(*on, needle, F.explode("_inner").alias("_word"))
    said = hays.select(*on, hay, F.explode(F.array_distinct(words)).alias("_word"))
    sought = materialize(own.select(*on, "_word").distinct(), "sought")
    counts = materialize(said.join(sought, [*on, "_word"]).groupBy(*on, "_word").agg(F.count("*").alias("_hays")), "counts")
    rarest = own.join(counts, [*on, "_word"], "left").groupBy(*on, needle).agg(F.min(F.struct(F.coalesce("_hays", F.lit(0)).alias("hays"), "_word")).alias("_least"))
    anchors = materialize(rarest.where("_least.hays > 0").select(*on, needle, F.col("_least._word").alias("_word")), "anchors")
    met = materialize(said.join(anchors, [*on, "_word"]).select(*on, needle, hay).distinct(), "met")
    long = met.join(inner.select(*on, needle, F.col("text").alias("_needle")), [*on, needle]).join(hays, [*on, hay]).where(F.contains("text", F.col("_needle"))).select(*on, needle, hay)
    short = inner.where(F.size("_inner") == 0).select(*on, needle, "text")
    return long.unionByName(containments(short, hays, on, needle, hay)).distinct()


def _exact(claims: DataFrame, documents: DataFrame, entries: DataFrame, found: DataFrame, project: str) -> DataFrame:
    """``project, claim, reference, excerpt`` of the claims whose excerpt stands in one document, or in one that they name."""
    texts = documents.select(project, "doc", F.lit(-1).alias("entry"), compared(F.col("text")).alias("text")).unionByName(entries.select(project, "doc", F.col("entry").cast("int").alias("entry"), compared(F.col("text")).alias("text")))
    needles = claims.where((F.length("_excerpt") >= LEAST) & (F.col("_key") != "")).select(project, "claim", F.col("_key").alias("text"))
    hays = materialize(texts.where("text <> ''").withColumn("hay", F.struct("doc", "entry")).select(project, "hay", "text"), "texts")
    held = _standing(needles, hays, [project], "claim", "hay").select(project, "claim", "hay.doc").distinct()
    named = held.join(documents.select(project, "doc", "title"), [project, "doc"]).join(claims.select(project, "claim", "_reference"), [project, "claim"])
    named = named.withColumn("_named", _refers(F.col("_reference"), compared(F.col("title"))))
    counts = Window.partitionBy(project, "claim")
    named = named.withColumns({"_docs": F.count("*").over(counts), "_own": F.count_if("_named").over(counts)})
    chosen = materialize(named.where(((F.col("_own") == 1) & F.col("_named")) | ((F.col("_own") != 1) & (F.col("_docs") == 1))).select(project, "claim", F.col("title").alias("_title")), "chosen")
    kept = needles.join(chosen.select(project, "claim"), [project, "claim"], "left_semi")
    # An excerpt is looked for in the passages of the document that it stands in, not in all of its project's.
    near = found.join(chosen.select(project, F.col("_title").alias("title")).distinct(), [project, "title"], "left_semi")
    inside = containments(kept, near.select(project, "passage", F.col("key").alias("text")), [project], "claim", "passage")
    met = inside.join(found, [project, "passage"]).join(chosen, [project, "claim"]).where(F.col("title") == F.col("_title")).join(claims.select(project, "claim", "_key", "_reference"), [project, "claim"])
    refers, longer = _refers(F.col("_reference"), compared(F.col("reference"))) | _refers(F.col("_reference"), compared(F.col("title"))), F.col("key") != F.col("_key")
    one = F.size(F.collect_set(F.when(F.col("structured"), F.col("reference"))).over(counts)) == 1
    rank = F.when(refers & longer, 1).when(longer, 2).when(refers, 3).when(F.col("structured") & one, 4).otherwise(5)
    order = F.struct(rank.alias("k"), F.when(rank == 2, ~F.col("structured")).alias("s"), F.when(rank == 2, F.length("text")).alias("n"), "passage")
    best = met.select(project, "claim", order.alias("_o"), "reference", "text").groupBy(project, "claim").agg(F.min_by(F.struct("reference", "text"), "_o").alias("b"))
    whole = chosen.join(best, [project, "claim"], "left").join(claims.select(project, "claim", "_excerpt"), [project, "claim"])
    return whole.select(project, "claim", F.coalesce("b.reference", "_title").alias("reference"), F.coalesce("b.text", "_excerpt").alias("excerpt"))


def _hits(key: Column, *tokens: Column) -> Column:
    """``e, d``: how many of each list's tokens, joined by spaces, a key holds."""

    def count(keys: pd.Series, *lists: pd.Series) -> pd.DataFrame:
        split = lru_cache(maxsize=10000)(str.split)
        return pd.DataFrame({name: [sum([t in k for t in split(x)]) for k, x in zip(keys, own, strict=True)] for name, own in zip("ed", lists, strict=True)})

    return F.pandas_udf(count, "e int, d int")(key, *tokens)


def _scored(claims: DataFrame, found: DataFrame, project: str) -> DataFrame:
    """``project, claim, reference, excerpt`` of the best passage of each claim, unless another document's is as good.

    A passage counts with three hits of the excerpt's tokens or four of the
    text's. It then has a token among all but the commonest few, so only those
    are looked up; the rest are counted where passages meet.
    """
    # Narrow rows that take long: adaptive execution would put them into too few tasks by their bytes.
    parts = int(claims.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = claims.withColumns({"_e": _tokens(F.col("_excerpt")), "_d": _tokens(F.concat_ws(" ", "title", "description"))})
    own = own.withColumns({"_need_e": F.least(F.lit(EXCERPT_HITS), F.greatest(F.lit(1), F.size("_e"))), "_need_d": F.least(F.lit(TEXT_HITS), F.greatest(F.lit(2), F.size("_d")))})
    own = materialize(own.select(project, "claim", "_e", "_d", "_need_e", "_need_d", "_reference"), "claims")
    said = found.select(project, "number", F.explode(F.array_distinct(F.split("key", " "))).alias("word"))
    vocabulary = materialize(said.groupBy(project, "word").agg(F.count("*").alias("_held")), "vocabulary")
    spoken = vocabulary.withColumnRenamed("word", "token")
    sides = [own.select(project, "claim", F.lit(k).alias("side"), F.col(f"_need_{k}").alias("need"), F.explode(f"_{k}").alias("token")) for k in ("e", "d")]
    each = sides[0].unionByName(sides[1]).groupBy(project, "claim", "side", "need", "token").agg(F.count("*").alias("times")).join(spoken, [project, "token"], "left")
    # Tokens may be passed over from the commonest on, as long as those passed over can't be hits enough.
    common = Window.partitionBy(project, "claim", "side").orderBy(F.desc(F.coalesce("_held", F.lit(0))), "token").rowsBetween(Window.unboundedPreceding, 0)
    sought = each.withColumn("_upto", F.sum("times").over(common)).where(F.col("_upto") >= F.col("need")).select(project, "claim", "token")
    sought = materialize(sought.distinct(), "sought")
    # A token has no space, so it stands in a passage if it stands in one of its words.
    tokens, texts = sought.select(project, "token", F.col("token").alias("text")).distinct(), vocabulary.select(project, "word", F.col("word").alias("text")).repartition(parts, project, "word")
    held = materialize(containments(tokens, texts, [project], "token", "word", run=5), "held")
    named = materialize(sought.join(held, [project, "token"]).select(project, "claim", "word").distinct(), "named")
    pairs = materialize(said.join(named, [project, "word"]).select(project, "claim", "number").distinct(), "pairs")
    met = pairs.repartition(parts, project, "number").join(own, [project, "claim"]).join(found.select(project, "number", "key", "_t", "_r"), [project, "number"])
    near = lambda c: F.contains("_reference", c) | F.contains(c, F.col("_reference"))
    affinity = F.when(F.col("_reference") == "", 0).when(near(F.col("_t")), TITLE_AFFINITY).when(near(F.col("_r")), REFERENCE_AFFINITY).otherwise(0)
    ship(found.sparkSession)
    held_by = _hits(F.col("key"), F.array_join("_e", " "), F.array_join("_d", " "))
    # Written, so that a pair's hits are counted once, not once for each use; texts come to the best alone.
    counted = materialize(met.select(project, "claim", "number", held_by.alias("_h"), "_need_e", "_need_d", affinity.alias("_near")), "counted")
    enough = counted.where((F.col("_h.e") >= F.col("_need_e")) | (F.col("_h.d") >= F.col("_need_d")))
    enough = enough.select(project, "claim", "number", F.col("_h.e").alias("_he"), (EXCERPT_WEIGHT * F.col("_h.e") + F.col("_h.d") + F.col("_near")).alias("_score"))
    most = materialize(enough.groupBy(project, "claim").agg(F.max("_score").alias("_score")), "most")
    top = materialize(enough.join(most, [project, "claim", "_score"]), "top").join(found, [project, "number"])
    order = F.struct((-F.col("_he")).alias("h"), F.length("text").alias("n"), "passage")
    best = top.groupBy(project, "claim").agg(F.min_by(F.struct("reference", "text"), order).alias("b"), (F.min("title") == F.max("title")).alias("sure"))
    return best.where("sure").select(project, "claim", "b.reference", F.col("b.text").alias("excerpt"))


def ground(claims: DataFrame, documents: DataFrame, entries: DataFrame, project: str) -> DataFrame:
    """``project, claim, reference, excerpt, how`` of the claims that have a place in their project's documents; the others are left out.

    claims: ``project, claim, title, description, excerpt, reference``;
    documents: ``project, doc, title, text``; entries, their structured parts:
    ``project, doc, entry, reference, text``. An excerpt that stands word for
    word in one document, or in one of several that the claim names, is replaced
    by the passage around it (``exact``). Else the passage that shares most of
    the claim's tokens is taken (``scored``), unless two documents share the
    first place. Excerpts meet texts by their rarest run of characters, tokens
    by the rarest ones, so no claim is compared with all passages.

    Nulls and edges: nulls are empty texts; an excerpt of under twelve characters is only scored; ties go to the shorter,
    then the earlier passage; texts are expected in Unicode form C; empty tables give an empty result.
    """
    claims = claims.fillna("", ["title", "description", "excerpt", "reference"])
    claims = claims.withColumns({"_excerpt": _flat(F.col("excerpt")), "_reference": compared(F.col("reference"))}).withColumn("_key", compared(F.col("_excerpt")))
    claims = materialize(claims, "claims")
    documents, entries = documents.fillna("", ["title", "text"]), entries.fillna("", ["reference", "text"])
    found = materialize(passages(documents, entries, project).withColumn("number", F.monotonically_increasing_id()), "passages")
    exact = materialize(_exact(claims, documents, entries, found, project).withColumn("how", F.lit("exact")), "exact")
    rest = claims.join(exact.select(project, "claim"), [project, "claim"], "left_anti")
    return exact.unionByName(_scored(rest, found, project).withColumn("how", F.lit("scored")))
