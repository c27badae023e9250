"""One ledger for several sources: a customer's rows that a formal document states as well go, the rest is ranked anew."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.language import pattern
from lodestone.functions.requirements import let
from lodestone.sources.scratch import materialize

#: Characters of a text that needs no identity, and of a beginning that stands for the whole; percent that it must be of the whole; letters of a stem.
SHORT, PREFIX, RATIO, STEM = 160, 800, 80, 7
#: Descriptions of each side from which on those of one key meet by scope.
MANY = 1000
OURS, THEIRS = "customer", "formal"
WORDS = ["id", "text", "service", "heading"]
# Words of a scope that tell nothing apart.
GENERIC = ["dokument", "dokumentet", "krav", "kravene", "kravet", "leveranse", "leveransen", "leveransekrav", "tjeneste", "tjenesten"]
# Words that change what is asked, by what they stand for.
CONTRASTS = {
    "internal": "intern(?:e|t)?", "external": "ekstern(?:e|t)?", "minimum": "minimum|minst", "maximum": "maksimum|maksimalt|høyst", "before": "før", "after": "etter",
    "included": "inkludert", "excluded": "ekskludert", "allowed": "tillatt", "prohibited": "forbudt", "encrypted": "kryptert", "unencrypted": "ukryptert",
    "active": "aktiv(?:e|t)?", "passive": "passiv(?:e|t)?",
}
RESTRICTIONS = ["aldri", "bare", "ingen", "ikke", "intet", "kun", "unntatt", "uten", "verken"]
UNITS = [
    "bit", "byte", "dag", "dager", "gb", "gbps", "hz", "kb", "kbps", "kg", "km", "mb", "mbps", "minutt", "minutter", "ms", "måned", "måneder", "prosent", "sekund", "sekunder",
    "tb", "time", "timer", "uke", "uker", "år",
]
# Identities that a parser made up, and labels that name nothing.
MADE_UP = r"^(?:side[0-9]+krav[0-9]+|dokumenttekstkrav[0-9]+)$"
EMPTY_LABELS = ["krav", "requirement"]
ENTITY = r"B(\p{Lu}{2,}[\p{L}\p{N}]*|\p{Lu}\p{Ll}+\p{Lu}[\p{L}\p{N}]*)B"


def composed(text: Column) -> Column:
    """Compatibility composition (NFKC), for which Spark has no built-in."""

    def normalize(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: t if t.isascii() else unicodedata.normalize("NFKC", t), na_action="ignore")

    return F.pandas_udf(normalize, "string")(text)


def _canonical(text: Column) -> Column:
    """Words of a composed text: hyphens at line ends closed, lower case, other characters than letters and digits to one space."""
    joined = F.regexp_replace(F.replace(text, F.lit("­"), F.lit("")), r"([\p{L}\p{N}])[-‐‑‒–—][\s\p{Z}]*\n[\s\p{Z}]*(\p{Ll})", "$1$2")
    return F.trim(F.regexp_replace(F.lower(joined), r"[^\p{L}\p{N}]+", " "))


def _compact(canonical: Column) -> Column:
    return F.replace(canonical, F.lit(" "), F.lit(""))


def _marks(tokens: Column, text: Column) -> Column:
    """Contrasts, restrictions, and numbers with units of a text; two texts must have the same of each."""
    kind = lambda w: F.coalesce(*[F.when(w.rlike(f"^(?:{p})$"), F.lit(name)) for name, p in CONTRASTS.items()])
    signs = F.array_join(F.array_sort(F.regexp_extract_all(text, F.lit("([%‰°])"))), "")
    parts = (
        ("c", F.array_compact(F.transform(tokens, kind))),
        ("r", F.filter(tokens, lambda w: w.isin(RESTRICTIONS))),
        ("n", F.concat(F.filter(tokens, lambda w: w.rlike("^[0-9]+$") | w.isin(UNITS)), F.array_compact(F.array(F.nullif(signs, F.lit("")))))),
    )
    return F.struct(*[F.array_sort(F.array_distinct(x)).alias(name) for name, x in parts])


def _grounded(service: Column, tokens: Column) -> Column:
    """Whether two telling words of a service stand in the text, alike at least in their first seven letters."""
    telling = F.array_distinct(F.filter(F.split(service, " "), lambda w: (F.length(w) >= 5) & ~w.isin(GENERIC)))
    same = lambda a: F.exists(tokens, lambda b: (a == b) | ((F.length(a) >= STEM) & (F.length(b) >= STEM) & (F.left(a, F.lit(STEM)) == F.left(b, F.lit(STEM)))))
    return F.size(F.filter(telling, same)) >= 2


def described(entries: DataFrame) -> DataFrame:
    """``entries`` with ``_d``: all that two rows are compared by, and ``_digest`` of it, made once.

    Labels are a row's service and the last part of its id; numbers are ids with
    a digit. Of two equal labels the id's words count.
    """
    blank = lambda c: F.coalesce(c, F.lit(""))
    forms = {"_text": composed(blank(F.col("text"))), "_id": composed(blank(F.col("id"))), "_service": composed(blank(F.col("service"))), "_heading": composed(blank(F.col("heading")))}
    rows = entries.withColumns(forms)
    last = F.element_at(F.concat(F.array(F.lit("")), F.filter(F.transform(F.split("_id", r"[\s\p{Z}]+-[\s\p{Z}]+"), lambda p: F.trim(p)), lambda p: p != "")), -1)
    rows = rows.withColumns({"_c": _canonical(F.col("_text")), "_s": _canonical(F.col("_service")), "_h": _compact(_canonical(F.col("_heading"))), "_i": _canonical(F.col("_id")), "_l": _canonical(last)})
    rows = materialize(rows.drop("_id", "_service", "_heading"), "forms")
    tokens = F.split("_c", " ")
    is_label = lambda k: (F.length(k) >= 6) & ~k.rlike(MADE_UP) & ~k.isin(EMPTY_LABELS)
    named = F.filter(F.array(*[F.struct(_compact(F.col(c)).alias("key"), F.col(c).alias("words")) for c in ("_l", "_s")]), lambda x: is_label(x["key"]))
    once = F.when(F.get(named, F.lit(0))["key"] == F.get(named, F.lit(1))["key"], F.slice(named, 1, 1)).otherwise(named)
    numbers = F.filter(F.array(_compact(F.col("_i")), _compact(F.col("_l"))), lambda k: k.rlike("[0-9]") & ~k.rlike(MADE_UP))
    entities = F.array_distinct(F.transform(F.regexp_extract_all("_text", F.lit(pattern(ENTITY)), 1), lambda m: _compact(_canonical(m))))
    d = F.struct(
        F.col("_c").alias("canonical"), _compact(F.col("_c")).alias("compact"), F.array_sort(once).alias("labels"), F.array_distinct(numbers).alias("numbers"), _compact(F.col("_s")).alias("service"),
        F.col("_h").alias("heading"), _grounded(F.col("_s"), tokens).alias("grounded"), _marks(tokens, F.col("text")).alias("marks"), entities.alias("entities"),
    )
    return rows.withColumn("_d", d).withColumn("_digest", F.sha2(F.to_json("_d"), 256)).drop("_text", "_c", "_s", "_h", "_i", "_l")


def _apart(a: Column, b: Column) -> Column:
    """Whether both are named and differ."""
    return (a != "") & (b != "") & (a != b)


def _stripped(canonical: Column, words: Column) -> Column:
    return F.array_join(F.filter(F.split(canonical, " "), lambda w: ~F.array_contains(words, w)), "")


def _shared(d: Column) -> Column:
    """Every choice of a row's labels that another row may share with it: their keys, and their words of four letters or more."""
    choice = lambda s: F.struct(F.transform(s, lambda x: x["key"]).alias("keys"), F.array_sort(F.array_distinct(F.filter(F.flatten(F.transform(s, lambda x: F.split(x["words"], " "))), lambda w: F.length(w) >= 4))).alias("words"))
    each = F.concat(F.transform(d["labels"], lambda x: choice(F.array(x))), F.when(F.size(d["labels"]) == 2, F.array(choice(d["labels"]))).otherwise(F.slice(F.array(choice(d["labels"])), 1, 0)))
    return F.filter(each, lambda s: F.size(s["words"]) > 0)


def _met(ours: DataFrame, theirs: DataFrame, present: DataFrame, on: list[str]) -> DataFrame:
    """``ours, theirs`` that share a key ``_k``, once each. A key that many descriptions of both sides have brings only those together that have a scope in common."""
    counts = ours.groupBy("_k").agg(F.count("*").alias("a")).join(theirs.groupBy("_k").agg(F.count("*").alias("b")), "_k")
    counts = materialize(counts.select("_k", (F.least("a", "b") > MANY).alias("many")), "keys")
    few, many = (counts.where(F.col("many") == m).select("_k") for m in (False, True))
    met = ours.join(few, "_k").join(theirs, "_k").select("ours", "theirs")
    if not many.isEmpty():
        placed = lambda side, name: present.where(F.col("side") == name).join(side, F.col("_class") == F.col("ours" if name == OURS else "theirs")).join(many, "_k").drop("_class", "side")
        met = met.unionByName(placed(ours, OURS).join(placed(theirs, THEIRS), [*on, "_k"]).select("ours", "theirs"))
    return met.distinct()


def equivalents(classes: DataFrame, present: DataFrame, on: list[str]) -> DataFrame:
    """``ours, theirs``: classes of descriptions that state the same requirement, whatever their scopes. classes: ``_class, _d``; present: ``on, side, _class``, once each.

    Descriptions meet by their whole text, by its first 800 characters, or by
    labels in common together with the text that is left without the labels'
    words. A label by itself brings nothing together, so a service of thousands
    of rows costs no pairs. The labels' words are those of ours, whose spelling
    the other side learns first. Two descriptions are compared once, in
    however many scopes they meet.
    """
    a, b = (materialize(classes.join(present.where(F.col("side") == name).select("_class").distinct(), "_class", "left_semi").select(F.col("_class").alias(as_), F.col("_d").alias(d)), as_) for name, as_, d in ((OURS, "ours", "a"), (THEIRS, "theirs", "b")))
    whole = lambda d: F.concat(F.array(F.xxhash64(F.lit("w"), d["compact"])), F.when(F.length(d["compact"]) >= PREFIX, F.array(F.xxhash64(F.lit("p"), F.left(d["compact"], F.lit(PREFIX))))).otherwise(F.array().cast("array<bigint>")))
    label = lambda keys, words, canonical: F.xxhash64(F.lit("l"), F.to_json(keys), F.to_json(words), _stripped(canonical, words))
    own = a.select("ours", "a.canonical", F.explode(_shared(F.col("a"))).alias("_s")).select("ours", "canonical", "_s.keys", "_s.words")
    spelled = materialize(own.select("keys", "words").distinct(), "spelled")
    other = b.select("theirs", "b.canonical", F.explode(_shared(F.col("b"))).alias("_s")).select("theirs", "canonical", F.col("_s.keys").alias("keys")).join(spelled, "keys")
    keyed = lambda side, of, d, by_label: materialize(side.select(of, F.explode(whole(F.col(d))).alias("_k")).unionByName(by_label.select(of, label(F.col("keys"), F.col("words"), F.col("canonical")).alias("_k"))).distinct(), "keyed")
    met = materialize(_met(keyed(a, "ours", "a", own), keyed(b, "theirs", "b", other), present, on), "met")
    both = met.join(a, "ours").join(b, "theirs")
    return both.where(same_requirement(F.col("a"), F.col("b"))).select("ours", "theirs")


def _alike(pairs: DataFrame, of: str, by: str, name: str) -> DataFrame:
    """``of`` and ``name``, the smallest of those that pair with the same set of ``by``. Sets are told by their number and two digests."""
    seen = F.struct(F.count("*").alias("n"), *[F.bit_xor(F.xxhash64(F.lit(x), by)).alias(x) for x in ("x", "y")])
    each = pairs.groupBy(of).agg(seen.alias("_set"))
    return each.join(each.groupBy("_set").agg(F.min(of).alias(name)), "_set").select(of, name)


def stated_sets(pairs: DataFrame, present: DataFrame, on: list[str]) -> tuple[DataFrame, DataFrame]:
    """``_class, set`` of ours, and ``on, set`` of the sets that a scope's formal rows state.

    Classes of ours that the same formal ones state are one set, and formal
    classes that state the same are one as well, so that a scope has no row for
    every pair of its descriptions.
    """
    ours, theirs = materialize(_alike(pairs, "ours", "theirs", "set"), "sets"), materialize(_alike(pairs, "theirs", "ours", "of"), "sets")
    links = materialize(pairs.join(ours, "ours").join(theirs, "theirs").select("of", "set").distinct(), "links")
    formal = present.where(F.col("side") == THEIRS).join(theirs.withColumnRenamed("theirs", "_class"), "_class").select(*on, "of").distinct()
    return ours.withColumnRenamed("ours", "_class"), materialize(formal.join(links, "of").select(*on, "set").distinct(), "stated")


def same_requirement(a: Column, b: Column) -> Column:
    """Whether two descriptions state the same; the words of shared labels are read from ``a``."""
    keys = lambda d: F.transform(d["labels"], lambda x: x["key"])
    common = F.filter(a["labels"], lambda x: F.array_contains(keys(b), x["key"]))
    words = F.filter(F.flatten(F.transform(common, lambda x: F.split(x["words"], " "))), lambda w: F.length(w) >= 4)
    identified = (F.size(common) > 0) | F.arrays_overlap(a["numbers"], b["numbers"])
    apart = F.when((a["service"] != "") & (b["service"] != ""), a["service"] != b["service"]).otherwise(_apart(a["heading"], b["heading"]))
    scoped = F.when((a["service"] != "") & (b["service"] != ""), a["service"] == b["service"]).when((a["service"] == "") & (b["service"] == ""), ~_apart(a["heading"], b["heading"]))
    scoped = scoped.otherwise(F.when(a["service"] != "", a["grounded"]).otherwise(b["grounded"]))
    short, long = (F.when((F.length(a["compact"]) <= F.length(b["compact"])) == first, a["compact"]).otherwise(b["compact"]) for first in (True, False))
    begins = (F.length(short) >= PREFIX) & (F.length(short) * 100 >= F.length(long) * RATIO) & F.startswith(long, short) & scoped
    named = F.forall(a["entities"], lambda e: F.contains(b["compact"], e)) & F.forall(b["entities"], lambda e: F.contains(a["compact"], e))
    alike = (a["compact"] == b["compact"]) | ((F.size(words) > 0) & let(words, lambda w: _stripped(a["canonical"], w) == _stripped(b["canonical"], w)))
    equal = F.when(F.length(a["canonical"]) >= SHORT, scoped).otherwise(identified & ~apart)
    return (a["canonical"] != "") & (b["canonical"] != "") & F.when(a["canonical"] == b["canonical"], equal).otherwise(begins | (identified & ~apart & (a["marks"] == b["marks"]) & named & alike))


def canonical_ledger(entries: DataFrame, on: list[str]) -> DataFrame:
    """``entries`` without the customer's rows that a formal document states too, with ``entry_order``: the rank among its document's rows that stay, from 0.

    entries: ``on, doc, entry, side, id, service, heading, text``; side is
    ``customer``, ``formal`` or another, whose rows stay and drop nothing;
    ``entry`` orders a document. Descriptions are made and compared once, however
    many rows and scopes have them; rows are shuffled with their number, not
    with their texts. A row without text raises an error, so that none is lost
    unseen.

    Nulls and edges: null ids, services and headings are empty; repeated rows stand or fall together and keep their places; ties of ``entry``
    are ranked by id and text; texts of marks alone are like no other; an empty table gives an empty result.
    """
    mark = F.unhex(F.sha2(F.concat(*[F.coalesce(F.concat(F.length(c), F.lit(":"), F.col(c)), F.lit("-")) for c in WORDS]), 256))
    # Numbered in the order in which id and text rank rows of one place.
    words = entries.select(*WORDS).distinct().orderBy("id", "text").withColumn("_n", F.monotonically_increasing_id()).withColumn("_mark", mark)
    words = materialize(words, "words")
    blank = lambda df: df.where(F.coalesce("text", F.lit("")).rlike(r"^[\s\p{Z}]*$"))
    if not blank(words).isEmpty():
        found = blank(entries).select(F.concat_ws(":", F.col("doc").cast("string"), "id").alias("row")).agg(F.count("*").alias("n"), F.min("row").alias("first")).first()
        raise ValueError(f"{found['n']} requirement rows without text, such as {found['first']}")
    known = materialize(described(words).select("_n", "_mark", "_d", "_digest"), "described")
    classes = materialize(known.groupBy("_digest").agg(F.min("_n").alias("_class"), F.first("_d").alias("_d")), "classes")
    numbers = materialize(known.select("_n", "_mark", "_digest").join(classes.select("_digest", "_class"), "_digest").drop("_digest"), "numbers")
    rows = materialize(entries.withColumn("_mark", mark).drop(*WORDS).join(numbers, "_mark").drop("_mark"), "rows")
    present = materialize(rows.where(F.col("side").isin(OURS, THEIRS)).select(*on, "side", "_class").distinct(), "present")
    sets, stated = stated_sets(materialize(equivalents(classes.drop("_digest"), present, on), "pairs"), present, on)
    ours = F.col("side").eqNullSafe(OURS)
    kept = rows.where(~ours).unionByName(rows.where(ours).join(sets, "_class", "left").join(stated, [*on, "set"], "left_anti").select(*rows.columns))
    order = Window.partitionBy(*on, "doc").orderBy("entry", "_n")
    ranked = kept.withColumn("entry_order", F.row_number().over(order) - 1).drop("_class")
    return ranked.join(words.drop("_mark"), "_n").select(*entries.columns, "entry_order")
