"""Text functions from Column to Column."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def normalized(text: Column) -> Column:
    """One form of line breaks, dashes and spaces; lines trimmed; four or more line breaks become two."""
    out = F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\0"), F.lit(""))
    out = F.regexp_replace(F.regexp_replace(out, "[‐‑‒–—]", "-"), "[ \t]+", " ")
    out = F.array_join(F.transform(F.split(out, "\n"), lambda x: F.trim(x)), "\n")
    return F.regexp_replace(F.regexp_replace(out, "\n{4,}", "\n\n"), r"^\s+|\s+$", "")


def decomposed(text: Column) -> Column:
    """Compatibility decomposition (NFKD), for which Spark has no built-in."""

    def normalize(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: unicodedata.normalize("NFKD", t), na_action="ignore")

    return F.pandas_udf(normalize, "string")(text)


def comparable(text: Column, keep_letters: bool = False) -> Column:
    """A key for comparison: lower case, accents gone, other characters than letters, digits, dot and dash to spaces.

    keep_letters: keep æ, ø and other letters without a decomposition, which the strict key turns into spaces.
    """
    out = F.regexp_replace(decomposed(F.lower(text)), r"\p{M}", "")
    out = F.regexp_replace(out, r"[^\p{L}\p{N}\s.-]+" if keep_letters else r"[^a-z0-9\s.-]+", " ")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def token_count(text: Column) -> Column:
    """A quarter of the length, at least 1."""
    return F.greatest(F.lit(1), F.ceil(F.length(text) / 4)).cast("long")


#: Marks between words, for a character class.
MARKS = r"`*#>_\[\](){},.:;!?'\"“”‘’/\\|-"


def compared(text: Column) -> Column:
    """A key for comparing prose: lower case, marks to spaces, one space between words."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), f"[{MARKS}]", " "), r"\s+", " "))


def words(text: Column) -> Column:
    """Comparison tokens: longer than two characters, or with a digit."""
    return F.filter(F.split(compared(text), " "), lambda w: (F.length(w) > 2) | w.rlike("[0-9]"))


def overlap(a: Column, b: Column) -> Column:
    """Shared distinct tokens over those of the smaller side; 0 if a side has none."""
    x, y = F.array_distinct(a), F.array_distinct(b)
    least = F.least(F.size(x), F.size(y))
    return F.when(least > 0, F.size(F.array_intersect(x, y)) / least).otherwise(0.0)


# Words that two texts must share in the same order, as numbers must, to mean the same.
SENSITIVE = [
    "rto", "rpo", "sla", "ikke", "ingen", "aldri", "uten", "not", "no", "never", "without", "sekund", "sekunder", "second", "seconds",
    "minutt", "minutter", "minute", "minutes", "time", "timer", "hour", "hours", "dag", "dager", "day", "days", "uke", "uker", "week",
    "weeks", "måned", "måneder", "month", "months", "år", "year", "years", "prosent", "percent", "kb", "mb", "gb", "tb", "kr", "nok",
    "eur", "usd", "m2", "m²",
]


def sensitive(text: Column) -> Column:
    """The numbers, units and negations of a text, in order."""
    return F.array_join(F.filter(F.split(compared(text), " "), lambda w: w.rlike("[0-9]") | w.isin(SENSITIVE)), "\x00")


def near_duplicate(a: Column, b: Column, similarity: float = 0.72) -> Column:
    """Equal keys, or the same sensitive words in the same order and tokens that overlap enough; never an empty text."""
    made = lambda x: F.struct(compared(x).alias("key"), sensitive(x).alias("sensitive"), F.array_distinct(words(x)).alias("tokens"))
    return same_said(made(a), made(b), similarity)


def same_said(a: Column, b: Column, similarity: float) -> Column:
    """``near_duplicate`` of texts whose ``key``, ``sensitive`` words and distinct ``tokens`` are made already."""
    least = F.least(F.size(a["tokens"]), F.size(b["tokens"]))
    near = (a["sensitive"] == b["sensitive"]) & (least > 0) & (F.size(F.array_intersect(a["tokens"], b["tokens"])) / least >= similarity)
    return (a["key"] != "") & (b["key"] != "") & ((a["key"] == b["key"]) | near)


# Abbreviations after which a sentence goes on, and months after the number of a date.
ABBREVIATIONS = ["f.eks", "dvs", "bl.a", "m.m", "o.l", "kl", "ca", "nr"]
MONTHS = ["januar", "februar", "mars", "april", "mai", "juni", "juli", "august", "september", "oktober", "november", "desember"]


#: Where a marked text is cut into sentences, and a number at its end, before which a month makes it a date.
CUT, NUMBERED = r"(?=\s)(?<=[.!?])\s+", r"(?<![A-Za-z0-9_])[0-9]{1,2}\.$"
MONTH = rf"(?:{'|'.join(MONTHS)})(?![A-Za-z0-9_])"


def marked(text: Column) -> Column:
    """A text with another mark for the dots after an abbreviation and the number of a date, where no sentence ends."""
    short, first = "|".join(a.replace(".", r"\.") for a in ABBREVIATIONS), "".join(sorted({a[0] for a in ABBREVIATIONS}))
    # The first letter is looked at before all else: most places have another.
    kept = F.regexp_replace(text, rf"(?i)(?=[{first}])(?<![A-Za-z0-9_])({short})\.", "$1\x01")
    return F.regexp_replace(kept, rf"(?i)(?=[0-9])(?<![A-Za-z0-9_])([0-9]{{1,2}})\.(\s+{MONTH})", "$1\x01$2")


def unmarked(sentence: Column) -> Column:
    return F.trim(F.replace(sentence, F.lit("\x01"), F.lit(".")))


def sentences(text: Column) -> Column:
    """Sentences; no cut after an abbreviation or the number of a date."""
    return F.filter(F.transform(F.split(marked(text), CUT), unmarked), lambda s: s != "")


def requirement_id(text: Column) -> Column:
    """An identifier in one form: upper case, no spaces, one kind of dash, no dot behind."""
    return F.regexp_replace(F.regexp_replace(F.upper(F.regexp_replace(text, r"\s+", "")), "[‐‑‒–—_]", "-"), r"[.:]+$", "")


#: Names of standards look like identifiers and are none.
STANDARDS = ["ISO", "IEC", "IEEE", "RFC", "NS", "EN", "UTF", "SHA", "TLS", "WCAG"]


def requirement_ids(text: Column) -> Column:
    """Identifiers such as R-12, FUN-A01 or K3.2 in order, each once."""
    found = F.regexp_extract_all(F.concat(F.lit(" "), text), F.lit(r"[^\w-]([A-Z]{1,6}-?[0-9]{1,5}(?:\.[0-9]{1,3})*)"), 1)
    known = F.filter(F.array_distinct(found), lambda x: ~F.regexp_extract(x, "^([A-Z]+)", 1).isin(STANDARDS))
    return F.array_distinct(F.transform(known, requirement_id))


def compact(text: Column, length: int) -> Column:
    """At most ``length`` characters, with an ellipsis where text was cut."""
    return F.when(F.length(text) > length, F.concat(F.rtrim(F.substring(text, 1, length - 1)), F.lit("…"))).otherwise(text)


def cut_at_word(text: Column, length: int) -> Column:
    """At most ``length`` characters, cut at the last space if there is one."""
    head = F.substring(text, 1, length)
    at_space = F.regexp_replace(head, r"\s+\S*\z", "")
    return F.when(F.length(text) <= length, text).when(at_space == "", head).otherwise(at_space)


def masked_email(text: Column) -> Column:
    """E-mail addresses with all but the first letter of the name hidden."""
    return F.regexp_replace(text, r"([A-Za-z0-9])[A-Za-z0-9._%+-]*@([A-Za-z0-9.-]+\.[A-Za-z]{2,})", "$1***@$2")


def canonical_json(value: Column, names: list[str]) -> Column:
    """A struct's named fields as JSON with sorted keys, for fingerprints."""
    return F.to_json(F.struct(*[value[n].alias(n) for n in sorted(names)]), {"ignoreNullFields": "false"})


def mentions(text: Column, phrase: str) -> Column:
    """How often a phrase occurs, with any white space or dash between its words; at least 1."""
    pattern = r"[\s-]+".join(w for w in phrase.lower().split())
    return F.greatest(F.lit(1), F.regexp_count(F.lower(text), F.lit(pattern)))


def diagnostics(text: Column) -> Column:
    """Codes of what looks wrong in a text."""
    codes = [
        ("replacement_character", text.contains("�")),
        ("mojibake", text.rlike("Ã[\u0080-¿]")),
        ("soft_hyphen", text.contains("­")),
        ("broken_word", text.rlike("[a-z]-\n[a-z]")),
        ("long_run", text.rlike("(.)\\1{9,}")),
        ("no_vowels", F.length(text).__gt__(40) & ~F.lower(text).rlike("[aeiouyæøåäöüéèêíóúáà]")),
        ("double_space", text.contains("  ")),
        ("control_character", text.rlike("[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]")),
    ]
    return F.array_compact(F.array(*[F.when(test, F.lit(code)) for code, test in codes]))
