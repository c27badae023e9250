"""Quality rules with adaptive thresholds, all in DataFrame functions.

Each row is measured where it is read. The measures of rows that pass the base
rules are summed into quantile sketches per language and source: counts by
bucket, exact below 128 and within 1/64 above, at most about 1,100 buckets a
measure, merged by adding counts. From a sketch come the quartiles and the 99 %
quantile, its tail. A fence stands ``reach`` spreads beyond the quartiles, a
spread being the distance between them or, where most texts have none of a
measure and both are zero, a part of the way to the tail: a group whose texts
repeat more lines bears more. ``least`` keeps a spread from being nothing. A
group's quantiles are blended with its language's, which count as ``prior`` rows
more, and those with all rows', so a small group leans on its language by
degrees and nothing switches at a size.
A row is kept if it passes the base rules and lies within its group's fences.

Nulls and edges: a null text has no words and fails the base rules; a null
language or source is a group like any other; repeated rows count each; an
empty table gives an empty result; very long texts are measured whole; ties
fall in one bucket; columns of ``docs`` that have a measure's name give way in
``quality`` and stay as they are in ``keep_good``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.sources.scratch import materialize

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 8
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Rate, least spread, and the part of the way to the tail that a spread is at least: symbols and repeated words in 1,000 words, 100 times the mean word length, repeated lines in 1,000.
RATES = {
    "symbol_rate": ("n_symbols * 1000 div nullif(n_words, 0)", 5, 40),
    "word_length": ("word_chars * 100 div nullif(n_words, 0)", 10, 40),
    "line_rate": ("n_dup_lines * 1000 div nullif(n_lines, 0)", 30, 3),
    "repeat_rate": ("n_repeat_words * 1000 div nullif(n_words, 0)", 25, 2),
}
QUANTILES = (25, 75, 99)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once a row, also inside lambdas."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _repeated(words: Column) -> Column:
    """Words in windows of 8 that occur twice or more in the array."""

    def covered(hashes: Column) -> Column:
        placed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def twins(s: Column) -> Column:
            def has_twin(e: Column, i: Column) -> Column:
                return F.coalesce(e["h"] == F.get(s, i - 1)["h"], F.lit(False)) | F.coalesce(e["h"] == F.get(s, i + 1)["h"], F.lit(False))

            starts = F.array_sort(F.transform(F.filter(s, has_twin), lambda e: e["i"]))
            zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
            return F.aggregate(
                starts,
                zero,
                lambda a, p: F.struct((a["n"] + WINDOW - F.greatest(F.lit(0), a["end"] - p)).alias("n"), (p + WINDOW).alias("end")),
                lambda a: a["n"],
            )

        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(_let(placed, twins))

    windows = F.transform(F.sequence(F.lit(1), F.size(words) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(words, i, WINDOW)))
    return F.when(F.size(words) <= WINDOW, F.lit(0)).otherwise(_let(windows, covered))


def measured(docs: DataFrame) -> DataFrame:
    """``docs`` with the measures of each text, ``n_lines`` and ``base_failed``. Columns of these names are replaced."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    words = F.array_remove(F.split(text, SPACE), "")
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))

    def of_words(w: Column) -> Column:
        return F.struct(F.size(w).alias("n"), F.length(F.array_join(w, "")).alias("chars"), _repeated(w).alias("repeated"))

    def of_lines(a: Column) -> Column:
        return F.struct(F.size(a).alias("n"), (F.size(a) - F.size(F.array_distinct(a))).alias("repeated"))

    found = docs.withColumns({"_w": _let(words, of_words), "_l": _let(lines, of_lines), "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)).cast("long")})
    found = found.withColumns(
        {
            "n_words": F.col("_w.n").cast("long"),
            "word_chars": F.col("_w.chars").cast("long"),
            "n_dup_lines": F.col("_l.repeated").cast("long"),
            "n_repeat_words": F.col("_w.repeated").cast("long"),
            "n_lines": F.col("_l.n").cast("long"),
        }
    ).drop("_w", "_l")
    return found.withColumn("base_failed", F.expr("n_words < 20 or 100 * n_repeat_words > 30 * n_words"))


def bucket(value: Column) -> Column:
    """The bucket of a whole number: itself below 128, above that its first seven bits."""
    shift = F.length(F.bin(value)) - 7
    step = F.pow(F.lit(2.0), shift).cast("long")
    return F.when(value < 128, value).otherwise(F.floor(value / step) * step).cast("long")


def sketches(rows: DataFrame) -> DataFrame:
    """``lang, source, measure, bucket, n``: mergeable by adding n."""
    rates = F.explode(F.create_map(*(x for name, (rate, *_) in RATES.items() for x in (F.lit(name), F.expr(rate)))))
    found = rows.where("not base_failed").select("lang", "source", rates.alias("measure", "value"))
    return found.groupBy("lang", "source", "measure", bucket(F.col("value")).alias("bucket")).agg(F.count("*").alias("n"))


def _quantiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """One row a group: its rows, and the quartiles and the tail of every measure."""
    group = ", ".join([*keys, "measure"])
    sums = sketch.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))
    placed = sums.withColumns(
        {
            "upto": F.expr(f"sum(n) over (partition by {group} order by bucket)"),
            "rows": F.expr(f"sum(n) over (partition by {group})"),
        }
    )
    found = [F.min(F.expr(f"case when measure = '{m}' and upto * 100 >= {p} * rows then bucket end")).alias(f"{m}_{p}") for m in RATES for p in QUANTILES]
    return placed.groupBy(*keys).agg(F.max("rows").alias("rows"), *found)


def thresholds(sketch: DataFrame, prior: int = 30, reach: int = 4) -> DataFrame:
    """``lang, source`` and, for every measure, ``{measure}_low`` and ``{measure}_high``."""
    one = sketch.withColumn("every", F.lit(1))
    whole = _quantiles(one, ["every"])
    language = _quantiles(one, ["lang"])
    own = _quantiles(one, ["lang", "source"]).withColumn("every", F.lit(1))
    joined = own.alias("a").join(language.alias("b"), F.expr("a.lang <=> b.lang")).join(whole.alias("c"), F.expr("a.every = c.every"))

    def blend(rows: str, own: str, wide: str) -> str:
        return f"(({rows} * {own} + {prior} * {wide}) div ({rows} + {prior}))"

    def quantile(m: str, p: int) -> Column:
        return F.expr(blend("a.rows", f"a.{m}_{p}", blend("b.rows", f"b.{m}_{p}", f"c.{m}_{p}")))

    found = joined.select("a.lang", "a.source", *[quantile(m, p).alias(f"{m}_{p}") for m in RATES for p in QUANTILES])
    fences = []
    for m, (_, least, part) in RATES.items():
        spread = f"{reach} * greatest({m}_75 - {m}_25, {least}, ({m}_99 - {m}_75) div {part})"
        fences += [F.expr(f"{m}_25 - {spread}").alias(f"{m}_low"), F.expr(f"{m}_75 + {spread}").alias(f"{m}_high")]
    return found.select("lang", "source", *fences)


def judged(rows: DataFrame, limits: DataFrame) -> DataFrame:
    """``rows`` of ``measured`` with ``kept``."""
    near = limits.withColumnsRenamed({"lang": "_lang", "source": "_source"})
    within = " and ".join(f"coalesce({rate} between {m}_low and {m}_high, true)" for m, (rate, *_) in RATES.items())
    joined = rows.join(near, F.expr("lang <=> _lang and source <=> _source"), "left")
    return joined.withColumn("kept", F.expr(f"not base_failed and {within}")).drop(*near.columns)


def packed(docs: DataFrame, carry: list[str] | None = None, prior: int = 30, reach: int = 4) -> DataFrame:
    """``row``, the struct of the ``carry`` columns (all by default), with the measures, ``base_failed`` and ``kept``.

    Rows are measured once and kept in a working table between the two passes.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry or docs.columns]).alias("row"), "text", "lang", "source")
    rows = materialize(measured(rows).select("row", "lang", "source", *MEASURES, "n_lines", "base_failed"), "measures")
    limits = materialize(thresholds(sketches(rows), prior, reach), "thresholds")  # its size is then known to the planner
    return judged(rows, limits).drop("lang", "source")


def quality(docs: DataFrame, carry: list[str] | None = None, prior: int = 30, reach: int = 4) -> DataFrame:
    """The ``carry`` columns of every row with its measures and verdict; columns that have a measure's name give way."""
    own = [c for c in carry or docs.columns if c not in {*MEASURES, "n_lines", "base_failed", "kept"}]
    return packed(docs, own, prior, reach).select("row.*", *MEASURES, "n_lines", "base_failed", "kept")


def keep_good(docs: DataFrame, **kwargs) -> DataFrame:
    """The rows of ``docs`` that the rules keep, as they are."""
    return packed(docs, **kwargs).where("kept").select("row.*")
