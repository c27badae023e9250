"""Pages and lines of marked texts: markers, page ranges, windows of lines, heading paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.language import EDGE, page_text
from lodestone.functions.text import normalized

MARKER = r"\[\[SIDE:(\d{1,5})(?:-(\d{1,5}))?\]\]"
DEEPEST, PLAIN = 6, 4  # headings of a numbered path, and of one without numbers


def markers(text: Column) -> Column:
    """``start, stop, offset, after`` of every page marker: its pages, and where it and the text behind it begin (from 0)."""
    found, between = F.regexp_extract_all(text, F.lit(MARKER), 0), F.split(text, MARKER)
    placed = F.transform(
        found,
        lambda m, i: F.struct(
            F.regexp_extract(m, MARKER, 1).cast("int").alias("start"),
            F.coalesce(F.nullif(F.regexp_extract(m, MARKER, 2), F.lit("")), F.regexp_extract(m, MARKER, 1)).cast("int").alias("stop"),
            (F.length(F.array_join(F.slice(between, F.lit(1), i + 1), "")) + F.length(F.array_join(F.slice(found, F.lit(1), i), ""))).alias("offset"),
            F.length(m).alias("size"),
        ),
    )
    whole = F.transform(placed, lambda s: F.struct(s["start"].alias("start"), F.greatest(s["start"], s["stop"]).alias("stop"), s["offset"].alias("offset"), (s["offset"] + s["size"]).alias("after")))
    return F.filter(whole, lambda s: s["start"] > 0)


def page_list(text: Column) -> Column:
    """``page, text`` of every page of a marked text, in order; the whole text as page 1 if it has no marker."""

    def cut(ms: Column) -> Column:
        pages = F.transform(ms, lambda m, i: F.struct(m["start"].alias("page"), F.substring(text, m["after"] + 1, F.coalesce(F.get(ms, i + 1)["offset"], F.length(text)) - m["after"]).alias("text")))
        return F.when(F.size(ms) > 0, pages).otherwise(F.array(F.struct(F.lit(1).alias("page"), text.alias("text"))))

    return F.element_at(F.transform(F.array(markers(text)), cut), 1)


def split_pages(docs: DataFrame, id_column: str, text: str) -> DataFrame:
    """``id_column, page_no, page, page_end, text`` (raw) and ``body`` (on one line) of what lies between markers; empty pages are left out."""
    rows = docs.select(id_column, F.col(text).alias("_t"), markers(F.col(text)).alias("_m")).select(id_column, "_t", "_m", F.posexplode("_m").alias("page_no", "m"))
    stop = F.coalesce(F.get("_m", F.col("page_no") + 1)["offset"], F.length("_t"))
    cut = F.substring(F.col("_t"), F.col("m.after") + 1, stop - F.col("m.after"))
    pages = rows.select(id_column, "page_no", F.col("m.start").alias("page"), F.col("m.stop").alias("page_end"), cut.alias("text"))
    return pages.withColumn("body", page_text(F.col("text"))).where("body <> ''")


def page_range(reference: Column, text: Column) -> Column:
    """First and last page named by ``side n``, ``page n`` or a marker; nulls if none is."""
    source = F.concat_ws("\n", reference, text)
    named = F.transform(F.regexp_extract_all(source, F.lit(rf"(?i){EDGE}(?:side|page)\s+(\d{{1,5}}){EDGE}"), 1), lambda x: x.cast("int"))
    marked = F.flatten(F.transform(markers(source), lambda m: F.array(m["start"], m["stop"])))
    every = F.concat(named, marked)
    return F.struct(F.array_min(every).alias("page_start"), F.array_max(every).alias("page_end"))


def heading_paths(rows: DataFrame, id_column: str, order: str, heading: str) -> DataFrame:
    """``rows`` with ``path``: the headings above each row, a numbered one at its depth, any other alone.

    Only headings are gathered, one list a document, and folded once; rows take
    the path of the last heading at or before them.
    """
    w = Window.partitionBy(id_column).orderBy(order)
    counted = rows.withColumn("_k", F.count(heading).over(w))
    heads = counted.where(F.col(heading).isNotNull()).groupBy(id_column).agg(F.array_sort(F.collect_list(F.struct("_k", F.col(heading).alias("h")))).alias("hs"))

    def step(state: Column, x: Column) -> Column:
        number = F.regexp_extract(x["h"], r"^(\d{1,3}(?:\.\d{1,3})*)\s+", 1)
        current = F.coalesce(F.try_element_at(state, F.lit(-1)), F.array().cast("array<string>"))
        above = F.slice(current, F.lit(1), F.size(F.split(number, r"\.")) - 1)
        deep = F.concat(above, F.array(x["h"]))
        kept = F.slice(deep, F.greatest(F.size(deep) - DEEPEST, F.lit(0)) + 1, F.lit(DEEPEST))
        return F.concat(state, F.array(F.when(number == "", F.array(x["h"])).otherwise(kept)))

    paths = heads.select(id_column, F.aggregate("hs", F.array().cast("array<array<string>>"), step).alias("paths"))
    joined = counted.join(paths, id_column, "left")
    path = F.when(F.col("_k") > 0, F.get("paths", (F.col("_k") - 1).cast("int"))).otherwise(F.array().cast("array<string>"))
    return joined.withColumn("path", path).drop("_k", "paths")


def look_ahead(rows: DataFrame, id_column: str, order: str, line: str, ahead: int = 9) -> DataFrame:
    """``rows`` with ``window``, the next lines of the same document."""
    w = Window.partitionBy(id_column).orderBy(order).rowsBetween(1, ahead)
    return rows.withColumn("window", F.collect_list(line).over(w))


def table_requirements(rows: DataFrame, id_column: str, order: str, line: str, is_id: Column, is_requirement: str, headers: list[str]) -> DataFrame:
    """Requirements under an id line: the lines that follow, up to another id, a yes or no, or enough text.

    is_requirement: pattern of requirement words.
    """
    start = F.struct(F.array().cast("array<string>").alias("parts"), F.lit(False).alias("done"))

    def step(s: Column, x: Column) -> Column:
        ends = x["is_id"] | x["text"].rlike("(?i)^(mandatory|optional|required|yes|no|m|o)$")
        parts = F.when(s["done"] | ends, s["parts"]).otherwise(F.concat(s["parts"], F.array(x["text"])))
        full = x["text"].rlike(is_requirement) | (F.length(F.array_join(parts, " ")) > 120)
        return F.struct(parts.alias("parts"), (s["done"] | ends | full).alias("done"))

    marked = rows.withColumn("_x", F.struct(F.col(line).alias("text"), is_id.alias("is_id"), F.lower(line).isin(*headers).alias("header")))
    seen = look_ahead(marked, id_column, order, "_x").where("_x.is_id")
    body = F.aggregate(F.filter("window", lambda x: ~x["header"] & (x["text"] != "")), start, step, lambda s: F.array_join(s["parts"], " "))
    return seen.select(id_column, order, F.col(line).alias("reference"), body.alias("text")).where((F.length("text") >= 12) & F.col("text").rlike(is_requirement))


def line_runs(rows: DataFrame, id_column: str, order: str, line: str) -> DataFrame:
    """Every line alone, with the next one, and with the next two: ``id_column, order, span, text``."""
    w = Window.partitionBy(id_column).orderBy(order)
    rows = rows.withColumns({"_two": F.lead(line, 1).over(w), "_three": F.lead(line, 2).over(w)})
    one, two, three = F.col(line), F.col("_two"), F.col("_three")
    runs = F.array(F.struct(F.lit(1).alias("span"), one.alias("text")), F.when(two.isNotNull(), F.struct(F.lit(2).alias("span"), F.concat_ws(" ", one, two).alias("text"))), F.when(three.isNotNull(), F.struct(F.lit(3).alias("span"), F.concat_ws(" ", one, two, three).alias("text"))))
    return rows.select(id_column, order, F.explode(F.array_compact(runs)).alias("r")).select(id_column, order, "r.*")


def search_text(parts: list[Column]) -> Column:
    """What a chunk is found by: its document's names, its kind, place, headings and text."""
    return normalized(F.concat_ws("\n", *[F.coalesce(p, F.lit("")) for p in parts]))


def gap_filled(rows: DataFrame, group: list[str], order: str, number: str, prefix: str) -> DataFrame:
    """``rows`` with ``inferred``: numbers of rows without one, where the anchors on both sides leave exactly that many free.

    Anchors are rows with a number; both must have one prefix and belong to one group.
    """
    w = Window.partitionBy(*group).orderBy(order)
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    anchor = F.when(F.col(number).isNotNull(), F.struct(F.col("_i").alias("i"), F.col(number).alias("n"), F.col(prefix).alias("p")))
    placed = rows.withColumn("_i", F.row_number().over(w))
    both = placed.withColumns({"_a": F.last(anchor, ignorenulls=True).over(back), "_b": F.first(anchor, ignorenulls=True).over(ahead)})
    fits = F.col(number).isNull() & (F.col("_a.p") == F.col("_b.p")) & (F.col("_b.n") - F.col("_a.n") == F.col("_b.i") - F.col("_a.i"))
    return both.withColumn("inferred", F.when(fits, F.concat(F.col("_a.p"), (F.col("_a.n") + F.col("_i") - F.col("_a.i")).cast("string")))).drop("_i", "_a", "_b")


def numbered(rows: DataFrame, group: list[str], order: str, kind: str, number: str) -> DataFrame:
    """``rows`` with ``assigned``: the row's own number, or for one without the next of its kind after all before it.

    The count so far is the largest of (own number + rows without one since), so running sums and maxima give it, and no group is gathered.
    """
    w = Window.partitionBy(*group, kind).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    free = rows.withColumn("_free", F.count_if(F.col(number).isNull()).over(w))
    lead = F.max(F.when(F.col(number).isNotNull(), F.col(number) - F.col("_free"))).over(w)
    return free.withColumn("assigned", F.coalesce(F.col(number), F.col("_free") + F.greatest(F.coalesce(lead, F.lit(0)), F.lit(0)))).drop("_free")
