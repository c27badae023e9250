"""Line dedup by site-relative frequency, in DataFrame functions.

Rows are grouped by site. A line's pages on a site, over all pages of the site,
give its ratio; lines above ``ratio`` are the site's boilerplate and are dropped
from all its pages, at every size of site. A line that a single page holds
repeats nothing and stays (``min_pages`` is 2), else a site of one page would
lose its text. A line counts once a page. Lines are compared without white
space around them, by two 64-bit hashes; lines of white space are neither
counted nor dropped.

Counts are pre-aggregated by site and line, so a hot site or line is no single
task's. A site has at most (mean distinct lines a page) / ratio boilerplate
lines, so what the join carries a site is bounded.

Nulls and edges: a null text stays null; rows with a null site are one site;
repeated rows count each; a line at the ratio exactly stays; a very long line
is compared whole; a text all of whose lines go becomes empty; an empty table
gives an empty result; columns of ``pages`` stay, but for ``n_lines`` and
``n_dropped``, which are replaced, and working columns are named so that they
can't clash with others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.sources.scratch import materialize

WHITE = " \t\n\x0b\x0c\r"


def bare(line: Column) -> Column:
    """The line without ASCII white space around it."""
    return F.trim(line, F.lit(WHITE))


def hashes(line: Column) -> list[Column]:
    return [F.xxhash64(line).alias("h"), F.xxhash64(F.lit(1), line).alias("h2")]


def boilerplate(pages: DataFrame, site: Column, text: Column, ratio: float, min_pages: int) -> DataFrame:
    """``site`` and ``gone``, the pairs of hashes of its boilerplate lines; only sites that have some."""
    rows = pages.select(site.alias("site"), text.alias("text"))
    totals = rows.groupBy("site").agg(F.count("*").alias("pages"))
    held = F.array_distinct(F.transform(F.split("text", "\n"), lambda x: bare(x)))
    lines = rows.select("site", F.explode(held).alias("line")).where("line <> ''")
    counts = lines.groupBy("site", *hashes(F.col("line"))).agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    often = counts.alias("c").join(totals.alias("t"), F.expr("c.site <=> t.site")).where(F.col("n") > ratio * F.col("pages"))
    return often.groupBy(F.col("c.site").alias("site")).agg(F.collect_set(F.struct("h", "h2")).alias("gone"))


def drop_boilerplate(pages: DataFrame, site: Column, text: str = "text", ratio: float = 0.1, min_pages: int = 2) -> DataFrame:
    """``pages`` with ``text`` rid of boilerplate lines, and the columns ``n_lines`` and ``n_dropped``."""
    gone = materialize(boilerplate(pages, site, F.col(text), ratio, min_pages), "boilerplate")  # its size is then known to the planner
    names = {k: f"_line_{k}" for k in ("site", "at", "gone", "lines", "bare", "left")}
    site_, at, gone_, lines_, bare_, left_ = names.values()
    gone = gone.withColumnsRenamed({"site": at, "gone": gone_})
    marked = pages.withColumn(site_, site).join(gone, F.col(site_).eqNullSafe(F.col(at)), "left").withColumn(lines_, F.split(text, "\n"))
    bares = F.transform(lines_, lambda x: bare(x))
    marked = marked.withColumn(bare_, F.when(F.col(gone_).isNotNull(), bares))
    left = F.filter(lines_, lambda x, i: (F.get(F.col(bare_), i) == "") | ~F.array_contains(F.col(gone_), F.struct(*hashes(F.get(F.col(bare_), i)))))
    marked = marked.withColumn(left_, F.when(F.col(gone_).isNull(), F.col(lines_)).otherwise(left))
    return marked.withColumns(
        {
            text: F.when(F.col(gone_).isNull(), F.col(text)).otherwise(F.array_join(left_, "\n")),
            "n_lines": F.coalesce(F.size(lines_), F.lit(0)).cast("long"),
            "n_dropped": F.coalesce(F.size(lines_) - F.size(left_), F.lit(0)).cast("long"),
        }
    ).drop(*names.values())


def host(url: Column) -> Column:
    """The lower-case host of a URL, without user and port; empty if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def page_text(html: Column) -> Column:
    """Lines of a page: one for each block element; scripts, styles, comments and tags go."""
    no_code = F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?</\1>|<!--.*?-->", "")
    blocks = F.regexp_replace(no_code, r"(?i)</?(?:p|div|br|li|ul|ol|h[1-6]|nav|article|section|header|footer|title|table|tr|body|html|head|main|aside|blockquote|pre)\b[^>]*>", "\n")
    return F.regexp_replace(blocks, r"<[^>]*>", "")
