"""Aligning a ledger with its key, one to one, and finding a ledger's places in its source."""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.language import page_text
from lodestone.functions.requirements import let
from lodestone.operators.containment import containments
from lodestone.session import ship
from lodestone.sources.scratch import materialize

CONTAINED = 48  # characters from which a row may be matched by containment
LEAD_WORDS, LEAD_CHARS = 12, 24


class Free:
    """Free entries, of which rows that rise take the nearest. Those below the row wait on a stack, those above in a queue, so that a step looks at two of them."""

    def __init__(self) -> None:
        self.entries: list[int] = []  # rising
        self.below: list[int] = []
        self.above = 0

    def nearest(self, row: int) -> tuple[int, int] | None:
        """``gap, entry`` of the nearest, the lower of two."""
        upto = bisect.bisect_right(self.entries, row, self.above)
        self.below.extend(self.entries[self.above : upto])
        self.above = upto
        down = [(row - self.below[-1], self.below[-1])] if self.below else []
        up = [(self.entries[upto] - row, self.entries[upto])] if upto < len(self.entries) else []
        return min(down + up, default=None)

    def take(self, entry: int) -> None:
        """Takes the entry that was the nearest."""
        if self.below and self.below[-1] == entry:
            self.below.pop()
        else:
            self.above += 1


def nearest_in_order(rows: list[int], entries: list[int]) -> list[tuple[int, int]]:
    """Each row in turn takes the nearest free entry, the lower of two; all are alike. Both lists rise."""
    free = Free()
    free.entries = entries
    out = []
    for row in rows:
        found = free.nearest(row)
        if not found:
            break
        free.take(found[1])
        out.append((row, found[1]))
    return out


def _equal(rows: DataFrame, entries: DataFrame, doc: str) -> DataFrame:
    """Rows and entries of equal text. Only places of texts that a document repeats meet in a task, one text of one document each."""
    kind = dict(rows.dtypes)[doc]
    r, e = rows.groupBy(doc, "text").agg(F.sort_array(F.collect_list("row")).alias("rows")), entries.groupBy(doc, "text").agg(F.sort_array(F.collect_list("entry")).alias("entries"))
    both = r.join(e, [doc, "text"]).select(doc, "rows", "entries")
    single = both.where((F.size("rows") == 1) & (F.size("entries") == 1)).select(doc, F.col("rows")[0].alias("row"), F.col("entries")[0].alias("entry"))

    def match(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            found = [(d, i, j) for d, own, free in zip(f[doc], f["rows"], f["entries"], strict=True) for i, j in nearest_in_order(list(own), list(free))]
            yield pd.DataFrame(found, columns=[doc, "row", "entry"])

    ship(rows.sparkSession)
    many = both.where((F.size("rows") > 1) | (F.size("entries") > 1)).mapInPandas(match, f"{doc} {kind}, row int, entry int")
    return single.unionByName(many)


def fitting_texts(rows: DataFrame, entries: DataFrame, doc: str) -> tuple[DataFrame, DataFrame]:
    """``doc, row, kind`` of every kind of entries that a row fits, and ``doc, entry, kind``. Entries of one text are one kind.

    Which text lies in which is found once for two texts of a document, however many rows and entries have them.
    """
    own = materialize(rows.groupBy(doc, "text").agg(F.min("row").alias("own")), "texts")
    kinds = materialize(entries.groupBy(doc, "text").agg(F.min("entry").alias("kind")), "kinds")
    within = containments(kinds, own, [doc], "kind", "own").select(doc, "kind", "own")
    around = containments(own, kinds, [doc], "own", "kind").select(doc, "kind", "own")
    fits = materialize(within.unionByName(around).distinct(), "fits")
    asked = rows.join(own.join(fits, [doc, "own"]).select(doc, "text", "kind"), [doc, "text"]).select(doc, "row", "kind")
    offered = entries.join(kinds.join(fits.select(doc, "kind").distinct(), [doc, "kind"]), [doc, "text"]).select(doc, "entry", "kind")
    return asked, offered


def first_come(asked: DataFrame, offered: DataFrame, doc: str) -> DataFrame:
    """``doc, row, entry``: each row in turn takes its nearest free entry among the kinds that it asks for, the lower of two.

    asked: ``doc, row, kind``, offered: ``doc, entry, kind``. Choices depend on
    all earlier ones of the document, so its rows pass one task in order; only
    the places of its entries are kept there, and a row looks at two of a kind.
    """
    key = dict(asked.dtypes)[doc]
    either = offered.select(doc, F.lit(False).alias("asks"), F.col("entry").alias("place"), "kind").unionByName(asked.select(doc, F.lit(True).alias("asks"), F.col("row").alias("place"), "kind"))
    ordered = either.repartition(doc).sortWithinPartitions(doc, "asks", "place", "kind")

    def choose(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, row, free, best = object(), None, {}, None

        def settle(found: list[tuple]) -> None:
            if best:
                free[best[2]].take(best[1])
                found.append((at, row, best[1]))

        for f in frames:
            found = []
            for d, asks, place, kind in zip(f[doc].tolist(), f["asks"].tolist(), f["place"].tolist(), f["kind"].tolist(), strict=True):
                if d != at or place != row:
                    settle(found)
                    row, best = place, None
                    if d != at:
                        at, free = d, {}
                if not asks:
                    free.setdefault(kind, Free()).entries.append(place)
                elif near := free[kind].nearest(place):
                    best = min(best or (*near, kind), (*near, kind))
            yield pd.DataFrame(found, columns=[doc, "row", "entry"])
        last: list[tuple] = []
        settle(last)
        yield pd.DataFrame(last, columns=[doc, "row", "entry"])

    ship(asked.sparkSession)
    return ordered.mapInPandas(choose, f"{doc} {key}, row int, entry int")


def align(rows: DataFrame, entries: DataFrame, doc: str) -> tuple[DataFrame, DataFrame]:
    """``doc, row, entry, kind`` of every row, and ``doc, entry`` of the entries left over.

    rows: ``doc, row, text``, entries: ``doc, entry, text``, both numbered from
    0 in a document, texts in comparable form. Three passes, each over what the
    one before left: the same text at the same place (``ordered``), the same
    text elsewhere (``unordered``), and, for rows of at least 48 characters, a
    text that holds the other (``fuzzy``). In each, rows choose in order, and
    the nearest entry is taken, the lower of two.

    Nulls and edges: a null or empty text matches only at its own place; a document without entries has only nulls; rows must not repeat a place.
    """
    rows = materialize(rows.select(doc, F.col("row").cast("int").alias("row"), F.coalesce("text", F.lit("")).alias("text")), "rows")
    entries = materialize(entries.select(doc, F.col("entry").cast("int").alias("entry"), F.coalesce("text", F.lit("")).alias("text")), "entries")
    same = rows.alias("r").join(entries.alias("e"), (F.col(f"r.{doc}") == F.col(f"e.{doc}")) & (F.col("r.row") == F.col("e.entry")) & (F.col("r.text") == F.col("e.text")))
    matches = [materialize(same.select(f"r.{doc}", "row", "entry"), "ordered")]

    def left(side: DataFrame, place: str) -> DataFrame:
        for m in matches:
            side = side.join(m.select(doc, place), [doc, place], "left_anti")
        return side.where("text <> ''")

    matches.append(materialize(_equal(left(rows, "row"), left(entries, "entry"), doc), "unordered"))
    free_rows, free_entries = materialize(left(rows, "row").where(F.length("text") >= CONTAINED), "rows"), materialize(left(entries, "entry"), "entries")
    matches.append(first_come(*fitting_texts(free_rows, free_entries, doc), doc))
    kinds = zip(matches, ("ordered", "unordered", "fuzzy"), strict=True)
    found = None
    for m, kind in kinds:
        m = m.withColumn("kind", F.lit(kind))
        found = m if found is None else found.unionByName(m)
    found = materialize(found, "matches")
    return rows.select(doc, "row").join(found, [doc, "row"], "left"), entries.select(doc, "entry").join(found.select(doc, "entry"), [doc, "entry"], "left_anti")


def source_offsets(text: Column, values: Column) -> Column:
    """Where each of ``values`` begins in ``text`` (from 0), searched from behind the one before it; null where it is not found.

    Both are compared on one line, in lower case. A value that does not occur is
    looked for by its first twelve words, if these have 24 characters. The
    search never goes back, so repeated values get successive places.
    """

    def step(state: Column, value: Column) -> Column:
        def found(needle: Column) -> Column:
            lead = F.array_join(F.slice(F.split(needle, " "), 1, LEAD_WORDS), " ")
            search = lambda x: let(F.call_function("locate", x, state["text"], state["cursor"] + 1), lambda p: F.when(p > 0, p))
            whole = F.when(needle != "", search(needle))
            first = F.coalesce(whole, F.when((needle != "") & (F.length(lead) >= LEAD_CHARS), search(lead))) - 1
            made = lambda at: F.struct(state["text"].alias("text"), F.coalesce(at + F.length(needle), state["cursor"]).alias("cursor"), F.concat(state["out"], F.array(at)).alias("out"))
            return let(first, made)  # each search is made once

        return F.element_at(F.transform(F.array(F.lower(page_text(value))), found), 1)

    start = F.struct(F.lower(page_text(text)).alias("text"), F.lit(0).alias("cursor"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(values, start, step, lambda s: s["out"])
