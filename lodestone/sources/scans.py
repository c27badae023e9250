"""Scans of documents that were decoded already, and sinks as pure functions of snapshots."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.session import map_arrow

# The first bytes of each format.
ZIP = ["504B0304", "504B0506", "504B0708"]
PDF, COMPOUND = "255044462D", "D0CF11E0A1B11AE1"
CELLS = "struct<table_cells:array<struct<text:string,start_row_offset_idx:int,start_col_offset_idx:int,column_header:boolean>>>"
BLOCK_ROWS = 25


def signature_fits(content: Column, declared: Column) -> Column:
    """Whether a file's first bytes are those of its declared format; text has no zero byte."""
    head = F.hex(F.substring(content, 1, 8))
    zipped = F.substring(head, 1, 8).isin(*ZIP)
    return (
        F.when(declared == "pdf", F.startswith(head, F.lit(PDF)))
        .when(declared.isin("docx", "xlsx"), zipped)
        .when(declared == "xls", head == COMPOUND)
        .when(declared.isin("txt", "md"), ~F.hex(content).rlike("^(?:..)*?00(?:..)*$"))
        .otherwise(True)
    )


def glyph_lines(items: DataFrame, page: str, near: float = 2.0, gap: float = 3.0) -> DataFrame:
    """``page, line_no, text`` of ``items(page, item_no, x, y, width, text)``.

    An item joins the first line whose height is within ``near`` of its own, in
    order of item_no; lines are read from the top, items from the left, with a
    space where more than ``gap`` lies between two. Pages pass their tasks in
    order, one page's items at a time.
    """

    def read(at: int | None, lines: list[tuple[float, list]]) -> list[tuple]:
        out = []
        for _, held in sorted(lines, key=lambda line: -line[0]):
            end, text = None, ""
            for x, _, piece, width in sorted(held):
                text += (" " if end is not None and x - end > gap else "") + piece
                end = x + width
            out.append((at, len(out) + 1, " ".join(text.split())))
        return out

    def batch(found: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], kind) for i, kind in enumerate(kinds)], ["page", "line_no", "text"])

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = float("nan")
        at, begun, lines = None, False, []
        for b in batches:
            found = []
            for p, number, x, y, width, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if not begun or p != at:
                    found += read(at, lines)
                    at, begun, lines = p, True, []
                text = (text or "").strip()
                if not text:
                    continue
                x, y, width = (none if v is None else v for v in (x, y, width))
                for top, held in lines:
                    if abs(top - y) <= near:
                        held.append((x, number, text, width))
                        break
                else:
                    lines.append((y, [(x, number, text, width)]))
            yield batch(found)
        yield batch(read(at, lines))

    shaped = items.select(F.col(page).cast("long").alias("page"), "item_no", "x", "y", "width", "text")
    return map_arrow(shaped.repartition("page").sortWithinPartitions("page", "item_no"), rebuild, "page long, line_no long, text string")


def column_letters(index: Column) -> Column:
    """A, B, .. Z, AA, .. of a column index from 0, up to ZZ."""
    letter = lambda i: F.chr(i + 65)
    return F.when(index < 26, letter(index)).otherwise(F.concat(letter(F.floor(index / 26) - 1), letter(index % 26)))


def sheet_blocks(cells: DataFrame, sheet: str) -> DataFrame:
    """``sheet, block, first_row, last_row, text`` of ``cells(sheet, row, col, text)``: rows that hold something, by twenty-five."""
    held = cells.where(F.trim(F.coalesce("text", F.lit(""))) != "")
    entry = F.concat(column_letters(F.col("col")), (F.col("row") + 1).cast("string"), F.lit(": "), F.trim("text"))
    rows = held.groupBy(sheet, "row").agg(F.array_sort(F.collect_list(F.struct("col", entry.alias("t")))).alias("c"))
    lines = rows.select(sheet, "row", F.concat(F.lit("Rad "), (F.col("row") + 1).cast("string"), F.lit(": "), F.array_join(F.transform("c", lambda x: x["t"]), " | ")).alias("line"))
    placed = lines.withColumn("n", F.row_number().over(Window.partitionBy(sheet).orderBy("row")) - 1)
    blocks = placed.withColumn("block", F.floor(F.col("n") / BLOCK_ROWS)).groupBy(sheet, "block").agg(F.array_sort(F.collect_list(F.struct("n", "line"))).alias("l"))
    body = F.array_join(F.transform("l", lambda x: x["line"]), "\n")
    return blocks.select(sheet, "block", (F.col("block") * BLOCK_ROWS + 1).alias("first_row"), (F.col("block") * BLOCK_ROWS + F.size("l")).alias("last_row"), F.concat(F.lit("Ark: "), F.col(sheet).cast("string"), F.lit("\n"), body).alias("text"))


def _runs(ordered: Column, of: Callable[[Column], Column]) -> Column:
    """The runs of an ordered array in which ``of`` stays the same, as arrays."""
    starts = F.filter(F.transform(ordered, lambda x, i: F.when((i == 0) | (of(x) != of(F.get(ordered, i - 1))), i + 1)), lambda i: i.isNotNull())
    # ``starts`` is one run's begin after another; each ends where the next begins.
    return F.zip_with(starts, F.concat(F.slice(starts, F.lit(2), F.size(ordered)), F.array(F.size(ordered) + 1)), lambda a, z: F.struct(a.alias("at"), (z - a).alias("n")))


def table_rows(tables: DataFrame, key: str, json: str) -> DataFrame:
    """``key, row, text`` of layout tables in JSON: ``name: value`` of every cell of a row that is no header.

    Header rows are those that are marked, or else the first of several; names
    that repeat get a number; cells of one place are joined. A table is read in
    its own row: cells are put in order once, and rows, columns and places are
    runs of neighbours.
    """
    tidy = lambda t: F.trim(F.regexp_replace(F.coalesce(t, F.lit("")), r"\s+", " "))
    placed = F.filter(F.from_json(json, CELLS)["table_cells"], lambda c: c["start_row_offset_idx"].isNotNull() & c["start_col_offset_idx"].isNotNull())
    cell = lambda c: F.struct(c["start_row_offset_idx"].alias("row"), c["start_col_offset_idx"].alias("col"), tidy(c["text"]).alias("text"), F.coalesce(c["column_header"], F.lit(False)).alias("header"))
    cells = tables.where(F.col(key).isNotNull()).select(key, F.transform(placed, cell).alias("_cells"))
    cells = cells.groupBy(key).agg(F.sort_array(F.flatten(F.collect_list("_cells"))).alias("_cells"))
    rows = cells.withColumn("_runs", _runs(F.col("_cells"), lambda c: c["row"]))
    rows = rows.select(key, "_cells", F.transform("_runs", lambda r: F.slice("_cells", r["at"], r["n"])).alias("_rows"))
    any_head = F.exists("_cells", lambda c: c["header"])
    is_head = lambda r, i: F.when(F.col("_any"), F.exists(r, lambda c: c["header"])).otherwise((i == 0) & (F.size("_rows") > 1))
    named = lambda r: F.filter(r, lambda c: c["text"] != "")
    # Every column begins with an empty entry, so that those without a name have their place too.
    empty = F.transform(F.array_distinct(F.transform("_cells", lambda c: c["col"])), lambda c: F.struct(c.alias("col"), F.lit(None).cast("int").alias("row"), F.lit("").alias("text")))
    head = F.transform(named(F.flatten(F.filter("_rows", is_head))), lambda c: F.struct(c["col"].alias("col"), c["row"].alias("row"), c["text"].alias("text")))
    parts = rows.withColumn("_any", any_head).select(
        key,
        F.sort_array(F.concat(empty, head)).alias("_head"),
        F.filter(F.transform(F.filter("_rows", lambda r, i: ~is_head(r, i)), named), lambda r: F.size(r) > 0).alias("_held"),
    )
    parts = parts.withColumn("_runs", _runs(F.col("_head"), lambda c: c["col"]))
    parts = parts.withColumn("_cols", F.transform("_runs", lambda r: F.get("_head", r["at"] - 1)["col"]))
    words = lambda r: F.array_join(F.transform(F.slice("_head", r["at"] + 1, r["n"] - 1), lambda c: c["text"]), " ")
    parts = parts.withColumn("_names", F.transform("_runs", lambda r, i: F.when(r["n"] > 1, words(r)).otherwise(F.concat(F.lit("Kolonne "), (i + 1).cast("string")))))
    parts = parts.withColumn("_low", F.transform("_names", F.lower))
    again = lambda i: F.size(F.filter(F.slice("_low", 1, i + 1), lambda x: x == F.get("_low", i)))
    numbered = F.transform("_names", lambda x, i: F.when(again(i) == 1, x).otherwise(F.concat_ws(" ", x, again(i).cast("string"))))
    parts = parts.withColumn("_names", F.when(F.size(F.array_distinct("_low")) == F.size("_low"), F.col("_names")).otherwise(numbered))
    direct = lambda col: F.try_subtract(col, F.get("_cols", F.lit(0)))
    name = lambda col: F.when(F.get("_cols", direct(col)) == col, F.get("_names", direct(col))).otherwise(F.get("_names", F.array_position("_cols", col).cast("int") - 1))
    lead = lambda r, c, i: F.when((i > 0) & (F.get(r, i - 1)["col"] == c["col"]), F.lit(" ")).otherwise(F.concat(F.when(i > 0, F.lit(" | ")).otherwise(F.lit("")), name(c["col"]), F.lit(": ")))
    line = lambda r: F.array_join(F.transform(r, lambda c, i: F.concat(lead(r, c, i), c["text"])), "")
    return parts.select(key, F.inline(F.transform("_held", lambda r: F.struct(F.get(r, F.lit(0))["row"].alias("row"), line(r).alias("text")))))


def recordset(rows: DataFrame, key: str, json: str, schema: str) -> DataFrame:
    """The records of a JSON array in each row, as columns."""
    return rows.select(key, F.inline(F.from_json(json, f"array<struct<{schema}>>")))


def upserted(base: DataFrame, changes: DataFrame, keys: list[str], update: bool = True) -> DataFrame:
    """``base`` with the rows of ``changes``, those of equal keys replaced; with ``update`` false they stay as they are."""
    kept, new = (base.join(changes.select(*keys), keys, "left_anti"), changes) if update else (base, changes.join(base.select(*keys), keys, "left_anti"))
    return kept.unionByName(new.select(*base.columns))


def deleted(base: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """``base`` without the rows whose keys ``gone`` has."""
    return base.join(gone.select(*keys).distinct(), keys, "left_anti")


def report_lines(rows: DataFrame, columns: list[str]) -> DataFrame:
    """``line`` of a Markdown table for each row: bars escaped, breaks as spaces."""
    cells = [F.replace(F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"\s*\n\s*", " "), F.lit("|"), F.lit(r"\|")) for c in columns]
    return rows.select("*", F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


def write_report(rows: DataFrame, columns: list[str], path: str) -> None:
    """The rows as JSON lines and as Markdown lines, below ``path``."""
    rows.select(*columns).write.json(f"{path}/json")
    report_lines(rows, columns).select("line").write.text(f"{path}/markdown")


def evidence_segments(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Texts of over 900 characters as runs of sentences of up to 1,200; others whole."""
    import re

    for batch in texts:
        out = []
        for text in batch:
            tidy = " ".join((text or "").split())
            if len(tidy) <= 900:
                out.append([tidy] if tidy else [])
                continue
            parts, held = [], ""
            for sentence in re.findall(r"[^.!?;]+(?:[.!?;]+|$)", tidy) or [tidy]:
                more = " ".join(x for x in (held, sentence.strip()) if x)
                if len(more) > 1200 and held:
                    parts.append(held)
                    held = sentence.strip()
                else:
                    held = more
            out.append([*parts, held] if held else parts)
        yield pd.Series(out)
