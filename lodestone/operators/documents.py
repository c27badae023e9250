"""From document text to lines, chunks, evidence and a ledger."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LONGEST, OVERLAP = 4800, 550

# What marks a passage as evidence of a kind, in order of precedence.
EVIDENCE = [
    ("evaluation_criterion", "evalueringskriter|tildelingskriter|award criteria|evaluation criteria|vekting|poengscore"),
    ("deadline", "frist|deadline|tilbudsfrist|leveringsdato|oppstart|senest"),
    ("commercial_term", "pris|kostnad|budsjett|faktur|betaling|vederlag|opsjon|price|cost|commercial"),
    ("risk", "risiko|usikkerhet|konsekvens|sårbarhet|avvik|risk|threat"),
    ("dependency", "avhengig|forutsetning|betinget av|integrasjon mot|dependency|prerequisite"),
    ("architecture", "arkitektur|plattform|integrasjon|grensesnitt|api|infrastruktur|sikkerhet|architecture"),
    ("goal", "mål|hensikt|formål|gevinst|effektmål|objective|outcome|benefit"),
    ("decision", "beslutning|valgt|vedtatt|skal benytte|decision|selected"),
    ("requirement", "krav|skal|må|shall|must|required|requirement"),
]


# What is selected first.
PRIORITY = {
    "evaluation_criterion": 10, "requirement": 9, "deadline": 8, "commercial_term": 7, "risk": 6,
    "dependency": 5, "architecture": 4, "goal": 3, "decision": 2, "table": 1,
}


def whole_word(text: Column, alternatives: str) -> Column:
    """Whether one of the alternatives occurs with no letter, digit or underscore beside it, in any alphabet."""
    return F.lower(text).rlike(rf"(^|[^\p{{L}}\p{{N}}_])(?:{alternatives})($|[^\p{{L}}\p{{N}}_])")


def lines(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``id_column, line_no`` (from 1) and ``line``, trimmed; empty lines are left out."""
    tidy = F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))  # below the generator, so that a filter does not repeat it
    rows = docs.select(id_column, F.posexplode(tidy).alias("line_no", "line"))
    return rows.select(id_column, (F.col("line_no") + 1).alias("line_no"), "line").where("line <> ''")


def is_heading(line: Column) -> Column:
    """Numbered lines, named sections, and lines in capitals."""
    shape = line.rlike(r"(?i)^(kapittel|chapter|section|del|vedlegg|appendix)[^\p{L}\p{N}_]") | line.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3})*\s+\S+")
    return F.length(line).between(4, 140) & (shape | line.rlike(r"^[A-ZÆØÅ][A-ZÆØÅ0-9\s:()/.+-]{7,}$"))


def with_heading(rows: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """``lines`` with the last heading at or before each."""
    w = Window.partitionBy(id_column).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("heading", F.last(F.when(is_heading(F.col("line")), F.col("line")), ignorenulls=True).over(w))


def ledger(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Per document: lines, headings, table lines, requirement lines, contents lines, and a confidence from 0 to 1."""
    line = F.col("line")
    marks = lines(docs, id_column).select(
        id_column,
        is_heading(line).alias("h"),
        line.contains(" | ").alias("t"),
        listed(line, EVIDENCE[-1][1]).alias("r"),
        line.rlike(r"\.{4,}\s*[0-9]{1,4}\s*$").alias("c"),
    )
    counts = marks.groupBy(id_column).agg(F.count("*").alias("n_lines"), *[F.count(F.when(F.col(k), 1)).alias(n) for k, n in (("h", "headings"), ("t", "table_lines"), ("r", "requirements"), ("c", "contents"))])
    score = F.least(F.lit(1.0), 0.2 + 0.2 * (F.col("headings") > 0).cast("int") + 0.2 * (F.col("table_lines") > 0).cast("int") + 0.3 * (F.col("requirements") > 0).cast("int") + 0.1 * (F.col("contents") > 0).cast("int"))
    return counts.withColumn("confidence", F.round(score, 2))


def repeated_margins(pages: DataFrame, id_column: str, page: str, order: str, line: str, share: float = 0.6, least: int = 3) -> DataFrame:
    """Lines that stand among the first or last two of at least max(least, share of all) pages of their document."""
    top, bottom = (Window.partitionBy(id_column, page).orderBy(o) for o in (F.asc(order), F.desc(order)))
    placed = pages.withColumns({"_t": F.row_number().over(top), "_b": F.row_number().over(bottom), "_key": F.lower(F.trim(F.regexp_replace(line, "[0-9]+", "#")))})
    margin = placed.where("_t <= 2 or _b <= 2").groupBy(id_column, "_key").agg(F.countDistinct(page).alias("on"))
    total = pages.groupBy(id_column).agg(F.countDistinct(page).alias("pages"))
    return margin.join(total, id_column).where(F.col("on") >= F.greatest(F.lit(least), F.ceil(F.col("pages") * share))).select(id_column, F.col("_key").alias("key"), "on")


def without_margins(pages: DataFrame, id_column: str, page: str, order: str, line: str, **kwargs) -> DataFrame:
    """``pages`` without the repeated margins."""
    gone = repeated_margins(pages, id_column, page, order, line, **kwargs).select(id_column, "key")
    keyed = pages.withColumn("key", F.lower(F.trim(F.regexp_replace(line, "[0-9]+", "#"))))
    return keyed.join(gone, [id_column, "key"], "left_anti").drop("key")


def split_overlapping(text: str, longest: int = LONGEST, overlap: int = OVERLAP) -> list[tuple[int, str]]:
    """Offsets and pieces of a text, cut at a paragraph, line, sentence or word in the last part of each, and overlapping."""
    pieces, at = [], 0
    while at < len(text):
        stop = at + longest
        if stop >= len(text):
            stop = len(text)
        else:
            early = at + int(longest * 0.72)
            for mark, keep in (("\n\n", 0), ("\n", 0), (". ", 1), ("? ", 1), ("! ", 1), (" ", 0)):
                found = text.rfind(mark, early, stop)
                if found >= 0:
                    stop = found + keep
                    break
        piece = text[at:stop].strip()
        if piece:
            pieces.append((at, piece))
        if stop >= len(text):
            break
        at = stop - overlap if stop - overlap > at else stop
    return pieces


def chunks(docs: DataFrame, id_column: str = "doc_id", text: str = "text", longest: int = LONGEST, overlap: int = OVERLAP) -> DataFrame:
    """``id_column, chunk_index, offset, chunk, kind, content_hash`` of overlapping chunks.

    The cursor runs through each text in turn, which no built-in expresses; batches of rows go to Python.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(doc, i, at, piece) for doc, body in zip(batch["id"], batch["body"], strict=True) for i, (at, piece) in enumerate(split_overlapping(body or "", longest, overlap))]
            yield pd.DataFrame(rows, columns=["id", "chunk_index", "offset", "chunk"])

    from lodestone.session import ship

    ship(docs.sparkSession)
    cut = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text).alias("body")).mapInPandas(run, "id long, chunk_index long, offset long, chunk string")
    return cut.select(F.col("id").alias(id_column), "chunk_index", "offset", "chunk", chunk_kind(F.col("chunk")).alias("kind"), F.sha2("chunk", 256).alias("content_hash"))


# Words that make a chunk of a kind, in order of precedence.
KIND_WORDS = {
    "evaluation_criteria": "evalueringskriter|award criteria|tildelingskriter|evaluation criteria",
    "risk": "risiko|risk|sårbarhet|mitigering|avvik",
    "commercial_term": "pris|kostnad|betaling|kontrakt|sanksjon|dagmulkt|commercial|pricing",
    "architecture_signal": "arkitektur|architecture|integrasjon|api|plattform|sikkerhet|identity|monitorering|backup",
    "requirement": "req|requirement|krav|kravtekst|shall|must|skal|må",
    "table": "table|tabell|row|rad|kolonne|column",
}
REQUIREMENT_ID = r"(?<![A-Za-z0-9_])[A-Z]{1,8}-?\d{1,5}(?:\.\d+)*(?![A-Za-z0-9_])"


def listed(text: Column, alternatives: str) -> Column:
    """Whether a text has one of the words or phrases; words are compared as a set, only phrases need a pattern."""
    low = F.lower(text)
    single, phrases = [w for w in alternatives.split("|") if " " not in w], [w for w in alternatives.split("|") if " " in w]
    test = F.arrays_overlap(F.split(low, r"[^\p{L}\p{N}_]+"), F.array(*map(F.lit, single)))
    for p in phrases:
        test = test | (low.contains(p) & whole_word(text, p))
    return test


def chunk_kind(text: Column, reference: Column | None = None, file_format: Column | None = None) -> Column:
    """The kind of a chunk, the first rule that fits; the format of its file and the name of its place tell of rows, answers and pages."""
    head = F.element_at(F.filter(F.split(text, "\n"), lambda x: F.trim(x) != ""), 1)
    place = F.lower(F.coalesce(reference, F.lit(""))) if reference is not None else F.lit("")
    required = listed(text, KIND_WORDS["requirement"]) | text.rlike(REQUIREMENT_ID)
    barred = text.contains(" | ")
    rules = [(name, listed(text, KIND_WORDS[name])) for name in ("evaluation_criteria", "risk", "commercial_term", "architecture_signal")]
    if reference is not None:
        rules += [("answer_cell", required & listed(place, "svar|answer|besvarelse|response")), ("requirement_row", required & (listed(place, "tabell|table|rad|row") | barred))]
    rules += [("requirement", required), ("table", barred | listed(text, KIND_WORDS["table"]))]
    if reference is not None:
        rules.append(("page", place.rlike(r"(^|[^a-z0-9_])side\s+\d+")))
    rules.append(("section", is_heading(head)))
    if file_format is not None:
        rules.insert(0, ("spreadsheet_rows", file_format.isin("xlsx", "xls")))
    kind = F.when(rules[0][1], rules[0][0])
    for name, test in rules[1:]:
        kind = kind.when(test, name)
    return kind.otherwise("paragraph")


def evidence_kinds(text: Column) -> tuple[Column, Column]:
    """The evidence words of a text, to be kept as ``_hits``, and the kinds of evidence that it gives by them.

    Words are compared as a set; only phrases of several words need a pattern.
    """
    low = F.lower(text)
    words = F.split(low, r"[^\p{L}\p{N}_]+")
    kinds = []
    for kind, listed in EVIDENCE:
        single, phrases = [w for w in listed.split("|") if " " not in w], [w for w in listed.split("|") if " " in w]
        test = F.arrays_overlap("_hits", F.array(*map(F.lit, single)))
        for p in phrases:
            test = test | (low.contains(p) & whole_word(text, p))
        kinds.append((kind, test))
    named = sorted({w for _, listed in EVIDENCE for w in listed.split("|") if " " not in w})
    hits = F.array_intersect(words, F.array(*map(F.lit, named)))
    return hits, F.array_compact(F.array(*[F.when(test, F.lit(k)) for k, test in kinds]))


def evidence(docs: DataFrame, id_column: str = "doc_id", reference: str | None = None) -> DataFrame:
    """Lines of twelve characters or more that give evidence, one row a kind, each text once a reference and kind.

    reference: column that names where a text stands; the id by default.
    """
    place = F.col(reference or id_column).cast("string")
    rows = lines(docs.withColumn("_place", place).withColumn("_key", F.struct(id_column, "_place")), "_key").where(F.length("line") >= 12)
    hits, kinds = evidence_kinds(F.col("line"))
    found = rows.withColumn("_hits", hits).withColumn("_kinds", kinds)
    found = found.withColumn("_kinds", F.when((F.size("_kinds") == 0) & F.col("line").contains(" | "), F.array(F.lit("table"))).otherwise(F.col("_kinds")))
    each = found.select(f"_key.{id_column}", F.col("_key._place").alias("reference"), "line_no", "line", F.explode_outer("_kinds").alias("kind")).where("kind is not null")  # explode would push a filter that repeats the kinds
    print_ = F.sha2(F.concat_ws("\n", "kind", F.lower("line"), "reference"), 256)
    first = each.withColumn("evidence_id", F.concat(F.lit("ev_"), F.substring(print_, 1, 16))).groupBy(id_column, "kind", "evidence_id")
    return first.agg(F.min("line_no").alias("line_no"), F.min_by("line", "line_no").alias("line"))


def select_evidence(rows: DataFrame, id_column: str = "doc_id", reserve: int = 6, limit: int = 240) -> DataFrame:
    """Of each document ``reserve`` of every kind, then the first others until there are ``limit``.

    First are the kinds of highest priority, then the lowest lines.
    """
    ranks = F.create_map(*[x for k, v in PRIORITY.items() for x in (F.lit(k), F.lit(v))])
    order = [F.desc("_p"), F.col("line_no"), F.col("evidence_id")]
    placed = rows.withColumn("_p", ranks[F.col("kind")])
    placed = placed.withColumn("_k", F.row_number().over(Window.partitionBy(id_column, "kind").orderBy(*order)) <= reserve)
    whole = Window.partitionBy(id_column)
    placed = placed.withColumns({"_reserved": F.count_if("_k").over(whole), "_g": F.row_number().over(Window.partitionBy(id_column, "_k").orderBy(*order))})
    return placed.where(F.col("_k") | (F.col("_g") <= limit - F.col("_reserved"))).drop("_p", "_k", "_reserved", "_g")


def tables(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Runs of lines with bars, as cells: ``id_column, table_no, row_no, cells``."""
    rows = docs.select(id_column, F.posexplode(F.split(text, "\n")).alias("n", "line")).withColumn("bar", F.col("line").contains("|"))
    w = Window.partitionBy(id_column).orderBy("n")
    begins = rows.withColumn("new", (F.col("bar") & ~F.coalesce(F.lag("bar").over(w), F.lit(False))).cast("int"))
    grouped = begins.withColumn("table_no", F.sum("new").over(w)).where("bar")
    inside = Window.partitionBy(id_column, "table_no").orderBy("n")
    cells = F.transform(F.split(F.regexp_replace(F.trim("line"), r"^\||\|$", ""), r"\|"), lambda x: F.trim(x))
    return grouped.select(id_column, "table_no", F.row_number().over(inside).alias("row_no"), cells.alias("cells"))


def parse_quality(coverage: Column, readability: Column, structure: Column, anomalies: Column) -> Column:
    """A score from 0 to 1: weighted parts less a bounded penalty for anomalies."""
    score = 0.42 * coverage + 0.38 * readability + 0.2 * structure - F.least(F.lit(0.28), 0.055 * anomalies)
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 3)


def route(quality: Column) -> Column:
    """Which parser a document goes to, by the quality of its first parse."""
    return F.when(quality < 0.35, "ocr").when(quality < 0.58, "layout").when(quality < 0.76, "structure").otherwise("accept")
