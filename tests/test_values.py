"""Values worked out by hand, where a query's SQL follows the same rule as the query."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import language as L
from lodestone.functions import text as T
from lodestone.operators import documents as D
from lodestone.operators import guards as G
from lodestone.operators import pages as P
from lodestone.operators import search as S
from lodestone.plans.catalog import QUERIES
from lodestone.sources.tables import table


def one(spark, text: str, *columns):
    return tuple(spark.createDataFrame([(text,)], "t string").select(*columns).first())


def test_cover_density(spark):
    words = F.split("t", " ")
    rank = lambda text, query: round(one(spark, text, S.cover_density(words, S.query_groups(query)))[0], 6)
    assert rank("the cat and the dog", "the and") == round(0.1 / 2 + 0.1, 6)  # the cat and; and the
    assert rank("the x x x and", "the and") == round(0.1 / 4, 6)
    assert rank("the the and", "the and") == 0.1
    assert rank("a b a", "a") == 0.2
    assert rank("the cat", "the and") == 0.0


def test_near_duplicates(spark):
    a = "The supplier shall deliver the platform within 30 days of the order"
    near = lambda x, y: spark.createDataFrame([(x, y)], "a string, b string").select(T.near_duplicate(F.col("a"), F.col("b"))).first()[0]
    assert near(a, a.upper() + ".")
    assert near(a, "The supplier shall deliver its platform within 30 days of the first order")
    assert not near(a, a.replace("30", "60"))
    assert not near(a, a.replace("shall", "shall not"))
    assert not near("", "")


def test_sentences(spark):
    text = "Se f.eks. punkt 2. Frist er 3. mai 2025. Kostnad ca. 5 kr. Ferdig!"
    assert one(spark, text, T.sentences(F.col("t")))[0] == ["Se f.eks. punkt 2.", "Frist er 3. mai 2025.", "Kostnad ca. 5 kr.", "Ferdig!"]


def test_repairs(spark):
    broken = "L everandøren skal dele-\nlevere .Kundenskal se ID 1 - 2,og kjÃ¸re"
    assert one(spark, broken, L.canonical(F.col("t"), sentence=True))[0] == "Leverandøren skal delelevere. Kunden skal se ID 1-2, og kjøre."
    assert one(spark, "I D 1-2 (x", L.diagnostics(F.col("t")))[0] == ["spaced_requirement_id", "unbalanced_brackets"]


def test_page_markers(spark):
    found = one(spark, "a[[SIDE:2-4]]bb[[SIDE:7-5]]c[[SIDE:0]]", P.markers(F.col("t")))[0]
    assert [(m.start, m.stop, m.offset, m.after) for m in found] == [(2, 4, 1, 13), (7, 7, 15, 27)]
    assert tuple(one(spark, "se side 9[[SIDE:3]]", P.page_range(F.lit("page 12"), F.col("t")))[0]) == (3, 12)


def test_heading_paths(spark):
    heads = ["1 A", "1.1 B", None, "1.1.2 C", "2 D", "VEDLEGG", "2.3 E"]
    rows = spark.createDataFrame([(1, i, h) for i, h in enumerate(heads)], "d long, i long, h string")
    found = [r.path for r in P.heading_paths(rows, "d", "i", "h").orderBy("i").collect()]
    assert found == [["1 A"], ["1 A", "1.1 B"], ["1 A", "1.1 B"], ["1 A", "1.1 B", "1.1.2 C"], ["2 D"], ["VEDLEGG"], ["VEDLEGG", "2.3 E"]]


def test_chunks_cover_their_text(spark, sf):
    docs = table(spark, sf, "documents")
    texts = {r.doc_id: r.text for r in docs.collect()}
    chunks: dict[int, list] = {}
    for r in D.chunks(docs, longest=400, overlap=60).collect():
        chunks.setdefault(r.doc_id, []).append((r.chunk_index, r.offset, r.chunk))
    for doc, text in texts.items():
        covered = set()
        for i, (index, offset, chunk) in enumerate(sorted(chunks.get(doc, []))):
            assert index == i and len(chunk) <= 400
            start = text.index(chunk, offset)
            assert start - offset <= len(text[offset:]) - len(text[offset:].lstrip())
            covered |= set(range(start, start + len(chunk)))
        assert {i for i, c in enumerate(text) if not c.isspace()} <= covered


def test_assessments(spark):
    rows = [("Godt", "", True), ("Godt", "Vi kan ikke levere dette", True), ("Godt", "Vi kan ikke levere dette", False), ("Godt", "Se vedlegg 3", True), ("Mangler", "Full leveranse", True), ("Godt", "Se vedlegg 3, og løsningen gjør dette", True)]
    found = spark.createDataFrame(rows, "a string, t string, m boolean").select(G.corrected_assessment(F.col("a"), F.col("t"), F.col("m")).alias("x"))
    assert [r.x for r in found.collect()] == ["Mangler", "Dårlig", "Godt", "Uklart", "Mangler", "Godt"]


def test_requirement_ids_have_one_form(spark):
    form = lambda x: one(spark, x, L.normalized_requirement_id(F.col("t")))[0]
    assert [form(x) for x in ("krav nr. 4 . 2", "id12 – 3a", "req - 7", "fun-a01")] == ["Krav 4.2", "ID 12-3a", "REQ-7", "FUN-A01"]


def test_exact_terms_of_a_long_text(spark):
    """The first 36 terms whatever their case, from a text of many; its patterns are searched once (before: once for each term found)."""
    text = " ".join(f"K-{i % 4000} Ord-{i} ORD-{i % 50}" for i in range(20_000))
    rows = spark.createDataFrame([(text,), (None,), ("ABC abc-d ABC-D 12 timer Side 3",)], "t string").select(S.exact_terms(F.col("t")).alias("x")).collect()
    assert rows[0].x[:36] == [x for i in range(18) for x in (f"K-{i}", f"ORD-{i}")] and rows[1].x is None
    assert rows[2].x == ["ABC", "abc-d", "12 timer"]


def test_requirement_ids_are_found_once(spark, sf):
    """Both columns read one list (before: the text was searched for each)."""
    plan = QUERIES["requirement_ids"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") == 1


def test_ledger_contexts_carry_only_what_is_shown(spark, sf):
    """Texts are cut before the rows are shuffled and sorted (before: after both)."""
    plan = QUERIES["ledger_contexts"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "420)" in plan.rsplit("Window [", 1)[1]
