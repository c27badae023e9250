"""Facts left out of an analysis: worked values, the share of four fifths, and edges."""

from __future__ import annotations

from lodestone.operators.fact_coverage import missing_facts

FACTS, FIELDS = "id int, fact int, category string, text string", "id int, field string, category string, text string"


def added(spark, fact: str | None, said: str | None) -> list[str]:
    rows = missing_facts(spark.createDataFrame([(1, 0, "scale", fact)], FACTS), spark.createDataFrame([(1, "profile", "scale", said)], FIELDS), ["id"])
    return [r.added for r in rows.collect()]


def test_values(spark):
    cases = [
        ("Dokumenterte volumer: 12 klinikker; 210 000 konsultasjoner per år.", "Niva har 12 klinikker.", ["Dokumenterte volumer: 210 000 konsultasjoner per år."]),
        ("Dokumenterte tekniske grenseverdier: RTO 4 timer; RPO 30 minutter", "", ["RTO 4 timer. RPO 30 minutter."]),
        ("Dokumenterte milepæler: oppstart 1. mai | drift 1. juni; senest", "oppstart 1 mai", ["drift 1. juni; senest."]),
        ("Tilbudsfrist er satt", "annet", ["Dokumentert fakta: Tilbudsfrist er satt."]),
        # four of five tokens stand in the text, then three of five
        ("Dokumenterte krav: alfa beta gamma delta epsilon", "delta og alfa, gamma; beta", []),
        ("Dokumenterte krav: alfa beta gamma delta epsilon", "alfa, gamma; beta", ["Dokumenterte krav: alfa beta gamma delta epsilon."]),
        # one token never is enough unless the whole value stands there
        ("Dokumenterte krav: alfa", "xalfax", []),
        ("Dokumenterte krav: alfa og beta", "alfa", ["Dokumenterte krav: alfa og beta."]),
        # like a value that stands there, like an earlier one, and not like it by a number
        ("Dokumenterte krav: alfa beta gamma; alfa beta zeta", "alfa beta gamma", []),
        ("Dokumenterte krav: alfa beta gamma; alfa beta zeta; alfa beta 7", "", ["Dokumenterte krav: alfa beta gamma; alfa beta 7."]),
        # chains: the third is like the second, which is left out itself
        ("Dokumenterte krav: aaa bbb ccc; bbb ccc ddd; ccc ddd eee", "", ["Dokumenterte krav: aaa bbb ccc."]),
        ("Dokumenterte krav: **; ;..", "", []),
        (None, "", []),
        ("", None, []),
        ("Dokumenterte volumer: 3 hus", None, ["Dokumenterte volumer: 3 hus."]),
    ]
    for fact, said, want in cases:
        assert added(spark, fact, said) == want, fact


def test_fields_of_the_own_analysis_and_category(spark):
    facts = spark.createDataFrame([(1, 0, "scale", "Dokumenterte volumer: 3 hus"), (1, 1, "limit", "Dokumenterte krav: RTO 4 timer"), (2, 0, "scale", "Dokumenterte volumer: 5 hus")], FACTS)
    fields = spark.createDataFrame([(1, "profile", "scale", "3 hus"), (1, "solution", "limit", ""), (1, "requirements", "limit", "RTO: 4 timer"), (2, "profile", "scale", "3 hus"), (3, "profile", "scale", "")], FIELDS)
    found = missing_facts(facts, fields, ["id"])
    assert sorted((r.id, r.field, r.fact, r.added) for r in found.collect()) == [(1, "solution", 1, "Dokumenterte krav: RTO 4 timer."), (2, "profile", 0, "Dokumenterte volumer: 5 hus.")]
    assert missing_facts(facts.limit(0), fields, ["id"]).count() == 0 and missing_facts(facts, fields.limit(0), ["id"]).count() == 0


def test_values_are_judged_once(spark):
    """Before: the filter on what is left was pushed into the join and judged every value once more."""
    found = missing_facts(spark.createDataFrame([(1, 0, "scale", "Dokumenterte volumer: 3 hus; 4 hus")], FACTS), spark.createDataFrame([(1, "profile", "scale", "4 hus")], FIELDS), ["id"])
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert sum("array_intersect" in line for line in plan.splitlines()) == 1
    assert [r.added for r in found.collect()] == ["Dokumenterte volumer: 3 hus."]
