"""One ledger for several sources: worked cases, and every pair of rows against plain Python."""

from __future__ import annotations

import random
import re
import unicodedata

import pytest

from lodestone.operators import ledger_sources as L

SCHEMA = "project int, doc string, entry int, side string, id string, service string, heading string, text string"
HELPDESK = "Leveransekrav til stedlig og fjernbasert Helpdesk og TAM"
ONSITE = "Det skal tilbys stedlige ressurser for sentrale deler av leveransen. On-site Helpdesk skal være kontaktpunkt (SPOC) for alle brukere, og TAM skal følge opp avtalte aktiviteter og dokumentere kontrollene som er utført."
PREFIX = "Stedlig Helpdesk og fjernbasert TAM skal koordinere leveransen, dokumentere kontrollene og følge opp avtalte aktiviteter. " * 9
LOGGED = "Alle hendelser skal registreres med tidspunkt, aktør, korrelasjonsidentifikator, førverdi og etterverdi, og dokumentasjonen skal være tilgjengelig for revisjon. " * 2
ACCESS = "Løsningene skal kunne nås på en sikker {}måte fra {} kontor, fra hjemmekontor og ved ekstern oppkobling"


def kept(spark, rows: list[tuple]) -> list[tuple]:
    return [(r.project, r.doc, r.entry, r.entry_order) for r in L.canonical_ledger(spark.createDataFrame(rows, SCHEMA), ["project"]).orderBy("project", "doc", "entry").collect()]


def test_worked_cases(spark):
    cases = [  # customer's id, service, heading, text; formal's; whether the customer's row goes
        (("Drift - Tilgang og tilgjengelighet", None, "Krav", ACCESS.format("", "kundens")), ("Tabell ID 2-11 - Tilgang og tilgjengelighet", None, "Krav", ACCESS.format("tilgjengelighet ", "kunden s")), True),
        (("Drift - Brukeradministrasjon", None, "Krav", "Detbenyttes en arbeidsflyt i SharePointsom godkjenning."), ("Tabell ID 2-11 - Bruker-administrasjon", None, "Krav", "Det benyttes en arbeidsflyt i SharePoint som godkjenning."), True),
        (("Kravområde - Tilgangsstyring", "Tilgangsstyring", "Krav", "Løsningen skal støtte BankID for eksterne brukere."), ("Tabell 1 - Tilgangsstyring", "Tilgangsstyring", "Krav", "Løsningen skal støtte BankID for interne brukere."), False),
        (("Brukeradministrasjon - Logging", "Brukeradministrasjon", "A", "Alle endringer skal logges."), ("Konfigurasjonsstyring - Logging", "Konfigurasjonsstyring", "B", "Alle endringer skal logges."), False),
        (("Driftsaktiviteter - " + HELPDESK, HELPDESK, "Driftsaktiviteter > Forvaltning", ONSITE), ("ID 2-14", None, "Krav > " + HELPDESK, ONSITE), True),
        (("Driftsaktiviteter - " + HELPDESK, HELPDESK, "Krav", PREFIX), ("ID 2-14", None, "Krav", PREFIX + "Ressursene skal i tillegg dokumentere Planner, OneNote og oppgaver på tenant-nivå."), True),
        (("Dokumenttekst krav 1", None, "Brukeradministrasjon", LOGGED), ("Dokumenttekst krav 2", None, "Konfigurasjonsstyring", LOGGED), False),
        (("K-1", None, "Krav", "Leverandøren skal dokumentere kapasitet."), ("K-1", None, "Krav", "Leverandøren skal doku-\nmentere kapasitet."), True),
        (("K-1", None, "Krav", "Oppetidskal være 99 %"), ("K-1", None, "Krav", "Oppetid skal være 99"), False),
        (("K-1", None, "Krav", "Leverandøren skal dokumentere kapasitet."), ("K-2", None, "Krav", "Leverandøren skal dokumentere kapasitet."), False),
    ]
    rows = [(p, side, 0, side, *row) for p, (customer, formal, _) in enumerate(cases) for side, row in (("customer", customer), ("formal", formal))]
    rows += [(99, "other", n, "solution", "K-1", None, None, "Uendret") for n in (7, 3)]
    want = [(p, side, 0, 0) for p, (_, _, goes) in enumerate(cases) for side in ("customer", "formal") if side == "formal" or not goes]
    assert kept(spark, rows) == [*want, (99, "other", 3, 0), (99, "other", 7, 1)]


def test_blank_rows_stop_it_and_empty_tables_do_not(spark):
    with pytest.raises(ValueError, match="without text.*formal:K-9"):
        kept(spark, [(1, "formal", 0, "formal", "K-9", None, None, "\n\t"), (1, "formal", 1, "formal", "K-10", None, None, "krav")])
    assert kept(spark, []) == []


def canonical(x: str | None) -> str:
    x = unicodedata.normalize("NFKC", x or "").replace("­", "").lower()
    return " ".join("".join(c if unicodedata.category(c)[0] in "LN" else " " for c in x).split())


def compact(x: str | None) -> str:
    return canonical(x).replace(" ", "")


def plain(a: tuple, b: tuple) -> bool:
    """The rule for two rows, word for word."""
    (ia, sa, ha, ta), (ib, sb, hb, tb) = a, b
    ca, cb = canonical(ta), canonical(tb)
    xa, xb = compact(ta), compact(tb)

    def identities(i, s):
        parts = [p for p in re.split(r"\s+-\s+", i or "") if p]
        last = parts[-1] if parts else ""
        out = {}
        for v in (s, last):
            if len(k := compact(v)) >= 6 and not re.fullmatch(L.MADE_UP, k) and k not in L.EMPTY_LABELS:
                out["l" + k] = canonical(v)
        for v in (i, last):
            if re.search("[0-9]", k := compact(v)) and not re.fullmatch(L.MADE_UP, k):
                out["n" + k] = ""
        return out

    da, db = identities(ia, sa), identities(ib, sb)
    common = [k for k in da if k in db]
    tokens = {w for k in common for w in da[k].split() if len(w) >= 4}
    apart = compact(sa) != compact(sb) if compact(sa) and compact(sb) else bool(compact(ha) and compact(hb) and compact(ha) != compact(hb))

    def grounded(s, c):
        telling = {w for w in canonical(s).split() if len(w) >= 5 and w not in L.GENERIC}
        return sum(any(w == t or (len(w) > 6 and len(t) > 6 and w[:7] == t[:7]) for t in c.split()) for w in telling) >= 2

    if compact(sa) and compact(sb):
        scoped = compact(sa) == compact(sb)
    elif not compact(sa) and not compact(sb):
        scoped = not (compact(ha) and compact(hb) and compact(ha) != compact(hb))
    else:
        scoped = grounded(sa, ca) if compact(sa) else grounded(sb, cb)
    if not ca or not cb:
        return False
    if ca == cb:
        return scoped if len(ca) >= 160 else bool(common) and not apart
    short, long = sorted((xa, xb), key=len)
    if len(short) >= 800 and len(short) / len(long) >= 0.8 and long.startswith(short) and scoped:
        return True

    def marks(t, c):
        kinds = {n for w in c.split() for n, p in L.CONTRASTS.items() if re.fullmatch(p, w)}
        signs = "".join(sorted(re.findall("[%‰°]", t)))
        return kinds, {w for w in c.split() if w in L.RESTRICTIONS}, {w for w in c.split() if w.isdigit() or w in L.UNITS} | ({signs} if signs else set())

    entities = lambda t: {compact(m) for m in re.findall(r"\b(?:[A-ZÆØÅ]{2,}\w*|[A-ZÆØÅ][a-zæøå]+[A-ZÆØÅ]\w*)\b", t)}
    if not common or apart or marks(ta, ca) != marks(tb, cb) or any(e not in xb for e in entities(ta)) or any(e not in xa for e in entities(tb)):
        return False
    strip = lambda c: "".join(w for w in c.split() if w not in tokens)
    return xa == xb or bool(tokens and strip(ca) == strip(cb))


def test_every_pair_as_in_plain_python(spark):
    rng = random.Random(5)
    labels = ["Tilgang og logging", "Tilgang oglogging", "Bruker-administrasjon", "Brukeradministrasjon", "Krav", "K-7", "ID 2-4", "Side 1 krav 2", ""]
    texts = ["Alle endringer skal logges", "Alle endringer, skal logges.", "Alle end ringer skal logges", "Alle tilgang endringer skal logges", "Alle brukeradministrasjon endringer skal logges", "Alle endringer skal ikke logges", "Bruk MFA for interne", "Bruk M F A for interne", "Bruk 3 dager logging", ONSITE, ONSITE.replace(" av", " a v"), PREFIX, PREFIX + "Mer tekst her.", "***"]
    pick = lambda: (rng.choice(["Drift - ", "", "Tabell 2 - "]) + rng.choice(labels), rng.choice([None, None, *labels, HELPDESK]), rng.choice([None, "A", "B"]), rng.choice(texts))
    ours, theirs = [pick() for _ in range(250)], [pick() for _ in range(120)]
    rows = [(p, side, n, side, *row) for p in (1, 2) for side, part in (("customer", ours[p::2]), ("formal", theirs[p::3])) for n, row in enumerate(part)]
    want = []
    for p in (1, 2):
        stays = [n for n, a in enumerate(ours[p::2]) if not any(plain(a, b) for b in theirs[p::3])]
        want += [(p, "customer", n, k) for k, n in enumerate(stays)] + [(p, "formal", n, n) for n in range(len(theirs[p::3]))]
        assert 0 < len(stays) < len(ours[p::2])
    assert kept(spark, rows) == want


@pytest.mark.parametrize("many", [0, 1000])
def test_descriptions_are_made_and_compared_once_for_all_scopes(spark, monkeypatch, many):
    tables, write = {}, L.materialize

    def noted(df, tag):
        out = write(df, tag)
        tables.setdefault(tag, []).append((out.columns, out.count()))
        return out

    monkeypatch.setattr(L, "materialize", noted)
    monkeypatch.setattr(L, "MANY", many, raising=False)
    text = lambda n: f"Leverandøren skal dokumentere punkt {n}"
    rows = [(p, side, n, side, f"Drift - K-{n}", None, None, text(n)) for p in range(30) for side, step in (("customer", 1), ("formal", 2)) for n in range(0, 12, step) if side == "customer" or p < 20]
    want = [(p, side, n, k) for p in range(30) for side in ("customer", "formal") for k, n in enumerate(range(0, 12, 2) if side == "formal" else [n for n in range(12) if n % 2 or p >= 20]) if side == "customer" or p < 20]
    assert kept(spark, rows) == want
    assert [n for _, n in tables["described"]] == [12]
    assert [n for _, n in tables["pairs"]] == [6]
    assert all("text" not in columns for columns, n in sum(tables.values(), []) if n > 100)
