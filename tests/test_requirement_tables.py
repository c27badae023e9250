"""Requirement tables in flowing text and by place: whole inventories, and what makes a table be refused."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lodestone.functions import requirements as R
from lodestone.functions.language import page_text
from lodestone.operators import explicit_tables as E
from lodestone.operators.pages import page_list
from lodestone.plans.registry import fixture

# A table of 18 rows as its customer wrote it: identifier, category, requirement, instruction.
ROWS = [
    ("FUN-A01", "Saksbehandling", "Tjenesten skal støtte mottak, fordeling, behandling, vedtak og avslutning av byggesaker i én sammenhengende arbeidsflate.", "Bekreft oppfyllelse og beskriv arbeidsflyten."),
    ("FUN-A02", "Innbyggerdialog", "Eksterne brukere skal autentiseres med ID-porten og bare få innsyn i egne saker.", "Bekreft autentiserings- og tilgangsmekanismen."),
    ("FUN-B01", "Innbyggerdialog", "Leverandøren skal gi søker og ansvarlig foretak forståelig status og neste forventede aktivitet.", "Beskriv brukerreisen og varslingskanalene."),
    ("FUN-B02", "Datakvalitet", "Tjenesten skal kontrollere obligatoriske opplysninger før innsending og gi kontekstavhengig veiledning.", "Beskriv validering og veiledning."),
    ("DOK-A03", "Dokument og journal", "Alle saksdokumenter skal kunne journalføres med fullstendige metadata uten manuell dobbeltregistrering.", "Bekreft oppfyllelse og beskriv sporbarheten."),
    ("IAM-A04", "Identitet og roller", "Ansatte skal autentiseres med kommunens Microsoft Entra ID og tilgang skal følge minste privilegium.", "Bekreft oppfyllelse og angi kontrollnivåene."),
    ("INT-A05", "Nasjonale fellesløsninger", "Tjenesten skal kunne integreres med ID-porten, Matrikkelen, Folkeregisteret og kommunens meldingskanal.", "Skill standardkoblinger fra tilpasning."),
    ("INT-B03", "Integrasjoner", "Leverandøren skal beskrive åpne og dokumenterte grensesnitt uten leverandørspesifikk låsing.", "Beskriv API-er, hendelser og versjonering."),
    ("MIG-A06", "Datamigrering", "Leverandøren skal migrere saker, dokumentfiler og metadata uten at journalførte dokumenter går tapt.", "Beskriv hvordan fullstendighet dokumenteres."),
    ("MIG-B04", "Overgang", "Leverandøren skal følge en trinnvis migreringsmetode som begrenser driftsavbrudd.", "Beskriv faser, testutvalg og tilbakefallsplan."),
    ("SIK-A07", "Datalokasjon", "Kundedata, sikkerhetskopier og driftslogger skal behandles innenfor EØS.", "Oppgi behandlingsregioner og underleverandørstyring."),
    ("SIK-A08", "Informasjonssikkerhet", "Tjenesten skal kryptere data under overføring og lagring og logge administrative handlinger.", "Beskriv kontroller, logger og sårbarhetshåndtering."),
    ("SIK-B05", "Styringsinformasjon", "Kunden skal kunne følge saksbehandlingstid, restanser, integrasjonsfeil og tilgangsavvik.", "Beskriv rapporter, filtrering og eksport."),
    ("UU-A09", "Universell utforming", "Innbyggerrettede flater skal oppfylle WCAG 2.2 nivå AA og dokumenteres med testresultater.", "Beskriv test- og rettingsprosessen."),
    ("DRI-A10", "Tilgjengelighet", "Tjenesten skal ha månedlig tilgjengelighet på minst 99,9 prosent og dokumenterte gjenopprettingstider.", "Oppgi tilbudt nivå og målepunkt."),
    ("DRI-B06", "Driftsinnsikt", "Leverandøren skal beskrive proaktiv overvåking, hendelseshåndtering og varsling.", "Beskriv responstider og forbedringssløyfen."),
    ("OPL-B07", "Opplæring og innføring", "Leverandøren skal beskrive et rollebasert opplæringsopplegg for kommunens ansatte.", "Beskriv format, omfang og støtte etter produksjonssetting."),
    ("DATA-A11", "Data og avslutning", "Kunden skal kunne hente ut saksdata, dokumenter, metadata og revisjonslogger i maskinlesbare formater.", "Beskriv formater, frister og verifikasjon."),
]
BEHIND = "7. Gjennomføring og milepæler\n\nLeverandørens fremdriftsplan skal vise avhengigheter.\n\n8. Tildelingskriterier\n\nVurderingen bygger særlig på FUN-B01, FUN-B02 og DRI-B06."


def text_of(rows=ROWS, sep: str = " | ", label: str = "Svarinstruks: ") -> str:
    table = "\n\n".join(f"{i}{sep}{i.split('-')[1][0]}{sep}{c}\n\n{t}\n\n{label}{a}" for i, c, t, a in rows)
    return f"BILAG 1 - KUNDENS BEHOVS- OG KRAVSPESIFIKASJON\n\n6. Kravtabell\n\n{table}\n\n{BEHIND}\n"


def read(spark, text: str):
    return spark.createDataFrame([(text,)], "t string").select(E.text_table(F.col("t"), page_list(F.col("t")))).first()[0]


@pytest.mark.parametrize("sep,label", [(" | ", "Svarinstruks: "), ("", "")], ids=["bars", "flattened"])
def test_whole_table(spark, sep, label):
    found = read(spark, text_of(sep=sep, label=label))
    assert [(r.id, r.service, r.text) for r in found] == [(i, c, t) for i, c, t, _ in ROWS]
    assert [r.priority for r in found] == [i.split("-")[1][0] for i, *_ in ROWS]
    assert {r.heading for r in found} == {"6. Kravtabell"}
    assert found[0].source == f"FUN-A01{sep}A{sep}Saksbehandling {ROWS[0][2]} {label}{ROWS[0][3]}"


def test_one_altered_row_refuses_all(spark):
    assert read(spark, text_of().replace("SIK-A07 | A", "FUN-A01 | A")) == []  # twice the same
    short = [(i, c, "Kort." if i == "UU-A09" else t, a) for i, c, t, a in ROWS]
    assert read(spark, text_of(short)) == []  # a row without a requirement
    assert read(spark, text_of(ROWS[:2])) == []  # too few
    clash = read(spark, text_of().replace("SIK-A07 | A", "SIK-A07 | B"))
    assert [r.id for r in clash] == [i for i, *_ in ROWS if i != "SIK-A07"]  # is no row
    assert read(spark, "") == [] and read(spark, None) in (None, [])


def test_wrapped_rows_pages_and_detached_categories(spark):
    text = "[[SIDE:1]]\n6. Kravtabell\nFUN-A01A\nSaksflyt og roller\nTjenesten skal støtte\nSide 1 av 2\n[[SIDE:2]]\nmottak av saker.\nBekreft dette.\nFUN-K02 | B | Drift\nDet skal finnes vakt.\n\nFUN-K03 C\nLeverandøren skal levere.\nTjenesten skal måles.\n7. Annet\nTjenesten skal ikke telle."
    found = read(spark, text)
    assert [(r.id, r.service, r.text, r.pages) for r in found] == [
        ("FUN-A01", "Saksflyt og roller", "Tjenesten skal støtte mottak av saker.", [1, 2]),
        ("FUN-K02", "Drift", "Det skal finnes vakt.", [2]),
        ("FUN-K03", "", "Leverandøren skal levere. Tjenesten skal måles.", [2]),
    ]


def items_of(*pages: list) -> list[tuple]:
    """pages: lists of lines, each a list of (x, text)."""
    return [(1, p, n, k, float(x), t) for p, lines in enumerate(pages, 3) for n, line in enumerate(lines) for k, (x, t) in enumerate(line)]


def layout(spark, rows: list[tuple]):
    return E.layout_table(spark.createDataFrame(rows, "doc long, page int, line int, item int, x double, text string"), "doc").orderBy("entry").collect()


HEADER = [(63, "Krav-ID"), (120, "Type"), (154, "Kundens krav"), (372, "Status og leverandørens besvarelse")]
THEMED = [(62, "Krav-ID"), (139, "Pri."), (173, "Tema"), (275, "Krav som Leverandøren skal besvare")]


def test_answer_column_stays_apart(spark):
    found = layout(spark, items_of([
        [(57, "6. Kravtabell")], HEADER,
        [(63, "FUN-A01"), (120, "A"), (154, "Saksbehandling"), (372, "Bekreft oppfyllelse og beskriv arbeidsflyten.")],
        [(154, "Tjenesten skal støtte mottak og behandling av saker"), (372, "Oppgi også eventuelle avgrensninger.")],
        [(154, "i én sammenhengende arbeidsflate.")], [(523, "Side 3")],
        [(63, "FUN-B01"), (120, "B"), (154, "Innbyggerdialog"), (372, "Beskriv brukerreisen.")], [(154, "Leverandøren skal beskrive status og varsling.")],
        [(63, "DRI-B06"), (120, "B"), (154, "Driftsinnsikt"), (372, "Beskriv målepunktene.")], [(154, "Leverandøren skal beskrive proaktiv overvåking.")],
        [(57, "7. Gjennomføring")], [(57, "Vurderingen viser til DRI-B06, men dette er ikke en ny rad.")],
    ]))
    assert [r.id for r in found] == ["FUN-A01", "FUN-B01", "DRI-B06"]
    assert found[0].service == "Saksbehandling" and found[0].heading == "6. Kravtabell" and found[0].pages == [3]
    assert found[0].text == "Tjenesten skal støtte mottak og behandling av saker i én sammenhengende arbeidsflate."
    assert found[0].answer == "Bekreft oppfyllelse og beskriv arbeidsflyten. Oppgi også eventuelle avgrensninger."
    assert "Leverandørens svar: Bekreft" in found[0].source


def test_theme_column_and_headers_on_every_page(spark):
    rows = items_of(
        [[(57, "Kontraktsmønster SSA-L 2026")], [(57, "6. Kravtabell")], THEMED, [(62, "NORD-FUN-01"), (139, "A"), (173, "Saksflyt"), (275, "Tjenesten skal støtte komplett saksbehandling")], [(275, "i én sammenhengende arbeidsflate.")], [(62, "NORD-API-11"), (139, "B"), (173, "API"), (275, "Leverandøren bør beskrive dokumenterte API-er.")]],
        [THEMED, [(62, "NORD-OPL-12"), (139, "B"), (173, "Opplæring"), (275, "Leverandøren bør beskrive rollebasert opplæring.")], [(57, "FHIR R4 er omtalt i bakgrunnsteksten.")], [(57, "7. Tildelingskriterier")]],
    )
    found = layout(spark, rows)
    assert [(r.id, r.service, r.pages) for r in found] == [("NORD-FUN-01", "Saksflyt", [3]), ("NORD-API-11", "API", [3]), ("NORD-OPL-12", "Opplæring", [4])]
    assert found[0].text == "Tjenesten skal støtte komplett saksbehandling i én sammenhengende arbeidsflate."
    assert all(r.answer is None for r in found)


def test_shifted_wrapped_and_missing_columns(spark):
    def rows(header, *ids, shift=0):
        body = [[(62 + shift, i), (139 + shift, "A"), (173, "Tema"), (275 - shift, "Tjenesten skal støtte del")] for i in ids]
        return [[(57, "6. Kravtabell")], header, *body]

    assert [r.id for r in layout(spark, items_of(rows(THEMED, "A-K1", "AB-K1", "AB-K2", "AB-K3", shift=8)))] == ["AB-K1", "AB-K2", "AB-K3"]  # one letter is no identifier
    assert layout(spark, items_of(rows(THEMED, "AB-K1", "AB-K2", "AB-K2"))) == []
    assert layout(spark, items_of(rows(THEMED, "AB-K1", "AB-K2"))) == []
    assert layout(spark, items_of(rows([THEMED[0], THEMED[1], THEMED[3]], "AB-K1", "AB-K2", "AB-K3"))) == []  # neither theme nor answer
    assert layout(spark, items_of(rows([THEMED[1], (150, "Krav-ID"), *THEMED[2:]], "AB-K1", "AB-K2", "AB-K3"))) == []  # not from left to right
    over = items_of(rows(THEMED, "AB-K1", "AB-K2"), [[(275, "i én flate.")], [(62, "AB-K3"), (139, "B"), (173, "Drift"), (275, "Det skal finnes vakt.")]])
    found = layout(spark, [*over, (None, 1, 1, 1, 1.0, "x"), (1, 3, 9, 9, None, "x"), (1, 3, 9, 8, 300.0, None)])
    assert [(r.id, r.pages) for r in found] == [("AB-K1", [3]), ("AB-K2", [3, 4]), ("AB-K3", [4])]
    closed = items_of([*rows(THEMED, "AB-K1", "AB-K2", "AB-K3"), [(62, "AB-B4"), (139, "A")], [(62, "AB-K5"), (139, "A"), (173, "T"), (275, "Tjenesten skal støtte del")]], [[(62, "AB-K6"), (139, "A"), (173, "T"), (275, "Tjenesten skal støtte del")]])
    assert [r.id for r in layout(spark, closed)] == ["AB-K1", "AB-K2", "AB-K3", "AB-K6"]  # the clash closes the page's table


def test_signals_and_headings(spark):
    def of(f, *texts):
        return [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(f(F.col("t"))).collect()]

    assert of(R.has_signal, "Systemet skal fungere godt", "skal", "Dette er skaliert for mange", "Det må være mulig å bruke", "Alt er målet for oss alle nå") == [True, False, False, True, False]
    assert of(R.is_standalone, "Kunden kan", "det skal", "kravene bes", "Kunden kanskje") == [True, True, True, False]
    assert of(R.without_chrome, "• Tekst", "[KR-12A] Tekst", "K 12: Tekst", "FRF.1.2 - Tekst", "x) Tekst", "uten nr. : Tekst", "Krav nr. 4) Tekst", "Tekst 4: x") == ["Tekst"] * 7 + ["Tekst 4: x"]
    assert of(R.without_answer, "Kravet. Leverandørens besvarelse ja", "se svar i Leverandørens besvarelse ja", "uten") == ["Kravet.", "se svar i Leverandørens besvarelse ja", "uten"]
    assert of(R.is_numbered_heading, "7. Gjennomføring", "7) Gjennomføring", "7.1 Tjenesten skal", "7. Slutt!", "7. en to tre fire fem seks sju åtte ni", "Gjennomføring") == [True, False, False, False, False, False]
    assert of(R.clean_heading, "• Drift ID 2-04:", "Leverandørens besvarelse ID 2-04 – Drift og vakt") == ["Drift", "Drift og vakt"]


def test_lines_without_chrome_are_only_tidied(spark):
    """One look tells whether a line can have chrome; what it passes over is as the whole treatment leaves it."""
    lines = ["  Det  skal\tleveres ", "RA - 12 B I L A G", "ra-ma", " Side 3 av 9", "se side 3 av 9 her", "KONFIDENSIELL", "a–b", "x\ny", "12 TIL SSA-D 2024", "VEDLEGG AB / 1", "Bra", "", "Side"]
    found = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "i int, t string").orderBy("i").select(page_text(F.col("t"))).collect()]
    assert found == ["Det skal leveres", "", "ra-ma", "", "se her", "", "a-b", "x y", "", "", "Bra", "", "Side"]


def test_lines_are_numbered_once(spark, sf):
    """The ten branches of the glyphs share one numbering of lines (before: each sorted the lines anew)."""
    plan = fixture(spark, sf, "glyph_rows")._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan
