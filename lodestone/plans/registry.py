"""Registration of queries with their DuckDB counterparts, and the fixture tables they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestone.sources.scratch import materialize
from lodestone.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: Reference concepts as views over the driver's tables; the SQL is common to Spark and DuckDB.
FIXTURES = {
    "projects": "select s_suppkey as project_id, s_name as name, s_nationkey as group_id, s_suppkey * 3 as owner_id, s_acctbal as budget from {supplier}",
    "principals": "select c_custkey as principal_id, c_name as name, c_nationkey as group_id, c_acctbal < 0 as disabled, c_mktsegment as segment from {customer}",
    "memberships": """
        select o_custkey as principal_id, o_orderkey % 97 + 1 as project_id,
               case o_orderstatus when 'O' then 'editor' when 'F' then 'viewer' else 'restricted_viewer' end as role,
               case when o_orderpriority like '1%' then cast(o_orderdate as timestamp) + interval '400' day end as expires_at,
               case when o_orderpriority like '5%' then cast(o_orderdate as timestamp) + interval '30' day end as revoked_at
        from {orders}""",
    "group_grants": """
        select s_suppkey as project_id, n_nationkey as group_id,
               case when s_suppkey % 5 = 0 then 'editor' else 'viewer' end as role,
               cast(null as timestamp) as expires_at, cast(null as timestamp) as revoked_at
        from {supplier} join {nation} on s_nationkey = n_nationkey""",
    "group_members": "select c_custkey as principal_id, c_nationkey as group_id from {customer}",
    "artifacts": """
        select o_orderkey as id, o_custkey as project_id, o_orderpriority as artifact_type, o_orderdate as created_at, o_totalprice as score,
               row_number() over (partition by o_custkey, o_orderpriority order by o_orderdate, o_orderkey) as version,
               o_orderkey % 3 as source_revision, o_orderkey % 2 as library_revision
        from {orders}""",
    "revisions": "select c_custkey as project_id, c_custkey % 3 as source_revision, c_custkey % 2 as library_revision from {customer}",
    "candidates": """
        select doc_id as id, case when doc_id % 2 = 0 then 'project' else 'service' end as source_type, source as source_id, source as title, lang as reference,
               concat('part ', doc_id % 7) as heading, text,
               case doc_id % 6 when 0 then 'requirement' when 1 then 'table' when 2 then 'risk' when 3 then 'section' when 4 then 'answer_cell' end as kind,
               case doc_id % 3 when 0 then 'hybrid' when 1 then 'vector' else 'memory' end as retrieval,
               case when doc_id % 3 < 2 then n_chars % 97 / cast(100 as double) end as similarity,
               case when doc_id % 3 = 0 then 1 / cast(50 + doc_id % 200 as double) end as rrf,
               case when doc_id % 3 = 0 then doc_id % 40 end as keyword_rank
        from {documents}""",
    "paged": """
        select doc_id, concat('Bilag ', doc_id) as title, concat('intro', chr(10), '[[SIDE:1]]', chr(10), substr(text, 1, 300), chr(10), 'Side 1 av 9', chr(10), case when doc_id % 3 = 0 then '[[SIDE:2-4]]' else '[[SIDE:2]]' end, chr(10),
               substr(text, 301, 300), ' se side 12', chr(10), 'Konfidensiell', chr(10), '[[SIDE:5-3]]', chr(10), '[[SIDE:6]]', substr(text, 601, 200)) as raw
        from {documents}""",
    "scanned": """
        select doc_id, concat(case doc_id % 7 when 0 then 'Kunden skal levere.Leveransenskal ID 1 - 2, ID 3-4; ID 5.6 og ID 7-8 ' when 1 then 'L everansen ,Ã¦rlig "x ' when 2 then 'I D 12 - 4A (se [2) :x ' when 3 then 'ny' when 4 then 'A–B — C‑D  ' else '' end,
               substr(text, 1, 300), case when doc_id % 5 = 0 then ' «slutt' else '' end) as text, contains(text, ' | ') as has_tables
        from {documents}""",
    "numbered_lines": """
        select o_custkey as doc_id, o_orderkey as line_no, case o_orderstatus when 'P' then 'Punktkrav' else 'Tekstkrav' end as kind, concat('K', o_custkey % 3, '-') as prefix,
               case when o_orderkey % 4 = 0 then cast(o_orderkey % 9 + 1 as bigint) end as number,
               case when o_orderkey % 3 = 0 then cast(row_number() over (partition by o_custkey order by o_orderkey) + case when o_orderkey % 6 = 0 then 1 else 0 end as bigint) end as place
        from {orders}""",
    "table_texts": """
        select doc_id, concat('Innledning', chr(10), '[[SIDE:1]]', chr(10), '6. Kravtabell', chr(10), 'Konfidensiell', chr(10), 'FUN-A01 | A | Saksflyt', chr(10), chr(10), 'Leverandøren skal levere ', bit, '.', chr(10), 'Svarinstruks: Bekreft oppfyllelse.', chr(10),
               'Side 1 av 2', chr(10), '[[SIDE:2]]', chr(10), 'FUN - B02BInnbyggerdialog', case when doc_id % 4 = 0 then ' Beskriv flaten' else '' end, chr(10), case when doc_id % 3 = 0 then '[K-12] ' else '' end, 'Løsningen må støtte ', bit, chr(10), 'Beskriv brukerreisen.', chr(10),
               case doc_id % 8 when 0 then 'FUN-A01 | A | Ny' when 1 then 'IAM-A03 | B | Roller' when 2 then concat('IAM-C03C', chr(10), 'Identitet og roller') when 3 then concat('IAM-C03C', chr(10), 'Dette er ikke en kategori.') else 'IAM-C03 | C | Roller' end, chr(10),
               case when doc_id % 7 = 0 then 'Kort tekst' else concat('Ansatte skal autentiseres', chr(10), 'med ', bit, ' Leverandørens besvarelse følger') end, chr(10), 'Oppgi nivå', chr(10), 'TEK-X9 | A | Drift', chr(10), 'Det skal finnes rapporter', chr(10), '7. Bakgrunn', chr(10), text) as raw
        from (select doc_id, text, trim(replace(substr(text, 1, 60), chr(10), ' ')) as bit from {documents})""",
    "glyph_rows": """
        select o_orderkey as doc_id, page, line, item, cast(x as double) as x, text from (
          select o_orderkey, 1 as page, 1 as line, 1 as item, 57 as x, '6. Kravtabell' as text from {orders} where o_orderkey % 5 < 4
          union all select o_orderkey, k, 2, 1, 60 + o_orderkey % 7, 'Krav-ID' from {orders} cross join (select 1 as k union all select 2) where o_orderkey % 11 < 9 or k = 1
          union all select o_orderkey, k, 2, 2, 120, 'Pri.' from {orders} cross join (select 1 as k union all select 2) where o_orderkey % 11 < 9 or k = 1
          union all select o_orderkey, k, 2, 3, 160 + o_orderkey % 9, 'Tema' from {orders} cross join (select 1 as k union all select 2) where o_orderkey % 3 > 0 and (o_orderkey % 11 < 9 or k = 1)
          union all select o_orderkey, k, 2, 4, 260, 'Kravtekst' from {orders} cross join (select 1 as k union all select 2) where o_orderkey % 11 < 9 or k = 1
          union all select o_orderkey, k, 2, 5, 420, case when o_orderkey % 2 = 0 then 'Svarinstruks' else 'Leverandørens svar' end from {orders} cross join (select 1 as k union all select 2) where o_orderkey % 4 > 0 and (o_orderkey % 11 < 9 or k = 1)
          union all select l_orderkey, pg, ln, 1, 62, concat('FUN-', case when l_linenumber % 2 = 0 then 'A' else 'K' end, lpad(cast(l_partkey % 90 + l_linenumber as varchar(9)), 2, '0')) from (select *, l_linenumber % 2 + 1 as pg, l_linenumber * 10 as ln from (select l_orderkey, l_partkey, l_suppkey, l_linestatus as l_status, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount) as l_linenumber from {lineitem}))
          union all select l_orderkey, pg, ln, 2, 121, case when l_suppkey % 29 = 0 then 'B' else 'A' end from (select *, l_linenumber % 2 + 1 as pg, l_linenumber * 10 as ln from (select l_orderkey, l_partkey, l_suppkey, l_linestatus as l_status, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount) as l_linenumber from {lineitem}))
          union all select l_orderkey, pg, ln, 3, 160 + l_orderkey % 9 - 3, concat('Tema ', l_status) from (select *, l_linenumber % 2 + 1 as pg, l_linenumber * 10 as ln from (select l_orderkey, l_partkey, l_suppkey, l_linestatus as l_status, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount) as l_linenumber from {lineitem})) where l_orderkey % 3 > 0
          union all select l_orderkey, pg, ln, 4, 262, concat('Løsningen skal levere del ', l_partkey) from (select *, l_linenumber % 2 + 1 as pg, l_linenumber * 10 as ln from (select l_orderkey, l_partkey, l_suppkey, l_linestatus as l_status, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount) as l_linenumber from {lineitem}))
          union all select l_orderkey, pg, ln, 5, 415, concat('Bekreft ', l_suppkey) from (select *, l_linenumber % 2 + 1 as pg, l_linenumber * 10 as ln from (select l_orderkey, l_partkey, l_suppkey, l_linestatus as l_status, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount) as l_linenumber from {lineitem})) where l_orderkey % 4 > 0
          union all select l_orderkey, pg, ln + 1, 1, 170, 'fortsettelse' from (select *, l_linenumber % 2 + 1 as pg, l_linenumber * 10 as ln from (select l_orderkey, l_partkey, l_suppkey, l_linestatus as l_status, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount) as l_linenumber from {lineitem})) where l_partkey % 3 = 0
          union all select l_orderkey, pg, ln + 1, 2, 258, concat('og vise status for ', l_suppkey) from (select *, l_linenumber % 2 + 1 as pg, l_linenumber * 10 as ln from (select l_orderkey, l_partkey, l_suppkey, l_linestatus as l_status, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount) as l_linenumber from {lineitem})) where l_partkey % 4 > 0
          union all select l_orderkey, pg, ln + 1, 3, 430, 'Side 3' from (select *, l_linenumber % 2 + 1 as pg, l_linenumber * 10 as ln from (select l_orderkey, l_partkey, l_suppkey, l_linestatus as l_status, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount) as l_linenumber from {lineitem})) where l_partkey % 5 = 0
          union all select l_orderkey, pg, ln + 2, 1, 57, '7. Gjennomføring' from (select *, l_linenumber % 2 + 1 as pg, l_linenumber * 10 as ln from (select l_orderkey, l_partkey, l_suppkey, l_linestatus as l_status, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount) as l_linenumber from {lineitem})) where l_partkey % 23 = 0
          union all select l_orderkey, pg, ln + 3, 1, 300, concat('notat ', l_linenumber) from (select *, l_linenumber % 2 + 1 as pg, l_linenumber * 10 as ln from (select l_orderkey, l_partkey, l_suppkey, l_linestatus as l_status, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount) as l_linenumber from {lineitem})) where l_partkey % 6 = 0)""",
    "broken_texts": """
        select doc_id, concat(case doc_id % 9 when 0 then 'Kundenhar avLeveransen og LeverandørenbesbeskriveX ' when 1 then 'I D 2 – 4 kr a v i Ta b ell ID 2 . 7 til ID2-09-3B ' when 2 then 'Feilh å ndt ering og Abc d ef g hi j kl m no p qr s tu ' when 3 then 'SKR I FT Endringshåndt ering arbeids stasjoner, opp gaver tilå gå go- live '
                      when 4 then 'Leverandøren skal , forKunden og for Leveransen . Kunden er med Kundens folk «Leveransen» ' when 5 then 'Tredjepart s - leverandører og drifts-og vakt og-drift ' when 6 then 'på underleverandør er og diverse leverandør er, nyeLeverandøren åiverksetterutiner ' when 7 then '3''dje partsleverandører, tredjeparts programvare skjeri dag ' else '' end,
               case doc_id % 5 when 0 then 'ISO-27001 KR-063-01 og KR - 063-01, B2-01 FUN-A01 ' when 1 then 'Tabell ID 2-11 ID 2.4 Krav nr. 7, FHIR R4 R4 ' when 2 then '088/01 24/7 FRF.1.2 P123-K4 REQ 7 ' else '' end, replace(substr(text, 1, 160), chr(10), ' ')) as text
        from {documents}""",
    "row_lines": """
        select doc_id, cast(floor((n - 1) / 20) as int) + 1 as page, n * 10 + k as line, cast(800 - (n % 20) * 36 - k * 12 - case when l_orderkey % 13 = 0 and k > 0 then 40 else 0 end as double) as y, cast(9 + l_orderkey % 3 as double) as height,
               case when k = 0 then concat('KR-', lpad(cast(l_partkey % 999 as varchar(3)), 3, '0'), '-', lpad(cast(n % 99 as varchar(2)), 2, '0'), case when doc_id % 3 = 0 then concat(' ', lpad(cast(n % 99 as varchar(2)), 2, '0')) else '' end,
                      case when doc_id % 4 < 2 or n % 5 = 0 then concat(' ', split_part('Må,Bør,Kan', ',', cast(n % 3 + 1 as int))) else '' end, case when l_suppkey % 17 = 0 then '' else concat(' Løsningen skal levere punkt ', l_suppkey) end)
                    when k = 1 then case l_suppkey % 9 when 0 then '3 Drift og vakt' when 1 then 'Avklaring: mer' when 2 then 'med full doku-' when 3 then 'Må Kunden gjøre noe' when 4 then 'VEDLEGG OG ANNET' when 5 then 'fortsettelse på linjen' end
                    else 'mentasjon og vakt' end as text
        from (select *, l_partkey % 400 as doc_id, row_number() over (partition by l_partkey % 400 order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) as n from {lineitem}) cross join (select 0 as k union all select 1 union all select 2)
        where k < 2 or l_suppkey % 9 in (2, 5)
        union all select distinct l_partkey % 400, 1, 1, cast(790 as double), cast(10 as double), 'Krav-ID Prioritet Kravtekst' from {lineitem} where l_partkey % 5 = 0""",
    "claim_documents": "select doc_id % 4 as project, doc_id as doc, concat('Dokument ', doc_id) as title, text from {documents}",
    "claim_entries": "select doc_id % 4 as project, doc_id as doc, 0 as entry, case when doc_id % 3 = 0 then '' else concat('Tabell ', doc_id % 7) end as reference, substr(text, 1, 150) as text from {documents}",
    "claims": """
        select item_id % 4 as project, item_id as claim, split_part(text, ' ', 3) as title, substr(text, 100, 60) as description, case item_id % 3 when 0 then text when 1 then substr(text, 1, 70) else concat('Ukjent ', substr(text, 20, 40), ' og mer') end as excerpt,
               case item_id % 5 when 0 then concat('Dokument ', item_id * 7) when 1 then 'Tabell 3' else '' end as reference
        from {benchmark}""",
    "chunk_first": "select case when doc_id % 3 = 0 then 'service_document' else 'project_document' end as source_type, doc_id as source_id, chunk_index, substr(text, chunk_index * 100 + 1, 100) as text from {documents} cross join (select 0 as chunk_index union all select 1) where doc_id % 11 > 0",
    "chunk_rows": """
        select case when doc_id % 3 = 0 then 'service_document' else 'project_document' end as source_type, doc_id as source_id, case when doc_id % 8 = 1 and k = 2 then 1 when doc_id % 8 = 2 then k + 1 else k end as chunk_index, concat('ny ', substr(text, k * 80 + 1, 80)) as text
        from {documents} cross join (select 0 as k union all select 1 union all select 2) where doc_id % 9 > 0""",
    "chunk_requests": """
        select case when doc_id % 3 = 0 then 'service_document' when doc_id % 31 = 1 then 'other' else 'project_document' end as source_type, doc_id as source_id, case when doc_id % 8 = 3 then 'abc' else sha2_ end as fingerprint, doc_id % 5 as revision, case when doc_id % 9 = 0 then 0 when doc_id % 8 = 4 then 2 else 3 end as chunks
        from (select doc_id, concat(lpad('', 56, 'ab'), lpad(cast(doc_id as varchar(8)), 8, '0')) as sha2_ from {documents}) where doc_id % 13 > 0""",
    "chunk_sources": "select case when doc_id % 3 = 0 then 'service_document' else 'project_document' end as source_type, doc_id as source_id, case when doc_id % 8 = 5 then 9 else doc_id % 5 end as revision from {documents} where doc_id % 17 > 0",
    "source_entries": """
        select project, doc, cast(row_number() over (partition by project, doc order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) as int) * 10 as entry, case doc when 0 then 'customer' when 3 then 'solution' else 'formal' end as side,
               concat(case when doc = 0 then 'Drift' else 'Tabell 2' end, ' - ', label) as id, case l_orderkey % 4 when 0 then label when 1 then 'Leveransekrav til Helpdesk og fjernbasert TAM' end as service,
               case l_suppkey % 3 when 0 then 'Krav' when 1 then 'Drift' end as heading,
               case l_suppkey % 8 when 0 then concat('Alle endringer i ', area, ' skal logges') when 1 then concat('Løsningen skal støtte BankID for ', case when l_orderkey % 3 = 0 then 'eksterne' else 'interne' end, ' brukere av ', area)
                    when 2 then concat('Det skal tilbys Helpdesk og fjernbasert hjelp til ', area, '. ', repeat('Ressursene følger avtalte rutiner. ', 6)) when 3 then concat(repeat('Stedlig Helpdesk og fjernbasert TAM skal koordinere leveransen. ', 18), case when doc > 0 then 'Planner og ' else '' end, case when l_orderkey % 2 = 0 then area else '' end)
                    when 4 then case when doc = 0 then concat('Detbenyttes en arbeidsflyt i SharePointsom godkjenning av ', area) else concat('Det benyttes en arbeids-', chr(10), 'flyt i SharePoint som godkjenning av ', area) end
                    when 5 then concat('Oppetid for ', area, ' skal', case when l_orderkey % 3 = 0 then ' ' else '' end, ' være ', 97 + l_orderkey % 3, case when l_linenumber = 4 then ' %' else '' end) when 6 then concat('Leverandøren skal ', case when doc = 0 then '' else concat(label, ' ') end, 'dokumentere ', area)
                    else concat('Kun ', area, case when l_orderkey % 2 = 0 then ' og MFA' else '' end, ' i ', l_orderkey % 4, ' timer', case when doc = 0 then '.' else ' !' end) end as text
        from (select *, l_partkey % 2000 as project, case when l_linenumber = 7 then 3 else l_linenumber % 3 end as doc, split_part('drift,logging,tilgang', ',', cast((l_orderkey + l_linenumber) % 3 + 1 as int)) as area,
                     split_part('Tilgang og logging,Tilgang oglogging,Bruker-administrasjon,Brukeradministrasjon,K-12', ',', cast(l_orderkey % 5 + 1 as int)) as label from {lineitem})""",
    "analysis_facts": """
        select doc_id, k as fact, case k when 0 then 'scale' when 1 then 'threshold' else 'timeline' end as category,
               case k when 0 then concat('Dokumenterte volumer: ', substr(text, 1, 40), '; ', substr(text, 41, 40), ' ukjent verdi;', substr(text, 41, 40), ' ukjent  verdi. ; ', substr(text, 900, 30))
                      when 1 then concat('Dokumenterte tekniske grenseverdier: ', substr(text, 150, 60), case when doc_id % 3 = 0 then ' | ' else '; ' end, 'RTO ', doc_id % 9, ' timer', case when doc_id % 3 = 0 then ' | ' else '; ' end, 'RTO ', doc_id % 7, ' timer...')
                      else concat(replace(substr(text, 180, 60), ':', ' '), '; ', case when doc_id % 4 = 0 then '**' else 'oppstart i mai' end) end as text
        from {documents} cross join (select 0 as k union all select 1 union all select 2)""",
    "analysis_fields": """
        select doc_id, split_part('profile,requirements,solution,positioning', ',', k + 1) as field, case k when 0 then 'scale' when 3 then 'timeline' else 'threshold' end as category,
               case when k = 2 then null else concat(substr(text, 1, 200), case when doc_id % 5 = 0 then ' RTO: 4 timer' else '' end) end as text
        from {documents} cross join (select 0 as k union all select 1 union all select 2 union all select 3)""",
    "list_items": """
        select list_id, row_number() over (partition by list_id order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) as item,
               concat(split_part('Systemet,Løsningen,Tjenesten', ',', cast(l_partkey % 3 + 1 as int)), ' skal ', split_part('levere,støtte,vise,lagre', ',', cast(l_suppkey % 4 + 1 as int)), ' ', split_part('rapporter,varsler,meldinger,saker,dokumenter', ',', cast(l_orderkey % 5 + 1 as int)),
                      case when l_partkey % 2 = 0 then ' for alle brukere' else '' end, case when l_suppkey % 3 = 0 then ' i kommunen' else '' end, case when l_orderkey % 7 = 0 then concat(' innen ', l_linenumber, ' dager') when l_orderkey % 7 = 1 then ' ikke' else '' end,
                      case when l_linenumber = 4 then ' .' when l_linenumber = 5 then '  !' else '' end) as text
        from (select *, l_partkey % 211 as list_id from {lineitem}) where l_linenumber < 7 or l_partkey % 5 > 0
        union all select -1 - o_orderkey, 1, case o_orderkey % 3 when 0 then ' ' when 1 then '*' end from {orders} where o_orderkey < 5
        union all select -1 - o_orderkey, 2, '*' from {orders} where o_orderkey < 5""",
    "gold_rows": """
        select doc_id, cast(row_number() over (partition by doc_id order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 as int) as row, text from (
          select *, l_partkey % 120 as doc_id, concat('krav om ', split_part('drift,sikkerhet,logging,opplæring,migrering', ',', cast(l_suppkey % 5 + 1 as int)), case when l_partkey % 3 = 0 then concat(' skal leveres med full dokumentasjon og støtte for del ', l_suppkey % 20) else '' end) as text from {lineitem})""",
    "gold_entries": """
        select doc_id, cast(row_number() over (partition by doc_id order by l_orderkey + case when l_partkey % 7 = 0 then 900 else 0 end, l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 as int) as entry,
               case when l_linenumber = 5 then concat('merk at ', text) when l_linenumber = 6 then substr(text, 9) when l_suppkey % 31 = 0 then null else text end as text from (
          select *, l_partkey % 120 as doc_id, concat('krav om ', split_part('drift,sikkerhet,logging,opplæring,migrering', ',', cast(l_suppkey % 5 + 1 as int)), case when l_partkey % 3 = 0 then concat(' skal leveres med full dokumentasjon og støtte for del ', l_suppkey % 20) else '' end) as text from {lineitem})
        where l_suppkey % 11 > 0""",
    "coverage_items": """
        select l_orderkey as eval_id, l_linenumber - 1 as idx,
               case when l_suppkey % 17 = 0 then l_linenumber when l_suppkey % 19 <> 0 then l_linenumber - 1 end as order_index,
               case when l_partkey % 13 = 0 then '' else concat('R-', l_partkey % 6) end as reference,
               case when l_partkey % 4 = 0 then concat('full ', l_partkey % 6) else 'full' end as full_reference,
               case when l_partkey % 99 = 98 then 's' end as source_reference,
               case l_suppkey % 6 when 0 then 'Godt' when 1 then 'Dårlig' when 2 then 'Mangler' when 3 then 'Uklart' when 4 then 'Godt' else 'OK' end as assessment,
               case when l_partkey % 7 = 0 then ' ' else 'begrunnelse som er lang nok her' end as rationale,
               case when l_partkey % 11 = 0 then '' else 'bevis i dokumentet er funnet' end as evidence,
               case when l_partkey % 5 = 0 then 'ok' else 'anbefaling om at svaret utdypes' end as recommendation,
               case when l_linestatus = 'O' then l_suppkey end as answer_document,
               case l_suppkey % 9 when 0 then '' when 1 then 'Se vedlegg 3' when 2 then 'Vi kan ikke levere dette' when 3 then 'Ja' when 4 then 'se vedlegg, men løsningen har eget grensesnitt for dette' else concat('Løsningen leverer punkt ', l_partkey % 40, ' fullt ut') end as answer,
               l_returnflag <> 'N' as mandatory, l_partkey % 3 as section
        from {lineitem}""",
    "coverage_heads": """
        select l_orderkey as eval_id, count(*) + case when l_orderkey % 10 = 0 then 1 else 0 end as total, count(*) - case when l_orderkey % 14 = 0 then 1 else 0 end as assessed,
               count(*) + case when l_orderkey % 22 = 0 then 2 else 0 end as counted, count(*) + l_orderkey % 3 as source_count
        from {lineitem} group by l_orderkey""",
    "generated": """
        select o_orderkey as id, o_custkey as project_id,
               case o_orderpriority when '1-URGENT' then 'losningsutkast' when '2-HIGH' then 'gjennomforing_og_risiko' else o_orderpriority end as artifact_type,
               row_number() over (partition by o_custkey, o_orderpriority order by o_orderdate, o_orderkey) as version,
               o_orderdate as created_at, concat('h', o_orderkey) as content_hash,
               case when o_orderkey % 5 = 0 then 7 else o_custkey % 3 end as source_revision,
               case when o_orderkey % 7 = 0 then 7 else o_custkey % 2 end as library_revision,
               o_orderkey % 3 = 0 as used_evaluation, o_custkey * 10 + o_orderkey % 2 as input_evaluation_id,
               case when o_orderkey % 9 = 0 then -1 else o_custkey % 300 end as input_evaluation_at, concat('e', o_custkey) as input_evaluation_hash
        from {orders}""",
    "evaluations": """
        select c_custkey * 10 + k as id, c_custkey as project_id, c_custkey % 300 - k as updated_at, concat('e', c_custkey) as content_hash,
               case (c_custkey + k) % 4 when 0 then 'document_only' when 3 then 'legacy' else 'generated_artifact' end as mode,
               case when c_custkey % 5 = 0 then -1 else draft end as evaluated_id
        from {customer} left join (select o_custkey, max(case when o_orderpriority = '1-URGENT' then o_orderkey end) as draft from {orders} group by o_custkey) on o_custkey = c_custkey
        cross join (select 0 as k union all select 1 as k) where k = 0 or c_custkey % 3 = 0""",
    "summaries": """
        select c_custkey * 100 + k as id, c_custkey as project_id, k as updated_at, c_custkey % 6 <> 0 as verified,
               c_custkey * 10 + c_custkey % 2 * k as input_id, c_custkey % 300 as input_at, case when c_custkey % 8 = 0 then 'old' else concat('e', c_custkey) end as input_hash
        from {customer} cross join (select 0 as k union all select 1 as k)""",
    "project_documents": """
        select p_partkey as id, p_partkey % 200 as project_id,
               case p_size % 4 when 0 then 'primary_customer_document' when 1 then 'primary_solution_document' else 'supporting_document' end as role,
               case p_partkey % 11 when 0 then 'tidligere_losning' when 1 then 'kravdokument' when 2 then 'rfp' end as supporting_subtype,
               case p_partkey % 13 when 0 then 'tidligere_losning' end as legacy_subtype,
               concat(case p_partkey % 9 when 0 then 'Bilag 1 ' when 1 then 'Bilag_2-' when 2 then 'Krav og svar ' when 3 then 'Kravspesifikasjon ' when 4 then 'Requirements-response ' when 5 then 'Solution response ' else '' end, p_name) as title,
               concat(replace(p_type, ' ', '_'), case p_partkey % 7 when 0 then '_rfp' when 1 then '_losnings-besvarelse' else '' end, '.docx') as file_name,
               case p_partkey % 5 when 0 then 'processing' when 1 then 'enhanced_ready' else 'basic_ready' end as processing_status
        from {part}""",
    "jobs": """
        select o_orderkey as id, o_custkey as project_id, o_orderpriority as kind,
               case o_orderstatus when 'O' then 'queued' when 'P' then 'running' else 'completed' end as status,
               case when o_orderkey % 7 = 0 then null else o_orderdate end as locked_at,
               o_orderkey as submission_sequence, o_totalprice as cost
        from {orders}""",
}
#: The tables that each fixture reads.
READS = {
    "projects": ["supplier"],
    "principals": ["customer"],
    "memberships": ["orders"],
    "group_grants": ["supplier", "nation"],
    "group_members": ["customer"],
    "artifacts": ["orders"],
    "revisions": ["customer"],
    "jobs": ["orders"],
    "candidates": ["documents"],
    "coverage_items": ["lineitem"],
    "table_texts": ["documents"],
    "list_items": ["lineitem", "orders"],
    "source_entries": ["lineitem"],
    "analysis_facts": ["documents"],
    "analysis_fields": ["documents"],
    "chunk_first": ["documents"],
    "chunk_rows": ["documents"],
    "chunk_requests": ["documents"],
    "chunk_sources": ["documents"],
    "claim_documents": ["documents"],
    "claim_entries": ["documents"],
    "claims": ["benchmark"],
    "broken_texts": ["documents"],
    "row_lines": ["lineitem"],
    "gold_rows": ["lineitem"],
    "gold_entries": ["lineitem"],
    "glyph_rows": ["orders", "lineitem"],
    "coverage_heads": ["lineitem"],
    "paged": ["documents"],
    "scanned": ["documents"],
    "numbered_lines": ["orders"],
    "generated": ["orders"],
    "evaluations": ["customer", "orders"],
    "summaries": ["customer"],
    "project_documents": ["part"],
}


#: The part of ``glyph_rows`` that ten of its branches begin with.
NUMBERED = FIXTURES["glyph_rows"].split("from (select *, l_linenumber % 2", 1)[1].split(" union all", 1)[0]
NUMBERED = "(select *, l_linenumber % 2" + NUMBERED.rstrip()


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture as a DataFrame. What ``glyph_rows`` numbers for ten branches is numbered once."""
    sql, tables = FIXTURES[name], {t: table(spark, sf_dir, t) for t in READS[name]}
    if name == "glyph_rows":
        sql, tables["numbered"] = sql.replace(NUMBERED, "{numbered}"), materialize(spark.sql(f"select * from {NUMBERED}", lineitem=tables.pop("lineitem")), "numbered")
    return spark.sql(sql, **tables)


def with_fixtures(sql: str, *names: str) -> str:
    """DuckDB SQL in which the named fixtures are common table expressions."""
    parts = [f"{n} as ({FIXTURES[n].format(**{t: t for t in READS[n]})})" for n in names]
    body = sql.strip()
    if body.lower().startswith("with recursive "):
        return f"with recursive {', '.join(parts)}, {body[15:]}"
    if body.lower().startswith("with "):
        return f"with {', '.join(parts)}, {body[5:]}"
    return f"with {', '.join(parts)} {body}"


def query(oracle: str | None = None, fixtures: tuple[str, ...] = (), name: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name."""

    def add(fn: Query) -> Query:
        key = name or fn.__name__
        QUERIES[key] = fn
        if oracle:
            ORACLES[key] = with_fixtures(oracle, *fixtures) if fixtures else oracle.strip()
        return fn

    return add
