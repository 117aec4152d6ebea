"""Test shapes derived row by row from the given tables, so they grow with them.

Each text is valid in Spark SQL and DuckDB; ``{orders}`` and so on name the tables.
"""

TEXT_FIXTURES = {
    "idnum": """
SELECT o_orderkey AS unit_id,
  CASE o_orderkey % 8
   WHEN 0 THEN 'fnr ' || lpad(cast(1 + o_orderkey % 28 as string),2,'0') || lpad(cast(1 + o_orderkey % 12 as string),2,'0') || lpad(cast(o_orderkey % 100 as string),2,'0') || lpad(cast((o_orderkey * 7919) % 100000 as string),5,'0')
   WHEN 1 THEN 'ref ' || lpad(cast(1 + o_orderkey % 28 as string),2,'0') || lpad(cast(1 + o_orderkey % 12 as string),2,'0') || lpad(cast(o_orderkey % 100 as string),2,'0') || ' ' || lpad(cast((o_orderkey * 7919) % 100000 as string),5,'0')
   WHEN 2 THEN 'orgnr 9' || lpad(cast((o_orderkey * 104729) % 100000000 as string),8,'0')
   WHEN 3 THEN 'org nr 98' || lpad(cast(o_orderkey % 10 as string),1,'0') || ' ' || lpad(cast((o_orderkey * 31) % 1000 as string),3,'0') || ' ' || lpad(cast((o_orderkey * 37) % 1000 as string),3,'0')
   WHEN 4 THEN 'ssn ' || lpad(cast(o_orderkey % 1000 as string),3,'0') || '-' || lpad(cast(1 + o_orderkey % 99 as string),2,'0') || '-' || lpad(cast(1 + o_orderkey % 9999 as string),4,'0')
   WHEN 5 THEN 'nhs ' || lpad(cast(400 + o_orderkey % 100 as string),3,'0') || ' ' || lpad(cast((o_orderkey * 13) % 1000 as string),3,'0') || ' ' || lpad(cast((o_orderkey * 17) % 10000 as string),4,'0')
   WHEN 6 THEN 'pan ABCDE' || lpad(cast(o_orderkey % 10000 as string),4,'0') || 'F nric S' || lpad(cast((o_orderkey * 11) % 10000000 as string),7,'0') || 'D'
   ELSE 'abn ' || lpad(cast((o_orderkey * 1299709) % 100000000000 as string),11,'0') || ' passport ' || lpad(cast((o_orderkey * 15485863) % 1000000000 as string),9,'0')
  END AS text FROM {orders}""",
    "address_ip": """
SELECT doc_id AS unit_id, text || CASE doc_id % 6
   WHEN 0 THEN ' dead::beef, ::1; fe80::. ::ffff:10.0.0.1: 1:2:3:4:5:6:7:8 1:2:3:4:5:6:7:8:9 std::x 12:30:45 a::b::c 2001:DB8::7/64'
   WHEN 1 THEN repeat(' prose far from digits', 40) || ' fe80::dead:beef ' || repeat(' and more of it', 40)
   WHEN 2 THEN repeat(' x 1', 300) || repeat(' far', 100) || ' dead::beef'
   WHEN 3 THEN ' 2001:db8:0:0:0:0:2:1, 10.1.2.3 and 300.1.2.3'
   WHEN 4 THEN ' at 12:30:45, a:b'
   ELSE '' END AS text FROM {documents}""",
    "mail": """
SELECT doc_id AS unit_id, text || CASE doc_id % 4
   WHEN 0 THEN ' ' || repeat('long.', 16) || 'name@x.no'
   WHEN 1 THEN ' a@b.com.x@y.no, ' || repeat('w', 5000) || ' ..@x.no'
   WHEN 2 THEN ' a@b@c.de x@y'
   ELSE '' END AS text FROM {documents}""",
    "license": """
SELECT o_orderkey AS unit_id,
  CASE o_orderkey % 3
   WHEN 0 THEN 'dea AB' || lpad(cast((o_orderkey * 7919) % 10000000 as string),7,'0')
   WHEN 1 THEN 'driver license D' || lpad(cast((o_orderkey * 104729) % 10000000 as string),7,'0')
   ELSE 'acn ' || lpad(cast((o_orderkey * 15485863) % 1000000000 as string),9,'0')
  END AS text FROM {orders}""",
    "phone": """
SELECT o_orderkey AS unit_id,
  CASE o_orderkey % 6
   WHEN 0 THEN 'tlf 9' || lpad(cast(o_orderkey % 10 as string),1,'0') || ' ' || lpad(cast(o_orderkey % 100 as string),2,'0') || ' ' || lpad(cast((o_orderkey * 7) % 100 as string),2,'0') || ' ' || lpad(cast((o_orderkey * 3) % 100 as string),2,'0')
   WHEN 1 THEN 'ring +47 4' || lpad(cast((o_orderkey * 7919) % 10000000 as string),7,'0')
   WHEN 2 THEN 'kontakt +47 22 ' || lpad(cast(o_orderkey % 100 as string),2,'0') || ' ' || lpad(cast((o_orderkey * 7) % 100 as string),2,'0') || ' ' || lpad(cast((o_orderkey * 3) % 100 as string),2,'0')
   WHEN 3 THEN 'mob 004791' || lpad(cast((o_orderkey * 13) % 1000000 as string),6,'0')
   WHEN 4 THEN 'call (' || cast(200 + o_orderkey % 700 as string) || ') 555-' || lpad(cast((o_orderkey * 3) % 10000 as string),4,'0')
   ELSE 'antall ' || cast(o_orderkey as string) || ' stk'
  END AS text FROM {orders}""",
    "account": """
SELECT o_orderkey AS unit_id,
  CASE o_orderkey % 4
   WHEN 0 THEN 'konto ' || lpad(cast(1000 + o_orderkey % 9000 as string),4,'0') || '.' || lpad(cast(o_orderkey % 100 as string),2,'0') || '.' || lpad(cast((o_orderkey * 7919) % 100000 as string),5,'0')
   WHEN 1 THEN 'account ' || lpad(cast(1000 + o_orderkey % 9000 as string),4,'0') || ' ' || lpad(cast(o_orderkey % 100 as string),2,'0') || ' ' || lpad(cast((o_orderkey * 7919) % 100000 as string),5,'0')
   WHEN 2 THEN 'iban NO' || lpad(cast(2 + o_orderkey % 97 as string),2,'0') || lpad(cast((o_orderkey * 1299709) % 100000000000 as string),11,'0')
   ELSE 'card ' || lpad(cast(4000000000000000 + (o_orderkey * 2750159) as string),16,'0')
  END AS text FROM {orders}""",
    "address": """
SELECT o_orderkey AS unit_id,
  CASE o_orderkey % 7
   WHEN 0 THEN 'bor i Storgata ' || cast(1 + o_orderkey % 90 as string) || ', ' || lpad(cast(100 + o_orderkey % 9800 as string),4,'0') || ' Oslo.'
   WHEN 1 THEN 'adresse Fjordveien ' || cast(1 + o_orderkey % 90 as string) || 'B'
   WHEN 2 THEN 'postnummer ' || lpad(cast(100 + o_orderkey % 9800 as string),4,'0')
   WHEN 3 THEN 'poststed Bergen'
   WHEN 4 THEN 'saken gjelder ' || lpad(cast(100 + o_orderkey % 9800 as string),4,'0') || ' GNR'
   WHEN 5 THEN 'Kong Oscars gate ' || cast(1 + o_orderkey % 90 as string)
   ELSE 'en tur til Bergen i ' || cast(1990 + o_orderkey % 40 as string)
  END AS text FROM {orders}""",
    "date": """
SELECT o_orderkey AS unit_id,
  CASE o_orderkey % 4
   WHEN 0 THEN 'den ' || cast(1 + o_orderkey % 28 as string) || '. mars ' || cast(1990 + o_orderkey % 40 as string)
   WHEN 1 THEN lpad(cast(1 + o_orderkey % 28 as string),2,'0') || '.' || lpad(cast(1 + o_orderkey % 12 as string),2,'0') || '.' || cast(1990 + o_orderkey % 40 as string)
   WHEN 2 THEN cast(1990 + o_orderkey % 40 as string) || '-' || lpad(cast(1 + o_orderkey % 12 as string),2,'0') || '-' || lpad(cast(1 + o_orderkey % 28 as string),2,'0')
   ELSE 'leilighet fra ' || cast(1990 + o_orderkey % 40 as string)
  END AS text FROM {orders}""",
    "prose": """
SELECT o_orderkey AS unit_id,
  CASE o_orderkey % 11
   WHEN 0 THEN 'Kari Olsen og Per Hansen var i stede'
   WHEN 1 THEN 'avtale med Bjørn-Arne Haugen ble signert'
   WHEN 2 THEN 'pasient under behandling, resept nr ' || cast(o_orderkey as string)
   WHEN 3 THEN 'diagnosis and genetic test for a trade union member'
   WHEN 4 THEN 'domfelt for vold, muslim, seksuell orientering ukjent'
   WHEN 5 THEN 'fingeravtrykk, etnisk opprinnelse og politisk syn'
   WHEN 6 THEN 'Mai og Tom er dager, August er en måned'
   WHEN 7 THEN 'user' || cast(o_orderkey as string) || '@example.com fra 10.0.' || cast(o_orderkey % 256 as string) || '.' || cast((o_orderkey * 7) % 256 as string)
   WHEN 8 THEN 'eier Anne-Marie Da Silva' || chr(10) || 'og Ole Brumm'
   WHEN 9 THEN 'kontakt ola@x' || cast(o_orderkey % 9 as string) || '.no eller Ola'
   ELSE '   '
  END AS text FROM {orders}""",
}

ENTITY_FIXTURE = """
SELECT o_orderkey AS unit_id, CASE o_orderkey % 29 {cases} ELSE 'UNKNOWN_X' END AS entity FROM {{orders}}"""

HEADERS = (
    "Etternavn", "filename", "Telefonnummer", "E-post", "postadresse", "Postnr", "capacity", "birth_date",
    "kontonummer", "org nr", "card_number", "IP address", "employee_id", "diagnose", "dna_profil", "fingeravtrykk",
    "religion", "fagforbund", "parti", "etnisitet", "seksualitet", "siktelse", "personnummer", "cancelled",
    "quantity", "   ",
)

# (entity, SQL text of the chunk, score)
CHUNKS = (
    ("LOCATION", "cast(1900 + o_orderkey % 200 as string)", 0.85),
    ("NO_ADDRESS", "cast(1900 + o_orderkey % 200 as string) || ' vedtak'", 1.0),
    ("PERSON", "'KN-' || lpad(cast(o_orderkey % 1000 as string),3,'0')", 0.85),
    ("PERSON", "'DNS'", 0.85),
    ("PERSON", "' soverom'", 0.85),
    ("PERSON", "'fra'", 0.6),
    ("PERSON", "'Per'", 0.6),
    ("PERSON", "'Takkonstruksjon'", 0.85),
    ("PERSON", "'det kort vei til skole'", 0.85),
    ("PERSON", "'Hansen bor her ' || cast(o_orderkey as string)", 0.85),
    ("PERSON", "'Vei Hansen'", 0.85),
    ("PERSON", "'Ludwig van Berg'", 0.85),
    ("LOCATION", "'Oslo' || chr(10) || 'Bergen'", 0.85),
    ("LOCATION", "'NS'", 0.85),
    ("LOCATION", "'tak,'", 0.85),
    ("LOCATION", "'Naboforhold'", 0.85),
    ("LOCATION", "'til ny'", 0.85),
    ("NO_ADDRESS", "cast(1000 + o_orderkey % 9000 as string) || chr(10) || 'Poststed'", 0.65),
    ("DATE_TIME", "'eierleilighet fra ' || cast(1990 + o_orderkey % 40 as string)", 0.85),
    ("LOCATION", "'Oslo '", 0.85),
    ("DATE_TIME", "'12.03.' || cast(1950 + o_orderkey % 70 as string)", 0.6),
    ("LOCATION", "'x\u0180y'", 0.85),
    ("PERSON", "'Kari Hansen'", 0.85),
    ("PERSON", "'Kari'", 0.2),
    ("LOCATION", "'x\ue001y'", 0.85),
    ("NRP", "'Ola Olsen, eier av hus'", 0.85),
    ("NRP", "'Bygg Rapporten'", 0.85),
)

SPANS_FIXTURE = """
SELECT unit_id, CAST(j AS INT) AS src, CAST((unit_id * (j + 3)) % 40 AS INT) AS start,
 CAST((unit_id * (j + 3)) % 40 + 1 + (unit_id + j * 5) % 9 AS INT) AS "end",
 CAST((unit_id * 7 + j * 13) % 10 AS DOUBLE) / 10 AS score,
 CASE j % 4 WHEN 0 THEN 'PERSON' WHEN 1 THEN 'LOCATION' WHEN 2 THEN 'NO_PHONE' ELSE 'DATE_TIME' END AS entity
 FROM (SELECT o_orderkey AS unit_id, {six} AS j FROM {{orders}}) AS g"""

CELLS_FIXTURE = """
SELECT c_nationkey AS doc_id, 0 AS table_no, 1 + c_custkey AS row_no, 0 AS col_no, c_name AS text FROM {customer}
 UNION ALL SELECT c_nationkey, 0, 1 + c_custkey, 1, CASE WHEN c_custkey % 3 = 0 THEN 'kunde@example.com ' || c_mktsegment ELSE c_mktsegment END FROM {customer}
 UNION ALL SELECT DISTINCT c_nationkey, 0, CAST(0 AS BIGINT), 0, 'Kundenavn' FROM {customer}
 UNION ALL SELECT DISTINCT c_nationkey, 0, CAST(0 AS BIGINT), 1, 'Segment' FROM {customer}"""

HTML_FIXTURE = """
SELECT page_id, html || '<p>Ka<b>ri</b> Olsen, <a title="Per Hansen" href="#">tlf. 912<i>34</i>567</a></p><p>Oslo</p>' || CASE page_id % 6
  WHEN 0 THEN '<img src="a.png"><p>x</p><img src="b.gif">' WHEN 1 THEN '<video src="v.mp4"></video>'
  WHEN 2 THEN '<audio src="s.mp3"></audio>' WHEN 3 THEN '<p>a <del>gammel</del><ins>ny</ins> b</p>'
  WHEN 4 THEN '<p>Kari Olsen, tlf 91 23 45 67, kari@example.com</p>'
  ELSE '<object data="o.bin"></object><meta name="author" content="Kari Olsen"><meta property="article:author" content="Ola"><meta property="og:url" content="u">' END AS html FROM {pages}"""


def _cases(values, quote=True):
    shown = [f"'{v}'" if quote else str(v) for v in values]
    return " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(shown))


def fixture_sql(name: str, engine: str = "spark") -> str:
    """SQL text of a fixture with table names still in braces."""
    from sladd.rules.entities import ENTITY_TO_PLACEHOLDER

    if name in TEXT_FIXTURES:
        return TEXT_FIXTURES[name]
    if name == "entity":
        return ENTITY_FIXTURE.format(cases=_cases(ENTITY_TO_PLACEHOLDER))
    if name == "header":
        n = len(HEADERS)
        return f"SELECT o_orderkey AS header_id, CASE o_orderkey % {n} {_cases(HEADERS)} END AS header FROM {{orders}}"
    if name == "chunks":
        n = len(CHUNKS)
        return (
            f"SELECT o_orderkey AS span_id, CASE o_orderkey % {n} {_cases(c[0] for c in CHUNKS)} END AS entity, "
            f"CASE o_orderkey % {n} {_cases((c[1] for c in CHUNKS), quote=False)} END AS chunk, "
            f"CAST(CASE o_orderkey % {n} {_cases((c[2] for c in CHUNKS), quote=False)} END AS DOUBLE) AS score "
            "FROM {orders}"
        )
    if name == "spans":
        six = "explode(sequence(0, 5))" if engine == "spark" else "unnest(range(0, 6))"
        text = SPANS_FIXTURE.format(six=six).replace("{{", "{").replace("}}", "}")
        return text.replace('"end"', "`end`") if engine == "spark" else text
    if name == "cells":
        return CELLS_FIXTURE
    if name == "html":
        return HTML_FIXTURE
    raise KeyError(name)
