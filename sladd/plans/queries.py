"""Registered queries: name -> (callable(spark, folder) -> DataFrame, DuckDB text or None)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sladd.functions import filters, spans as S, validators as V
from sladd.functions.text import exploded, let, not_blank
from sladd.operators import aggregates as A, audit, blocks, flags, hooks, islands, joins, lexicons, language, markup, tables
from sladd.plans import oracles as O
from sladd.plans.analyze import anonymize, with_spans
from sladd.plans.fixtures import fixture_sql
from sladd.rules.detectors import BY_KEY, DETECTORS
from sladd.rules.entities import SCORE_THRESHOLD
from sladd.rules.headers import HEADER_RULES
from sladd.rules.languages import NORWEGIAN_TRAINING_TEXT
from sladd.rules.special import SPECIAL_CATEGORIES, SPECIAL_KEYS
from sladd.rules.words import DEFAULT_LEXICON
from sladd.sources import ledger, readers, records, writers

REGISTRY: dict = {}


def query(name: str, oracle: str | None = None):
    def register(fn):
        REGISTRY[name] = (fn, oracle)
        return fn

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table; one whose rows lie in few splits is dealt out (``readers.dealt``)."""
    return readers.dealt(readers.read_typed_table(spark, f"{folder}/{name}.parquet"))


def fixture(spark: SparkSession, folder: str, name: str) -> DataFrame:
    sql = fixture_sql(name)
    used = [t for t in ("orders", "customer", "pages", "documents") if "{" + t + "}" in sql]
    return spark.sql(sql, **{t: table(spark, folder, t) for t in used})


def documents(spark, folder):
    return table(spark, folder, "documents").select(F.col("doc_id").alias("unit_id"), "text")


# Documents together with the prose shapes, which hold the Norwegian wording the documents lack.
MIXED = f"SELECT doc_id AS unit_id, text FROM documents UNION ALL SELECT -1 - unit_id, text FROM ({O.fx('prose')}) AS p"


def mixed(spark, folder):
    prose = fixture(spark, folder, "prose").select((-1 - F.col("unit_id")).alias("unit_id"), "text")
    return documents(spark, folder).unionByName(prose)


def span_rows(df: DataFrame, chunk: bool = True) -> DataFrame:
    rows = exploded(df, ["unit_id"], F.col("spans"), "s")
    cols = ["unit_id", "s.entity", "s.start", F.col("s.end").alias("stop")]
    return rows.select(*cols, *(["s.chunk"] if chunk else []), F.round("s.score", 4).alias("score"))


# --- sources, sinks ---------------------------------------------------------------------------------------------


@query("read_text_units", "SELECT doc_id, text FROM documents")
def read_text_units(spark, folder):
    """Documents as bytes in the encodings the reader must tell apart, decoded again."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    crlf = F.regexp_replace("text", "\n", "\r\n")
    latin = F.col("text").rlike(r"\A[\x00-\xff]*\z")
    content = (
        F.when(F.col("doc_id") % 3 == 0, F.concat(F.unhex(F.lit("EFBBBF")), F.encode(crlf, "UTF-8")))
        .when((F.col("doc_id") % 3 == 1) & latin, F.encode("text", "ISO-8859-1"))
        .otherwise(F.encode("text", "UTF-8"))
    )
    return readers.decode_units(docs.select("doc_id", content.alias("content")), "doc_id")


def _csv_files(spark, header, lines):
    """CSV files of raw lines, each file under the same header line; a file for each task that made the lines, eight at least."""
    out, parts = writers.scratch_folder(spark), max(8, lines.rdd.getNumPartitions())
    rows = lines.select("line", F.pmod(F.xxhash64("line"), F.lit(parts)).alias("part"), F.lit(1).alias("o"))
    heads = spark.range(parts).select(F.lit(header).alias("line"), F.col("id").alias("part"), F.lit(0).alias("o"))
    both = rows.unionByName(heads).repartition(parts, "part").sortWithinPartitions("part", "o")
    both.select("line", "part").write.partitionBy("part").text(out)
    return f"{out}/part=*"


CSV_ROWS = (
    "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CASE WHEN c_custkey % 5 <> 1 THEN CAST(c_nationkey AS VARCHAR) END AS c_nationkey, "
    "CASE WHEN c_custkey % 5 <> 1 THEN c_mktsegment || ', ' || chr(34) || 'q' || chr(34) || chr(10) || 'x' END AS note, "
    "CASE WHEN c_custkey % 5 = 0 THEN 'a, ' || chr(34) || 'b' || chr(34) || '|' || c_mktsegment WHEN c_custkey % 5 = 2 THEN '' END AS overflow FROM customer")


def _customer_csv(spark, folder):
    line = F.expr('''
        c_custkey || ',' || c_name || CASE WHEN c_custkey % 5 = 1 THEN '' ELSE ',' || c_nationkey || ',"' || c_mktsegment || ', ""q""\nx"' END ||
        CASE c_custkey % 5 WHEN 0 THEN ',"a, ""b""",' || c_mktsegment WHEN 2 THEN ',' ELSE '' END''')
    return _csv_files(spark, "c_custkey,c_name,c_nationkey,note", table(spark, folder, "customer").select(line.alias("line")))


@query("read_csv_text", CSV_ROWS)
def read_csv_text(spark, folder):
    """Rows as long as the header, shorter ones and longer ones."""
    return readers.read_csv_text(spark, _customer_csv(spark, folder)).withColumn("overflow", F.array_join("overflow", "|"))


@query("read_csv_records", "SELECT CAST(doc_id AS VARCHAR) AS doc_id, nullif(text, '') AS text, nullif(source, '') AS source, "
       "CASE WHEN doc_id % 5 = 0 THEN 'x' || chr(10) || coalesce(lang, '') END AS overflow FROM documents")
def read_csv_records(spark, folder):
    """Whole documents as quoted cells, line ends inside, read by as many tasks as the files have splits."""
    quoted = """'"' || replace(coalesce({0}, ''), '"', '""') || '"'"""
    line = F.expr(f"""doc_id || ',' || {quoted.format("text")} || ',' || {quoted.format("source")} ||
        CASE WHEN doc_id % 5 = 0 THEN ',"x\n' || coalesce(lang, '') || '"' ELSE '' END""")
    path = _csv_files(spark, "doc_id,text,source", table(spark, folder, "documents").select(line.alias("line")))
    return records.read_csv_records(spark, path).withColumn("overflow", F.array_join("overflow", "|"))


@query("read_typed_table", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def read_typed_table(spark, folder):
    return table(spark, folder, "customer")


_SUFFIX_SQL = r"lower(regexp_extract(url, '(\.[^./]+)$', 1))"


def _kind_sql(suffix):
    from sladd.rules import media as m

    pairs = ((m.SUPPORTED_SUFFIXES, "supported"), (m.IMAGE_SUFFIXES, "image"), (m.VIDEO_SUFFIXES, "video"),
             (m.AUDIO_SUFFIXES, "audio"))
    return "CASE " + " ".join(f"WHEN {suffix} IN {O.values(s)} THEN '{k}'" for s, k in pairs) + " ELSE 'unsupported' END"


_URLS = ("SELECT page_id, url || CASE page_id % 5 WHEN 0 THEN '/a.txt' WHEN 1 THEN '/b.JPG' WHEN 2 THEN '/c.mp3' "
         "WHEN 3 THEN '/d.webm' ELSE '' END AS url FROM {pages}")


@query("manifest_triage",
       f"SELECT page_id, url, {_SUFFIX_SQL} AS suffix, {_kind_sql(_SUFFIX_SQL)} AS kind FROM ({_URLS.format(pages='pages')})")
def manifest_triage(spark, folder):
    return readers.manifest_triage(spark.sql(_URLS, pages=table(spark, folder, "pages")), "url")


@query("write_redacted", O.redact_sql(O.DOCUMENTS))
def write_redacted(spark, folder):
    out = writers.write_redacted(anonymize(documents(spark, folder), keep_spans=False), writers.scratch_folder(spark))
    return spark.read.parquet(out)


# --- projections, filters, tables -------------------------------------------------------------------------------


@query("blank_guard", f"SELECT unit_id, text, NOT regexp_matches(text, '\\S') AS blank FROM ({O.fx('prose')}) AS p")
def blank_guard(spark, folder):
    return fixture(spark, folder, "prose").withColumn("blank", ~not_blank(F.col("text")))


@query("entity_to_placeholder",
       f"SELECT unit_id, entity, {O.placeholder_sql()} AS placeholder FROM ({O.fx('entity')}) AS e")
def entity_to_placeholder(spark, folder):
    return A.with_placeholder(fixture(spark, folder, "entity"))


@query("score_threshold", f"SELECT span_id, score FROM ({O.fx('chunks')}) AS c WHERE score >= {SCORE_THRESHOLD}")
def score_threshold(spark, folder):
    return fixture(spark, folder, "chunks").where(F.col("score") >= SCORE_THRESHOLD).select("span_id", "score")


_SPAN_COLS = 'unit_id, src, start, "end" AS stop, score, entity'


@query("entity_allowlist", f"SELECT {_SPAN_COLS} FROM ({O.fx('spans')}) AS s WHERE entity IN ('PERSON', 'LOCATION')")
def entity_allowlist(spark, folder):
    rows = fixture(spark, folder, "spans").where(F.col("entity").isin("PERSON", "LOCATION"))
    return rows.withColumnRenamed("end", "stop")


_H = r"regexp_replace(header, '^\s+|\s+$', '', 'g')"
def _header_case(values):
    out = "CASE "
    for value, (_, pattern) in zip(values, HEADER_RULES):
        out += f"WHEN regexp_matches({_H}, {O.q('(?i)' + pattern)}) THEN {value} "
    return out + "END"


_HEADER_PLACEHOLDER = _header_case([O.q(p) for p, _ in HEADER_RULES])


@query("header_rule", f"SELECT header_id, header, {_HEADER_PLACEHOLDER} AS placeholder FROM ({O.fx('header')}) AS h")
def header_rule(spark, folder):
    return fixture(spark, folder, "header").withColumn("placeholder", tables.header_rule(F.col("header")))


@query("forced_mask",
       " UNION ALL ".join(f"SELECT '{t}' AS tbl, CAST({k} AS BIGINT) AS id, '[NAME]' AS name FROM {t}" for t, k in (
           ("customer", "c_custkey"), ("part", "p_partkey"), ("supplier", "s_suppkey"), ("nation", "n_nationkey"),
           ("region", "r_regionkey"))))
def forced_mask(spark, folder):
    out = None
    for name, key, column in (("customer", "c_custkey", "c_name"), ("part", "p_partkey", "p_name"),
                              ("supplier", "s_suppkey", "s_name"), ("nation", "n_nationkey", "n_name"),
                              ("region", "r_regionkey", "r_name")):
        df = table(spark, folder, name)
        forced, _ = tables.column_roles(df)
        masked = df.select(F.lit(name).alias("tbl"), F.col(key).cast("bigint").alias("id"),
                           tables.forced_mask(F.col(column), forced[column]).alias("name"))
        out = masked if out is None else out.unionByName(masked)
    return out


_CELL_HEADER = "CASE unit_id % 4 WHEN 0 THEN 'Poststed' WHEN 1 THEN 'Merknad' WHEN 2 THEN 'Storgata 5' ELSE ' ' END"
_CELLS = f"SELECT unit_id, text, {_CELL_HEADER} AS h FROM ({O.fx('address')}) AS a"
_PREFIX = "CASE WHEN trim(h) = '' THEN '' ELSE lower(trim(h)) || ': ' END"
_PREFIXED = f"SELECT unit_id, {_PREFIX} || text AS text FROM ({_CELLS}) AS c0"


@query("header_context_cell",
       f"SELECT c.unit_id, h, CASE WHEN starts_with(a.redacted, {_PREFIX}) THEN substr(a.redacted, length({_PREFIX}) + 1) "
       f"ELSE b.redacted END AS redacted FROM ({_CELLS}) AS c JOIN ({O.redact_sql(_PREFIXED)}) AS a USING (unit_id) "
       f"JOIN ({O.redact_sql(O.fx('address'))}) AS b USING (unit_id)")
def header_context_cell(spark, folder):
    cells = fixture(spark, folder, "address").select("unit_id", "text", F.expr(_CELL_HEADER).alias("h"))
    one = F.array(F.struct("h", F.col("text").alias("v")))
    done = tables.redact_value_cells(cells, one, "_cells")
    return done.select("unit_id", "h", F.col("_cells")[0].alias("redacted"))


# Analysed cells with phones, e-mail addresses and names, and what becomes of them.
_NOTE = ("CASE c_custkey % 4 WHEN 0 THEN 'ring 91234567 i dag' WHEN 1 THEN 'skriv til kunde@example.com' "
         "WHEN 2 THEN 'avtale med Bjørn-Arne Haugen ble signert' ELSE 'ingen merknad' END")
_NOTE_MASKED = ("CASE c_custkey % 4 WHEN 0 THEN 'ring [PHONE] i dag' WHEN 1 THEN 'skriv til [EMAIL]' "
                "WHEN 2 THEN 'avtale med [NAME] ble signert' ELSE 'ingen merknad' END")


def _customers(spark, folder):
    return table(spark, folder, "customer").withColumn("merknad", F.expr(_NOTE))


@query("typed_table_redact",
       f"SELECT c_custkey, '[NAME]' AS c_name, c_nationkey, c_acctbal, c_mktsegment, {_NOTE_MASKED} AS merknad FROM customer")
def typed_table_redact(spark, folder):
    return tables.redact_table(_customers(spark, folder))


@query("table_label_counts",
       "SELECT placeholder, CAST(count(*) AS BIGINT) AS n FROM (SELECT '[NAME]' AS placeholder FROM customer UNION ALL SELECT "
       "['[PHONE]', '[EMAIL]', '[NAME]'][c_custkey % 4 + 1] FROM customer WHERE c_custkey % 4 < 3) GROUP BY placeholder")
def table_label_counts(spark, folder):
    return tables.table_label_counts(_customers(spark, folder))


@query("csv_table_redact",
       "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, '[NAME]' AS c_name, CASE WHEN c_custkey % 5 <> 1 THEN '[ACCOUNT_NUMBER]' END AS kontonummer, "
       f"CASE WHEN c_custkey % 5 <> 1 THEN {_NOTE_MASKED} END AS merknad, CASE WHEN c_custkey % 5 = 0 THEN '[PHONE]|til [EMAIL]' END AS overflow FROM customer")
def csv_table_redact(spark, folder):
    """The cells of longer rows are analysed too."""
    line = F.concat_ws(",", "c_custkey", "c_name", F.expr(f"CASE WHEN c_custkey % 5 <> 1 THEN c_custkey + 1000000 || ',' || {_NOTE} END"),
                       F.expr("CASE WHEN c_custkey % 5 = 0 THEN '91234567,til a@example.com' END"))
    path = _csv_files(spark, "c_custkey,c_name,kontonummer,merknad", table(spark, folder, "customer").select(line.alias("line")))
    return tables.redact_table(readers.read_csv_text(spark, path)).withColumn("overflow", F.array_join("overflow", "|"))


# --- detectors --------------------------------------------------------------------------------------------------

_DETECTOR_SOURCES = {
    "national_id": "idnum", "org_number": "idnum", "phone_no": "phone", "bank_account": "account",
    "health_terms": "prose", "postal_address": "address", "street_address": "address", "postal_code": "address",
    "city": "address", "written_date": "date", "hyphen_name": "prose", "name_list": "prose", "email": "mail",
    "phone_intl": None, "credit_card": None, "ip": "address_ip", "date_numeric": "date", "iban": "account", "us_ssn": "idnum",
    "uk_nhs": "idnum", "us_passport": "idnum", "us_license": "license", "in_pan": "idnum", "sg_nric": "idnum",
    "au_abn": "idnum", "au_acn": "license", "medical_license": "license",
}


def _detector_query(key, source):
    keys = ("ip", "ip6") if key == "ip" else (key,)

    def run(spark, folder):
        df = fixture(spark, folder, source) if source else documents(spark, folder)
        return span_rows(with_spans(df, detectors=[BY_KEY[k] for k in keys], last="resolved"))

    query(f"det_{key}", O.detect_sql(O.fx(source) if source else O.DOCUMENTS, keys))(run)


for _key, _source in _DETECTOR_SOURCES.items():
    _detector_query(_key, _source)


@query("external_spans",
       f"SELECT {_SPAN_COLS} FROM ({O.fx('spans')}) AS s WHERE score >= {SCORE_THRESHOLD} "
       "AND (src = 0 OR entity IN ('PERSON', 'LOCATION'))")
def external_spans(spark, folder):
    return hooks.external_spans(fixture(spark, folder, "spans")).withColumnRenamed("end", "stop")


# --- validators, scoring ----------------------------------------------------------------------------------------

_VALIDATORS = {
    "valid_national_id": ("idnum", r"\d{6} ?\d{5}", V.valid_national_id, "national_id"),
    "valid_org_number": ("idnum", r"[89]\d{2} ?\d{3} ?\d{3}", V.valid_org_number, "org_number"),
    "valid_postal_city": ("address", r"\d{4} [A-Za-z]+", lambda c: V.valid_postal_city(c, DEFAULT_LEXICON.common),
                          "postal_city"),
    "valid_list_name": ("prose", r"[A-Z][a-z]+", lambda c: V.valid_list_name(c, DEFAULT_LEXICON.common), "list_name"),
    "valid_card": ("account", r"\d{16}", V.valid_card, "card"),
    "valid_iban": ("account", r"NO\d{13}", V.valid_iban, "iban"),
    "valid_nhs": ("idnum", r"\d{3} \d{3} \d{4}", V.valid_nhs, "nhs"),
    "valid_abn": ("idnum", r"\d{11}", V.valid_abn, "abn"),
    "valid_acn": ("license", r"\d{9}", V.valid_acn, "acn"),
    "valid_dea": ("license", r"AB\d{7}", V.valid_dea, "dea"),
}


def _validator_query(name, source, pattern, check, sql_name):
    def run(spark, folder):
        chunks = fixture(spark, folder, source).select("unit_id", F.regexp_extract("text", pattern, 0).alias("chunk"))
        return chunks.where("chunk <> ''").withColumn("valid", check(F.col("chunk")))

    oracle = (
        f"SELECT unit_id, chunk, {O.valid_sql(sql_name)} AS valid FROM (SELECT unit_id, "
        f"regexp_extract(text, {O.q(pattern)}) AS chunk FROM ({O.fx(source)}) AS f) AS c WHERE chunk <> ''"
    )
    query(name, oracle)(run)


for _name, _spec in _VALIDATORS.items():
    _validator_query(_name, *_spec)


@query("apply_validation",
       O.with_(O.candidate_ctes(O.fx("idnum"), [BY_KEY["national_id"], BY_KEY["us_ssn"]], use_context=False),
               f"SELECT {O.HIT_COLUMNS} FROM cand"))
def apply_validation(spark, folder):
    checked = [BY_KEY["national_id"], BY_KEY["us_ssn"]]
    return span_rows(with_spans(fixture(spark, folder, "idnum"), detectors=checked, last="scores", use_context=False))


_BOOSTED = ("postal_address", "street_address", "postal_code", "city")


@query("context_boost",
       O.with_(O.candidate_ctes(O.fx("address"), [BY_KEY[k] for k in _BOOSTED]), f"SELECT {O.HIT_COLUMNS} FROM cand"))
def context_boost(spark, folder):
    boosted = [BY_KEY[k] for k in _BOOSTED]
    return span_rows(with_spans(fixture(spark, folder, "address"), detectors=boosted, last="scores"))


# --- joins ------------------------------------------------------------------------------------------------------

_SINGLE = [n.lower() for n in DEFAULT_LEXICON.names if n.replace("-", " ").count(" ") == 0]
_DOUBLE = [n.lower() for n in DEFAULT_LEXICON.names if n.replace("-", " ").count(" ") == 1]


def _mark(source):
    return ("src", f"SELECT unit_id, text FROM ({source}) AS s0")


_NAME_HITS = (
    f"SELECT unit_id, start, start + length(one) AS stop, one AS chunk FROM tok WHERE lower(one) IN {O.values(_SINGLE)} "
    f"UNION ALL SELECT unit_id, start, start + length(two), two FROM tok WHERE lower(two) IN {O.values(_DOUBLE)}"
)


def _name_hits(spark, folder):
    names = joins.word_table(spark, DEFAULT_LEXICON.names, "name")
    return joins.name_list_join(mixed(spark, folder), names)


@query("name_list_join", O.with_([_mark(MIXED), *O.token_ctes()], _NAME_HITS))
def name_list_join(spark, folder):
    return _name_hits(spark, folder).withColumnRenamed("end", "stop")


@query("denylist_antijoin",
       O.with_([_mark(MIXED), *O.token_ctes(), ("hits", _NAME_HITS)],
               f"SELECT * FROM hits WHERE lower(chunk) NOT IN {O.values(DEFAULT_LEXICON.denied)}"))
def denylist_antijoin(spark, folder):
    denied = joins.word_table(spark, DEFAULT_LEXICON.denied, "word")
    return joins.denylist_antijoin(_name_hits(spark, folder), denied).withColumnRenamed("end", "stop")


@query("longest_name_first",
       O.with_([_mark(MIXED), *O.token_ctes(), ("hits", _NAME_HITS)],
               "SELECT unit_id, start, max(stop) AS stop, arg_max(chunk, length(chunk)) AS chunk FROM hits "
               "GROUP BY unit_id, start"))
def longest_name_first(spark, folder):
    return joins.longest_name_first(_name_hits(spark, folder)).withColumnRenamed("end", "stop")


@query("overlap_resolve",
       O.with_([("cand", O.fx("spans")), *O.resolve_ctes()], f"SELECT {_SPAN_COLS} FROM kept"))
def overlap_resolve(spark, folder):
    return A.resolve_spans(fixture(spark, folder, "spans")).withColumnRenamed("end", "stop")


@query("overlap_islands",
       O.with_([("cand", O.fx("spans")), *O.resolve_ctes()], 'SELECT unit_id, entity, start, "end" AS stop, round(score, 4) AS score, src FROM kept'))
def overlap_islands(spark, folder):
    """The same spans, resolved by islands of rows instead of one array a unit."""
    kept = islands.resolve_rows(fixture(spark, folder, "spans"))
    return kept.select("unit_id", "entity", "start", F.col("end").alias("stop"), F.round("score", 4).alias("score"), "src")


@query("header_rule_join",
       f"SELECT header_id, header, {_header_case(range(1, len(HEADER_RULES) + 1))} AS prio, {_HEADER_PLACEHOLDER} "
       f"AS placeholder FROM ({O.fx('header')}) AS h")
def header_rule_join(spark, folder):
    rules = spark.createDataFrame(tables.default_rules(), "prio int, placeholder string, pattern string")
    return tables.header_rule_join(fixture(spark, folder, "header"), "header", rules)


@query("cell_header_join",
       f"SELECT doc_id, table_no, row_no, col_no, text, CASE WHEN row_no > 0 AND col_no = 0 THEN '[NAME]' END AS forced "
       f"FROM ({O.fx('cells')}) AS c")
def cell_header_join(spark, folder):
    return tables.cell_header_join(fixture(spark, folder, "cells"))


@query("cell_table_redact",
       f"SELECT doc_id, table_no, row_no, col_no, CASE WHEN row_no > 0 AND col_no = 0 THEN '[NAME]' "
       f"ELSE replace(text, 'kunde@example.com', '[EMAIL]') END AS text FROM ({O.fx('cells')}) AS c")
def cell_table_redact(spark, folder):
    return tables.redact_cells(fixture(spark, folder, "cells")).drop("forced")


@query("cell_label_counts",
       f"SELECT doc_id, placeholder, CAST(count(*) AS BIGINT) AS n FROM (SELECT doc_id, CASE WHEN row_no > 0 AND col_no = 0 THEN '[NAME]' "
       f"WHEN contains(text, '@') THEN '[EMAIL]' END AS placeholder FROM ({O.fx('cells')}) AS c) WHERE placeholder IS NOT NULL GROUP BY ALL")
def cell_label_counts(spark, folder):
    return tables.cell_label_counts(fixture(spark, folder, "cells"))


_REPEATED = f"SELECT unit_id, text || ' karismatisk PERSONLIG haugenes' AS text FROM ({O.fx('prose')}) AS r"
_NAME_DETECTOR = [BY_KEY["name_list"]]


@query("value_propagation",
       O.with_([*O.analysis_ctes(_REPEATED, _NAME_DETECTOR),
                ("vals", 'SELECT DISTINCT unit_id, lower(substr(text, start + 1, "end" - start)) AS v FROM spans JOIN src USING (unit_id)'),
                ("pats", "SELECT unit_id, '(?i)(?:' || string_agg(v, '|' ORDER BY length(v) DESC, v) || ')' AS p FROM vals GROUP BY unit_id")],
               "SELECT src.unit_id, CASE WHEN p IS NULL THEN text ELSE regexp_replace(text, p, '[NAME]', 'g') END AS redacted "
               "FROM src LEFT JOIN pats USING (unit_id)"))
def value_propagation(spark, folder):
    rows = fixture(spark, folder, "prose").withColumn("text", F.concat("text", F.lit(" karismatisk PERSONLIG haugenes")))
    return joins.value_propagation(rows, detectors=_NAME_DETECTOR)


# --- false-positive rules ---------------------------------------------------------------------------------------


def _filter_query(rule):
    def run(spark, folder):
        rows = fixture(spark, folder, "chunks")
        fired = let(
            F.regexp_replace("chunk", r"(?U)^\s+|\s+$", ""),
            lambda c: filters.fires(rule, F.col("entity"), c, DEFAULT_LEXICON),
        )
        return rows.select("span_id", "entity", "chunk", fired.alias("dropped"))

    oracle = O.with_([("trimmed", f"SELECT *, {O._STRIP.format('chunk')} AS c FROM ({O.fx('chunks')}) AS f")],
                     f"SELECT span_id, entity, chunk, {O.RULE_SQL[rule]} AS dropped FROM trimmed")
    query(f"fp_{rule}", oracle)(run)


for _rule in filters.RULES:
    _filter_query(_rule)


@query("fp_salvage_prefix",
       O.with_(O.salvage_ctes(f"({O.fx('chunks')}) AS f"),
               f"SELECT span_id, chunk, substr(c, 1, cut) AS kept FROM judged WHERE {O.RULE_SQL['not_capitalised']} AND cut IS NOT NULL"))
def fp_salvage_prefix(spark, folder):
    rows = fixture(spark, folder, "chunks").withColumn("c", F.regexp_replace("chunk", r"(?U)^\s+|\s+$", ""))
    facts = filters.facts(F.col("entity"), F.col("c"), DEFAULT_LEXICON)
    cut = let(facts, lambda f: F.when(filters.not_capitalised(f), filters.salvage_length(f)))
    kept = rows.withColumn("cut", cut).where("cut is not null")
    return kept.select("span_id", "chunk", F.left("c", F.col("cut")).alias("kept"))


# --- whole analysis ---------------------------------------------------------------------------------------------


@query("analyze", O.analyze_sql(O.DOCUMENTS))
def analyze_(spark, folder):
    return span_rows(with_spans(documents(spark, folder)), chunk=False)


@query("redact_text", O.redact_sql(O.fx("prose")))
def redact_text(spark, folder):
    return anonymize(fixture(spark, folder, "prose"), keep_spans=False)


@query("anonymize_documents", O.redact_sql(O.DOCUMENTS))
def anonymize_documents(spark, folder):
    return anonymize(documents(spark, folder), keep_spans=False)


@query("stream_redact", O.redact_sql(O.DOCUMENTS))
def stream_redact(spark, folder):
    """The documents as a stream into a ledger; what it holds is what the table gives."""
    home = writers.scratch_folder(spark)
    units = documents(spark, folder)
    # a stream reads folders only, and the table may be one file
    units.write.parquet(f"{home}/in")
    units = spark.readStream.schema(units.schema).parquet(f"{home}/in")
    out = ledger.Ledger(spark, f"{home}/out")
    ledger.redact_stream(units, out, f"{home}/checkpoint", lambda df: anonymize(df, keep_spans=False)).awaitTermination()
    return out.read("redacted").drop("batch")


@query("name_table_redact", O.redact_sql(MIXED))
def name_table_redact(spark, folder):
    """The whole analysis with a table of names that grows with the data; names of orders occur in no text."""
    own = joins.word_table(spark, DEFAULT_LEXICON.names, "name")
    orders = spark.read.parquet(f"{folder}/orders.parquet").select(F.concat(F.lit("Ordrenavn"), F.col("o_orderkey")).alias("name"))
    return anonymize(mixed(spark, folder), names=lexicons.NameTable(own.unionByName(orders)), keep_spans=False)


# The detectors with hits in the supplied documents, counted per kind.
_MINIMUM = [BY_KEY[k] for k in ("email", "credit_card", "ip")]


_MINIMUM_SQL = O.with_([*O.analysis_ctes(O.DOCUMENTS, _MINIMUM), *O.redact_ctes(),
             ("kinds", "SELECT unit_id, count(*) FILTER (entity = 'EMAIL_ADDRESS') AS n_email, count(*) FILTER "
                       "(entity = 'CREDIT_CARD') AS n_card, count(*) FILTER (entity = 'IP_ADDRESS') AS n_ip FROM spans GROUP BY unit_id")],
            "SELECT unit_id, redacted, coalesce(n_email, 0) AS n_email, coalesce(n_card, 0) AS n_card, coalesce(n_ip, 0) AS n_ip "
            "FROM redacted LEFT JOIN kinds USING (unit_id)")


@query("anonymize_minimum", _MINIMUM_SQL)
def anonymize_minimum(spark, folder):
    return _with_kinds(anonymize(documents(spark, folder), detectors=_MINIMUM))


@query("anonymize_blocks", _MINIMUM_SQL)
def anonymize_blocks(spark, folder):
    """The same rows, with documents of over 2,000 characters analysed in blocks."""
    return _with_kinds(blocks.anonymize_blocks(documents(spark, folder), detectors=_MINIMUM, size=2000))


def _with_kinds(done):
    def count(entity):
        return F.size(F.filter("spans", lambda s: s["entity"] == entity)).cast("bigint")

    return done.select("unit_id", "redacted", count("EMAIL_ADDRESS").alias("n_email"),
                       count("CREDIT_CARD").alias("n_card"), count("IP_ADDRESS").alias("n_ip"))


_TURNS = "SELECT conv_id * 100000 + turn AS unit_id, text FROM conversations"


@query("anonymize_conversations",
       O.redact_sql(_TURNS, select="unit_id // 100000 AS conv_id, unit_id % 100000 AS turn, redacted, n"))
def anonymize_conversations(spark, folder):
    return anonymize(table(spark, folder, "conversations").select("conv_id", "turn", "text"), keep_spans=False)


# --- aggregates -------------------------------------------------------------------------------------------------

_LABELLED = [*O.analysis_ctes(O.fx("prose")),
             ("counts", f"SELECT unit_id, {O.placeholder_sql()} AS placeholder, count(*) AS n FROM spans GROUP BY ALL"),
             ("docs", "SELECT unit_id % 97 AS doc_id, placeholder, CAST(sum(n) AS BIGINT) AS n FROM counts GROUP BY ALL")]


def _unit_counts(spark, folder):
    return A.label_counts_unit(with_spans(fixture(spark, folder, "prose")))


def _doc_counts(spark, folder):
    return A.label_counts_doc(_unit_counts(spark, folder).withColumn("doc_id", F.col("unit_id") % 97))


@query("label_counts_unit", O.with_(_LABELLED, "SELECT unit_id, placeholder, n FROM counts"))
def label_counts_unit(spark, folder):
    return _unit_counts(spark, folder)


@query("label_counts_doc", O.with_(_LABELLED, "SELECT doc_id, placeholder, n FROM docs"))
def label_counts_doc(spark, folder):
    return _doc_counts(spark, folder)


_JSON = "'{' || string_agg('\"' || placeholder || '\":' || n, ',' ORDER BY placeholder) || '}'"


@query("label_counts_map", O.with_(_LABELLED, f"SELECT doc_id, {_JSON} AS pii_found FROM docs GROUP BY doc_id"))
def label_counts_map(spark, folder):
    return A.label_counts_map(_doc_counts(spark, folder)).withColumn("pii_found", F.to_json("pii_found"))


@query("total_replacements",
       O.with_(_LABELLED, "SELECT doc_id, CAST(sum(n) AS BIGINT) AS total FROM docs GROUP BY ROLLUP (doc_id)"))
def total_replacements(spark, folder):
    return A.total_replacements(_doc_counts(spark, folder))


@query("summary_sorted",
       O.with_(_LABELLED, "SELECT placeholder, CAST(sum(n) AS BIGINT) AS n FROM docs GROUP BY placeholder ORDER BY placeholder"))
def summary_sorted(spark, folder):
    return A.summary_sorted(_doc_counts(spark, folder))


@query("column_profile",
       "SELECT 'c_name' AS column_name, true AS forced, '[NAME]' AS placeholder, count(c_name) AS cells, count(c_name) AS masked "
       "FROM customer UNION ALL SELECT 'c_mktsegment', false, NULL, count(c_mktsegment), 0 FROM customer "
       "UNION ALL SELECT 'merknad', false, NULL, count(*), count(*) FILTER (c_custkey % 4 < 3) FROM customer")
def column_profile(spark, folder):
    return tables.column_profile(_customers(spark, folder))


# --- ordering, windows, sets ------------------------------------------------------------------------------------


@query("spans_by_score",
       f'SELECT {_SPAN_COLS}, row_number() OVER (PARTITION BY unit_id ORDER BY score DESC, src, start, "end" DESC, entity) - 1 '
       f"AS pos FROM ({O.fx('spans')}) AS s")
def spans_by_score(spark, folder):
    units = A.collect_spans(fixture(spark, folder, "spans"))
    rows = units.select("unit_id", F.posexplode(S.by_score(F.col("spans"))).alias("pos", "s"))
    return rows.select("unit_id", F.col("pos").cast("bigint").alias("pos"), "s.*").withColumnRenamed("end", "stop")


@query("sample_head",
       "SELECT conv_id, substr(string_agg(text, ' ' ORDER BY turn), 1, 3000) AS sample FROM (SELECT *, row_number() OVER "
       "(PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations) WHERE rn <= 5 GROUP BY conv_id")
def sample_head(spark, folder):
    return language.sample_head(table(spark, folder, "conversations"), "conv_id", "turn", "text", 5)


@query("span_union",
       f"SELECT unit_id, count(*) AS n, CAST(sum(\"end\" - start) AS BIGINT) AS chars FROM ({O.fx('spans')}) AS s "
       "WHERE src = 0 OR entity = 'PERSON' GROUP BY unit_id")
def span_union(spark, folder):
    rows = fixture(spark, folder, "spans")
    first = rows.where("src = 0")
    second = rows.where("src > 0 AND entity = 'PERSON'")
    both = A.collect_spans(first.unionByName(second))
    width = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    return both.select("unit_id", F.size("spans").cast("bigint").alias("n"), width.alias("chars"))


_WORDS_SQL = " UNION ".join(
    f"SELECT unnest(string_split_regex(lower({c}), '[^\\p{{L}}]+')) AS word FROM {t}"
    for t, c in (("part", "p_name"), ("supplier", "s_name"), ("nation", "n_name"))
)


@query("lexicon_union", f"SELECT DISTINCT word FROM ({_WORDS_SQL}) AS w WHERE word <> ''")
def lexicon_union(spark, folder):
    parts = [
        table(spark, folder, t).select(F.explode(F.split(F.lower(c), r"[^\p{L}]+")).alias("word"))
        for t, c in (("part", "p_name"), ("supplier", "s_name"), ("nation", "n_name"))
    ]
    return joins.lexicon_union(*parts)


# --- flags, language --------------------------------------------------------------------------------------------


def _flag_sql(text, terms):
    body = "|".join(terms)
    return f"regexp_matches({text}, {O.q(f'(?i)(?:^|[^' + O._WORD[1:-1] + f'])(?:{body})(?:$|[^' + O._WORD[1:-1] + '])')})"


def _flag_query(key, terms):
    def run(spark, folder):
        return mixed(spark, folder).select("unit_id", flags.has_category(F.col("text"), key).alias("flag"))

    query(f"special_{key}", f"SELECT unit_id, {_flag_sql('text', terms)} AS flag FROM ({MIXED}) AS d")(run)


for _k, (_label, _terms) in zip(SPECIAL_KEYS, SPECIAL_CATEGORIES):
    _flag_query(_k, _terms)

_CATEGORY_LIST = "list_filter([" + ", ".join(
    f"CASE WHEN {_flag_sql('text', terms)} THEN {O.q(label)} END" for label, terms in SPECIAL_CATEGORIES
) + "], lambda c: c IS NOT NULL)"
_FLAGGED = f"SELECT unit_id, {_CATEGORY_LIST} AS cats FROM ({MIXED}) AS d"


def _flagged(spark, folder):
    return mixed(spark, folder).select("unit_id", flags.special_categories(F.col("text")).alias("categories"))


@query("special_scan", f"SELECT unit_id, array_to_string(cats, ';') AS categories FROM ({_FLAGGED}) AS f")
def special_scan(spark, folder):
    return _flagged(spark, folder).withColumn("categories", F.array_join("categories", ";"))


@query("manual_review", f"SELECT unit_id, len(cats) > 0 AS review FROM ({_FLAGGED}) AS f")
def manual_review(spark, folder):
    return _flagged(spark, folder).select("unit_id", flags.manual_review(F.col("categories")).alias("review"))


@query("special_summary",
       f"WITH f AS ({_FLAGGED}) SELECT category, count(*) AS documents FROM (SELECT unnest(cats) AS category FROM f) GROUP BY category "
       "UNION ALL SELECT NULL, count(*) FROM f WHERE len(cats) > 0")
def special_summary(spark, folder):
    return flags.special_summary(_flagged(spark, folder))


def _profiles(spark, folder):
    """Learnt from the documents with an even id; the others test it."""
    return language.train_profiles(table(spark, folder, "documents").where("doc_id % 2 = 0"))


def _language_ctes(docs):
    """``top(unit_id, lang, p)``: trigram counts, ranks, log sums and the best language, for every document."""
    def gram(text):
        return f"(' ' || regexp_replace(lower({text}), '[^\\p{{L}}]+', ' ', 'g') || ' ')"

    def grams(rows, keys):
        return f"SELECT {keys}, unnest(list_transform(range(1, greatest(length(g) - 1, 1)), lambda i: substr(g, i, 3))) AS tri FROM ({rows})"

    langs = language.LANGUAGES
    lp = ", ".join(f"ln(coalesce(max(p) FILTER (lang = '{x}'), 1e-5)) AS l{i}" for i, x in enumerate(langs))
    sums = ", ".join(f"sum(l{i}) AS s{i}" for i in range(len(langs)))
    best = "greatest(" + ", ".join(f"s{i}" for i in range(len(langs))) + ")"
    total = " + ".join(f"exp(s{i} - {best})" for i in range(len(langs)))
    each = ", ".join(f"{{'p': exp(s{i} - {best}) / ({total}), 'lang': '{x}'}}" for i, x in enumerate(langs))
    return [
        ("labelled", f"SELECT lang, {gram('text')} AS g FROM documents WHERE doc_id % 2 = 0 AND lang IN {O.values(langs)} "
                     f"UNION ALL SELECT 'no', {gram(O.q(NORWEGIAN_TRAINING_TEXT))}"),
        ("counted", f"SELECT lang, tri, count(*) AS n FROM ({grams('FROM labelled', 'lang')}) GROUP BY ALL"),
        ("ranked_tri", "SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, tri) AS r FROM counted"),
        ("share", f"SELECT lang, tri, n / sum(n) OVER (PARTITION BY lang) AS p FROM ranked_tri WHERE r <= {language.PROFILE_SIZE}"),
        ("profile", f"SELECT tri, {lp} FROM share GROUP BY tri"),
        ("sampled", f"SELECT unit_id, {gram('substr(text, 1, 3000)')} AS g FROM ({docs}) AS d WHERE length({O._STRIP.format('text')}) >= 30"),
        ("sums", f"SELECT unit_id, {sums} FROM ({grams('FROM sampled', 'unit_id')}) JOIN profile USING (tri) GROUP BY unit_id"),
        ("judged_lang", f"SELECT unit_id, list_max([{each}]) AS t FROM sums"),
        ("top", f"SELECT d.unit_id, t.lang AS lang, t.p AS p FROM ({docs}) AS d LEFT JOIN judged_lang USING (unit_id)"),
    ]


@query("detect_language",
       O.with_(_language_ctes(O.DOCUMENTS), "SELECT unit_id AS doc_id, CASE WHEN p >= 0.7 THEN lang END AS language FROM top"))
def detect_language(spark, folder):
    return language.detect_language(table(spark, folder, "documents").select("doc_id", "text"), _profiles(spark, folder))


@query("top_language", O.with_(_language_ctes(O.DOCUMENTS), "SELECT unit_id AS doc_id, lang, round(p, 4) AS p FROM top"))
def top_language(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return language.top_language(language.language_scores(docs, _profiles(spark, folder))).withColumn("p", F.round("p", 4))


@query("language_supported",
       "SELECT doc_id, lang, lang IS NULL OR lang IN ('en', 'nb', 'no', 'nn') AS supported FROM documents")
def language_supported(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "lang")
    return docs.withColumn("supported", language.is_supported(F.col("lang")))


@query("language_gate",
       "SELECT coalesce(lang, 'unknown') AS lang, count(*) AS documents, count(*) FILTER (lang NOT IN ('en', 'nb', 'no', 'nn')) "
       "AS warnings FROM documents GROUP BY ALL")
def language_gate(spark, folder):
    return language.language_gate(table(spark, folder, "documents"))


# --- markup -----------------------------------------------------------------------------------------------------


def _media_sql(html):
    for pattern, placeholder in markup.MEDIA:
        html = f"regexp_replace({html}, {O.q(pattern)}, {O.q(placeholder)}, 'g')"
    return html


def _media_count_sql(html):
    out = []
    for i, (pattern, _) in enumerate(markup.MEDIA):
        out.append(f"len(regexp_extract_all({html}, {O.q(pattern)})) AS n_{('video', 'audio', 'other', 'image')[i]}")
        html = f"regexp_replace({html}, {O.q(pattern)}, '', 'g')"
    return ", ".join(out)


def _comments_sql(html):
    return f"regexp_replace({html}, {O.q(markup.COMMENT)}, '', 'g')"


def _meta_sql(html):
    return f"regexp_replace(regexp_replace({html}, {O.q(markup._META)}, '', 'g'), {O.q(markup._TITLE)}, '\\1\\2', 'g')"


def _changes_sql(html):
    inner = f"regexp_replace({html}, {O.q(r'(?is)<del\b[^>]*>.*?</del>')}, '', 'g')"
    return f"regexp_replace({inner}, {O.q(r'(?i)</?ins\b[^>]*>')}, '', 'g')"


@query("strip_comments",
       f"SELECT page_id, {_comments_sql('html')} AS html, len(regexp_extract_all(html, {O.q(markup.COMMENT)})) AS comments FROM pages")
def strip_comments(spark, folder):
    pages = table(spark, folder, "pages")
    return pages.select("page_id", markup.strip_comments(F.col("html")).alias("html"),
                        markup.comment_count(F.col("html")).alias("comments"))


@query("replace_media",
       f"SELECT page_id, {_media_sql('html')} AS html, {_media_count_sql('html')} FROM ({O.fx('html')}) AS h")
def replace_media(spark, folder):
    pages = fixture(spark, folder, "html").withColumn("counts", markup.media_counts(F.col("html")))
    counts = [F.col("counts")[i]["n"].alias(f"n_{k}") for i, k in enumerate(("video", "audio", "other", "image"))]
    return pages.select("page_id", markup.replace_media(F.col("html")).alias("html"), *counts)


@query("strip_metadata", f"SELECT page_id, {_meta_sql('html')} AS html FROM ({O.fx('html')}) AS h")
def strip_metadata(spark, folder):
    return fixture(spark, folder, "html").select("page_id", markup.strip_metadata(F.col("html")).alias("html"))


@query("accept_changes", f"SELECT page_id, {_changes_sql('html')} AS html FROM ({O.fx('html')}) AS h")
def accept_changes(spark, folder):
    return fixture(spark, folder, "html").select("page_id", markup.accept_changes(F.col("html")).alias("html"))


_PAGE_BODY = (f"SELECT page_id AS unit_id, {_media_sql(_comments_sql(_changes_sql(_meta_sql('html'))))} AS body "
              f"FROM ({O.fx('html')}) AS h")
_MARKUP_SQL = O.q(markup.MARKUP.replace("*+", "*"))
#: Pieces of a page in order (``i``), markup at odd places, with what each adds to the view and where.
_PAGE_PIECES = (
    "SELECT *, CAST(sum(length(part)) OVER (PARTITION BY unit_id ORDER BY i) - length(part) AS BIGINT) AS a FROM ("
    f"SELECT unit_id, i, piece, CASE WHEN i % 2 = 0 THEN piece WHEN regexp_matches(piece, {O.q(markup.INLINE)}) THEN '' ELSE {O.q(markup.BREAK)} END AS part FROM ("
    "SELECT unit_id, i, CASE WHEN i % 2 = 0 THEN texts[i // 2 + 1] ELSE tags[i // 2 + 1] END AS piece FROM ("
    f"SELECT unit_id, string_split_regex(body, {_MARKUP_SQL}) AS texts, regexp_extract_all(body, {_MARKUP_SQL}) AS tags FROM ({_PAGE_BODY})) p, "
    "unnest(range(2 * len(tags) + 1)) AS r(i)))")
_PAGE_VIEW = f"SELECT unit_id, string_agg(part, '' ORDER BY i) AS text FROM ({_PAGE_PIECES}) v GROUP BY unit_id"
#: Characters of texts outside spans, and a placeholder where a span starts.
_PAGE_REDACTED = (
    "SELECT unit_id AS page_id, string_agg(coalesce(shown, piece), '' ORDER BY i) AS redacted FROM piece LEFT JOIN ("
    "SELECT ch.unit_id, i, string_agg(CASE WHEN s.entity IS NULL THEN c WHEN s.start = pos THEN " + O.placeholder_sql("s.entity") + " ELSE '' END, '' ORDER BY pos) AS shown "
    "FROM (SELECT unit_id, i, a + k - 1 AS pos, substr(piece, k, 1) AS c FROM piece, unnest(range(1, length(piece) + 1)) AS u(k) WHERE i % 2 = 0) ch "
    "LEFT JOIN spans s ON s.unit_id = ch.unit_id AND s.start <= pos AND pos < s.\"end\" GROUP BY ALL) USING (unit_id, i) GROUP BY unit_id")


@query("anonymize_page", O.with_([*O.analysis_ctes(_PAGE_VIEW), ("piece", _PAGE_PIECES)], _PAGE_REDACTED))
def anonymize_page(spark, folder):
    """Values split by inline tags are masked; tags stay as they are."""
    return markup.anonymize_page(fixture(spark, folder, "html")).drop("counts")


# --- audit ------------------------------------------------------------------------------------------------------

_AUDIT_SQL = O.with_(
    [*O.analysis_ctes(MIXED), ("counts", f"SELECT unit_id, {O.placeholder_sql()} AS placeholder, count(*) AS n FROM spans GROUP BY ALL"),
     ("found", f"SELECT unit_id, {_JSON} AS pii_found, CAST(sum(n) AS BIGINT) AS total FROM counts GROUP BY unit_id"),
     ("cat", f"SELECT unit_id, {_CATEGORY_LIST} AS cats FROM src")],
    "SELECT unit_id, 'unknown' AS detected_language, false AS language_warning, array_to_string(cats, ';') AS categories, "
    "len(cats) > 0 AS review, coalesce(pii_found, '{}') AS pii_found, coalesce(total, 0) AS total_replacements, 'success' AS status, "
    "'u' || unit_id || '.txt' AS input_file, '/in/u' || unit_id || '.txt' AS input_path, '/out/u' || unit_id || '.txt' AS output_path, "
    "CAST(NULL AS VARCHAR) AS error FROM cat LEFT JOIN found USING (unit_id)")


def _paths(docs):
    name = F.concat(F.lit("u"), "unit_id", F.lit(".txt"))
    return docs.select("unit_id", F.concat(F.lit("/in/"), name).alias("input_path"), F.concat(F.lit("/out/"), name).alias("output_path"))


def _audit_columns(records):
    return records.select(
        "unit_id", "detected_language", "language_warning",
        F.array_join("article9_categories_detected", ";").alias("categories"),
        F.col("article9_manual_review_required").alias("review"), F.to_json("pii_found").alias("pii_found"),
        "total_replacements", "status", "input_file", "input_path", "output_path", "error",
    )


@query("audit_records", _AUDIT_SQL)
def audit_records(spark, folder):
    docs = mixed(spark, folder)
    return _audit_columns(audit.audit_records(docs, doc="unit_id", paths=_paths(docs)))


@query("audit_records_language",
       O.with_([*O.analysis_ctes(O.DOCUMENTS), ("counts", f"SELECT unit_id, {O.placeholder_sql()} AS placeholder, count(*) AS n FROM spans GROUP BY ALL"),
                ("found", f"SELECT unit_id, {_JSON} AS pii_found, CAST(sum(n) AS BIGINT) AS total FROM counts GROUP BY unit_id"),
                ("cat", f"SELECT unit_id, {_CATEGORY_LIST} AS cats FROM src"), *_language_ctes(O.DOCUMENTS)],
               "SELECT cat.unit_id, CASE WHEN p >= 0.7 THEN lang ELSE 'unknown' END AS detected_language, coalesce(p >= 0.7 AND lang NOT IN ('en', 'nb', 'no', 'nn'), false) "
               "AS language_warning, array_to_string(cats, ';') AS categories, len(cats) > 0 AS review, coalesce(pii_found, '{}') AS pii_found, "
               "coalesce(total, 0) AS total_replacements, 'success' AS status, 'u' || cat.unit_id || '.txt' AS input_file, '/in/u' || cat.unit_id || '.txt' AS input_path, "
               "'/out/u' || cat.unit_id || '.txt' AS output_path, CAST(NULL AS VARCHAR) AS error FROM cat JOIN top USING (unit_id) LEFT JOIN found USING (unit_id)"))
def audit_records_language(spark, folder):
    docs = documents(spark, folder)
    found = language.detect_language(docs, _profiles(spark, folder), doc="unit_id")
    return _audit_columns(audit.audit_records(docs, found, doc="unit_id", paths=_paths(docs)))


@query("audit_sink",
       f"SELECT unit_id, status, total_replacements, review, input_file, error FROM ({_AUDIT_SQL}) AS a UNION ALL "
       "SELECT doc_id, 'error', 0, false, 'u' || doc_id || '.txt', 'missing content' FROM documents WHERE doc_id % 10 = 9")
def audit_sink(spark, folder):
    """Records of inputs that were read and of inputs that were not, in one sink."""
    docs, out = mixed(spark, folder), writers.scratch_folder(spark)
    lost = documents(spark, folder).where("unit_id % 10 = 9").select("unit_id", F.lit("missing content").alias("error"))
    records = audit.audit_records(docs, doc="unit_id", paths=_paths(docs))
    writers.audit_sink(records.unionByName(audit.error_records(lost, "unit_id", paths=_paths(lost))), out)
    schema = "unit_id bigint, status string, total_replacements bigint, article9_manual_review_required boolean, input_file string, error string"
    back = spark.read.schema(schema).json(out)
    return back.select("unit_id", "status", "total_replacements", F.col("article9_manual_review_required").alias("review"), "input_file", "error")


@query("table_audit_records",
       f"SELECT doc_id, CAST(sum(n) AS BIGINT) AS total_replacements, {_JSON} AS pii_found, 'success' AS status, 'unknown' AS detected_language FROM ("
       f"SELECT doc_id, placeholder, count(*) AS n FROM (SELECT doc_id, CASE WHEN row_no > 0 AND col_no = 0 THEN '[NAME]' "
       f"WHEN contains(text, '@') THEN '[EMAIL]' END AS placeholder FROM ({O.fx('cells')}) AS c) WHERE placeholder IS NOT NULL GROUP BY ALL) GROUP BY doc_id")
def table_audit_records(spark, folder):
    records = audit.table_audit_records(tables.cell_label_counts(fixture(spark, folder, "cells")))
    return records.select("doc_id", "total_replacements", F.to_json("pii_found").alias("pii_found"), "status", "detected_language")


@query("error_isolation",
       "SELECT doc_id, CASE WHEN doc_id % 10 = 9 THEN 'error' ELSE 'success' END AS status, CASE WHEN doc_id % 10 = 9 THEN 'missing content' END "
       "AS error, CASE WHEN doc_id % 10 <> 9 THEN CASE WHEN doc_id % 10 = 3 THEN regexp_replace(text, '[^\\x00-\\x7f]', '', 'g') || 'ÿ' ELSE text END END AS text FROM documents")
def error_isolation(spark, folder):
    """Bytes that are not UTF-8 are read as Latin-1; missing ones are an error."""
    docs = table(spark, folder, "documents").select("doc_id", F.regexp_replace("text", r"[^\x00-\x7f]", "").alias("ascii"), "text")
    content = (
        F.when(F.col("doc_id") % 10 == 9, F.lit(None).cast("binary"))
        .when(F.col("doc_id") % 10 == 3, F.concat(F.encode("ascii", "UTF-8"), F.unhex(F.lit("FF"))))
        .otherwise(F.encode("text", "UTF-8"))
    )
    good, errors = audit.error_isolation(docs.select("doc_id", content.alias("content")), "doc_id")
    done = readers.decode_units(good, "doc_id").select("doc_id", F.lit("success").alias("status"), F.lit(None).cast("string").alias("error"), "text")
    return done.unionByName(errors.select("doc_id", "status", "error", F.lit(None).cast("string").alias("text")))


# --- extension points -------------------------------------------------------------------------------------------

_CUSTOM = hooks.custom_detector("CASE_REF", [(r"\bref \d{6} \d{5}\b", 0.97)], "[CASE]", context=("sak",))


@query("custom_detector", O.redact_sql(O.fx("idnum"), (*DETECTORS, _CUSTOM), extra={"CASE_REF": "[CASE]"}))
def custom_detector(spark, folder):
    return anonymize(fixture(spark, folder, "idnum"), detectors=(*DETECTORS, _CUSTOM), keep_spans=False)


def toy_model(texts):
    """Stands for a trained model: two-word runs after "avtale med" or "eier" are persons."""
    import re

    pattern = re.compile(r"(?:avtale med|eier) (\S+ \S+)")
    wrong = [("NRP", 0, 4, 0.9), ("PERSON", None, 3, 0.9), ("PERSON", 5, 10**6, 0.9)]  # kinds and offsets that the hook leaves out
    return [[("PERSON", m.start(1), m.end(1), 0.85) for m in pattern.finditer(text or "")] + wrong for text in texts]


_OWN_CTES = O.candidate_ctes(O.fx("prose"), DETECTORS)
_MODEL_ROWS = ("SELECT unit_id, 'PERSON' AS entity, CAST(strpos(text, m) + length(m) - length(c) - 1 AS BIGINT) AS start, CAST(strpos(text, m) + length(m) - 1 AS BIGINT) "
               "AS \"end\", c AS chunk, 1 AS src, 0.85::DOUBLE AS score FROM (SELECT unit_id, text, regexp_extract(text, '(?:avtale med|eier) (\\S+ \\S+)') AS m, "
               "regexp_extract(text, '(?:avtale med|eier) (\\S+ \\S+)', 1) AS c FROM src) WHERE m <> ''")


@query("custom_model_hook",
       O.with_([*_OWN_CTES[:-1], ("own", _OWN_CTES[-1][1]), ("cand", "SELECT unit_id, entity, start, \"end\", chunk, src, score FROM own UNION ALL " + _MODEL_ROWS),
                *O.resolve_ctes(), *O.filter_ctes(), *O.redact_ctes()], "SELECT unit_id, redacted, n FROM redacted"))
def custom_model_hook(spark, folder):
    rows = hooks.with_model_spans(fixture(spark, folder, "prose"), toy_model)
    return anonymize(rows, external="external", keep_spans=False)


def queries():
    return {name: fn for name, (fn, _) in REGISTRY.items()}


def oracle_sql():
    return {name: sql for name, (_, sql) in REGISTRY.items() if sql}
