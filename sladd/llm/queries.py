"""Registered queries of the operators, and their DuckDB texts where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from sladd.llm import bpe, decontaminate, exact_dedup, html_extract, jaccard_join, language_id, licenses, line_dedup, resample, sentencepiece_bpe, suffix_dedup, url_filter, whitening
from sladd.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
#: A-Z lower-cased, other letters left alone; and the characters stripped from lines.
SQL_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_url_filter(spark, sf_dir):
    """Verdict on every page's URL by the list rules, else by rules mined from the labels."""
    out = url_filter.judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))
    return out.select("page_id", "host", "path", "rule", "verdict")


ORACLES["op1_url_filter"] = r"""
WITH p AS (SELECT page_id, HOST AS host, regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
t AS (SELECT *, list_distinct(list_concat(
    list_transform(list_filter(string_split(host, '.'), lambda x: x <> ''), lambda x: 'h:' || x),
    list_transform(list_filter(regexp_split_to_array(PATH, '[^0-9a-z]+'), lambda x: x <> ''), lambda x: 'p:' || x))) AS w FROM p),
mark AS (SELECT doc_id, max(coalesce(toxic, 0) = 1 OR coalesce(quality, 1) = 0) AS block FROM labels GROUP BY doc_id),
seen AS (SELECT t.w, mark.block FROM t JOIN mark ON mark.doc_id = t.page_id),
sub AS (SELECT list_sort(list_filter(w, lambda x, i: (m >> (i - 1)) % 2 = 1)) AS g, block FROM seen, unnest(range(1, (1 << len(w))::BIGINT)) AS u(m)),
rules AS (SELECT g FROM sub GROUP BY g HAVING count(*) FILTER (block) >= (SELECT greatest(5, ceil(0.002 * count(*))) FROM seen)
  AND count(*) FILTER (block) / count(*) >= 0.5),
met AS (SELECT DISTINCT page_id FROM t JOIN rules ON list_has_all(t.w, rules.g)),
listed(verdict, rule) AS (VALUES ('allow', 'org/'), ('block', 'example.org/es/'), ('block', 'example.org/en/1'), ('allow', 'com/fr/'), ('block', 'com/de/')),
fit AS (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict FROM p JOIN listed
  ON (host = split_part(rule, '/', 1) OR ends_with(host, '.' || split_part(rule, '/', 1))) AND starts_with(path, substr(rule, strpos(rule, '/')))
  GROUP BY page_id)
SELECT p.page_id, p.host, p.path, fit.rule, coalesce(fit.verdict, CASE WHEN met.page_id IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN fit USING (page_id) LEFT JOIN met USING (page_id)""".replace("HOST", SQL_LOWER.format(r"regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1)")).replace("PATH", SQL_LOWER.format("path"))


@query
def op2_license_scan(spark, sf_dir):
    """Best licence template of every document."""
    return licenses.scan(table(spark, sf_dir, "documents"))


def _license_sql() -> str:
    rows = ",\n  ".join(f"({i}, '{name}', {licenses.bigrams(body)})" for i, (name, body) in enumerate(licenses.TEMPLATES))
    return f"""
WITH template(pos, license, g) AS (VALUES
  {rows}),
norm AS (SELECT doc_id, lower(regexp_replace(coalesce(text, ''), '[^\\p{{L}}\\p{{N}}\\n]+', ' ', 'g')) AS t FROM documents),
unit AS (SELECT DISTINCT doc_id, trim(regexp_replace(u, '[ \\n]+', ' ', 'g')) AS u FROM (
  SELECT doc_id, unnest(list_concat(string_split(t, chr(10)), regexp_split_to_array(t, '\\n ?(?:\\n ?)+'), [t])) AS u FROM norm)),
word AS (SELECT doc_id, u, string_split(u, ' ') AS w FROM unit),
gram AS (SELECT doc_id, u, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM word WHERE len(w) > 1),
score AS (SELECT doc_id, u, pos, license, 2.0::DOUBLE * len(list_intersect(gram.g, template.g)) / (len(gram.g) + len(template.g)) AS dice FROM gram, template
  WHERE len(gram.g) <= 1.5 * len(template.g) AND len(gram.g) >= len(template.g) / 1.5 - 1e-9),
best AS (SELECT doc_id, arg_max(license, (dice, -pos)) AS license, max(dice) AS dice, count(DISTINCT u) AS n_units FROM score WHERE dice >= 0.8 GROUP BY doc_id)
SELECT doc_id, license, dice, coalesce(n_units, 0) AS n_units FROM documents LEFT JOIN best USING (doc_id)"""


ORACLES["op2_license_scan"] = _license_sql()


@query
def op3_line_dedup(spark, sf_dir):
    """Drop lines of 20 code points or more that three documents share, but for the largest document."""
    kept = line_dedup.drop_lines(table(spark, sf_dir, "documents"))
    return kept.select("rest.doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLES["op3_line_dedup"] = f"""
WITH lines AS (
  SELECT doc_id, i, parts[i] AS line, {SQL_LOWER.format("trim(parts[i], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS k
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents) d, unnest(range(1, len(parts) + 1)) AS u(i)),
shared AS (SELECT k, max(doc_id) AS top FROM lines WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
judged AS (SELECT l.*, s.k IS NOT NULL AND l.doc_id <> s.top AS gone FROM lines l LEFT JOIN shared s USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id"""


@query
def op5_exact_dedup(spark, sf_dir):
    """Exact copies after lower-casing A-Z, with the document that stays."""
    out = exact_dedup.deduplicate(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


ORACLES["op5_exact_dedup"] = f"""
WITH d AS (SELECT doc_id, sha256({SQL_LOWER.format("coalesce(text, '')")}) AS text_sha256 FROM documents),
w AS (SELECT *, max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM w"""


@query
def op7_bpe(spark, sf_dir):
    """Ids and decoded text of every document under the word vocabulary, as digests."""
    out = bpe.encode_decode(table(spark, sf_dir, "documents"))
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                      F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op8_decontaminate(spark, sf_dir):
    """Words of documents inside a window of ten words of a benchmark item, and the items."""
    out = decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: x - a)
    return out.select("rest.doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                      F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


ORACLES["op8_decontaminate"] = r"""
WITH item AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(LOWERED, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT item_id, w[i : i + least(len(w), 10) - 1] AS g FROM item, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS u(i) WHERE len(w) > 0),
doc AS (SELECT doc_id, regexp_extract_all(LOWERED, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
size AS (SELECT DISTINCT len(g) AS n FROM win),
occ AS (SELECT doc_id, i, n, w[i : i + n - 1] AS g FROM doc, size, unnest(range(1, len(w) - n + 2)) AS u(i)),
hit AS (SELECT occ.doc_id, occ.i, occ.n, win.item_id FROM occ JOIN win USING (g)),
word AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, i, n FROM hit) h, unnest(range(i, i + n)) AS u(p) GROUP BY doc_id),
name AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT doc_id, coalesce(len(w), 0)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN word USING (doc_id) LEFT JOIN name USING (doc_id)""".replace("LOWERED", SQL_LOWER.format("coalesce(text, '')"))


@query
def op4_language_id(spark, sf_dir):
    """Language of every document, learnt from the documents that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    model = language_id.train(docs.filter(~language_id.held_out()))
    out = language_id.identify(docs, model, ["doc_id"])
    return out.select("rest.doc_id", language_id.held_out("rest.doc_id").alias("held_out"), "lang_pred", "score", "rejected")


@query
def op9_html_extract(spark, sf_dir):
    """Main text of every page."""
    out = html_extract.extract(table(spark, sf_dir, "pages"), ["page_id", "url"])
    return out.select("rest.page_id", "rest.url", "text", F.char_length("text").cast("long").alias("n_chars"))


@query
def op10_suffix_dedup(spark, sf_dir):
    """Bytes of every document in a string of 100 bytes that starts earlier in the corpus."""
    out = suffix_dedup.deduplicate(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: x - a)
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), (F.size("spans") / 2).cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query
def op6_jaccard_join(spark, sf_dir):
    """Near-duplicate class and number of links of every document: five-word shingles, similarity 0.8 or more."""
    return jaccard_join.similarity_classes(table(spark, sf_dir, "documents"))


ORACLES["op6_jaccard_join"] = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(LOWERED, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g FROM w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS u(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM g AS a JOIN g AS b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT x, y FROM common JOIN n AS nx ON nx.doc_id = x JOIN n AS ny ON ny.doc_id = y WHERE c >= 0.8 * (nx.n + ny.n - c) - 1e-9),
reach(x, r) AS (SELECT doc_id, doc_id FROM documents UNION SELECT link.y, reach.r FROM reach JOIN link USING (x)),
class AS (SELECT x AS doc_id, min(r) AS class_id FROM reach GROUP BY x),
links AS (SELECT x AS doc_id, count(*) AS n_links FROM link GROUP BY x)
SELECT doc_id, class_id, coalesce(n_links, 0) AS n_links, coalesce(n, 0) AS n_shingles
FROM documents JOIN class USING (doc_id) LEFT JOIN links USING (doc_id) LEFT JOIN n USING (doc_id)""".replace("LOWERED", SQL_LOWER.format("coalesce(text, '')"))

ORACLES["op10_suffix_dedup"] = """
WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
win AS (SELECT doc_id, p, substr(h, 2 * p + 1, 200) AS s FROM b, unnest(range(0, n - 99)) AS u(p)),
later AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY s ORDER BY doc_id, p) AS r FROM win) WHERE r > 1),
step AS (SELECT doc_id, p, coalesce(p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) > 100, true) AS fresh FROM later),
run AS (SELECT doc_id, min(p) AS a, max(p) + 100 AS e FROM (SELECT *, sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM step) GROUP BY doc_id, k),
cut AS (SELECT *, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM run),
kept AS (SELECT doc_id, sum(e - a)::BIGINT AS n_removed, count(*) AS n_spans, max(e) AS last, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS front
  FROM cut JOIN b USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(front || substr(h, 2 * last + 1), h))) AS kept_sha256
FROM b LEFT JOIN kept USING (doc_id)"""


@query
def op11_resample(spark, sf_dir):
    """A tenth of the documents with 20 words or more, drawn by importance for the benchmark's distribution of words."""
    out = resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


#: CRC-32 bit by bit, once for each distinct word.
ORACLES["op11_resample"] = r"""
WITH doc AS (SELECT doc_id, coalesce(regexp_extract_all(LOWERED, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
goal AS (SELECT unnest(regexp_extract_all(LOWERED, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
word AS (SELECT row_number() OVER () AS r, doc_id, u AS w FROM doc, unnest(w) AS x(u)),
spelled AS (SELECT w, hex(encode(w)) AS h FROM (SELECT w FROM word UNION SELECT w FROM goal)),
crc AS (SELECT w, xor(list_reduce(list_transform(range(1, length(h), 2), lambda i: ('0x' || substr(h, i, 2))::BIGINT),
    lambda c, b: list_reduce(range(8),
      lambda x, _: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, xor(c, b)), 4294967295::BIGINT), 4294967295) % 10000 AS b FROM spelled),
raw AS (SELECT b, count(*) AS s FROM word JOIN crc USING (w) GROUP BY b),
want AS (SELECT b, count(*) AS t FROM goal JOIN crc USING (w) GROUP BY b),
total AS (SELECT (SELECT count(*) FROM word)::DOUBLE AS s, (SELECT count(*) FROM goal)::DOUBLE AS t),
gain AS (SELECT b, floor(1000 * ln((coalesce(want.t, 0)::DOUBLE + 1) * (total.s + 10000) / ((raw.s::DOUBLE + 1) * (total.t + 10000))))::BIGINT AS g
  FROM raw LEFT JOIN want USING (b), total),
mean AS (SELECT doc_id, floor(sum(g)::DOUBLE / count(*))::BIGINT AS weight FROM word JOIN crc USING (w) JOIN gain USING (b) GROUP BY doc_id),
scored AS (SELECT doc_id, len(w) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0)
    + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM doc LEFT JOIN mean USING (doc_id)),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN r <= 10 * n // 100 THEN r END AS rank FROM scored LEFT JOIN ranked USING (doc_id)""".replace("LOWERED", SQL_LOWER.format("coalesce(text, '')"))


@query
def op12_sentencepiece(spark, sf_dir):
    """Ids and decoded text of every document under the piece vocabulary, as digests."""
    out = sentencepiece_bpe.encode(table(spark, sf_dir, "documents"), decoded=True)
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                      F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op13_whitening(spark, sf_dir):
    """Whitened coordinates of every clean vector on 32 directions, with the checks of the fit."""
    vectors = table(spark, sf_dir, "embeddings")
    model = whitening.fit(vectors)
    white = whitening.whiten(vectors, model)
    error = whitening.identity_error(white, model)
    shares = F.array(*[F.lit(float(e)) for e in (model.explained if model else ())]).cast("array<double>")
    rows = white.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return rows.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n if model else None).cast("long").alias("n"),
                       F.col("deviation").try_cast("long").alias("deviation"), "whitened", F.get(shares, "at").alias("explained"),
                       F.lit(error).cast("double").alias("identity_error"))
