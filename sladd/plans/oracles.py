"""DuckDB texts for the registered queries: the same results, reached another way.

Hits come from full-text ``regexp_extract_all`` passes, checksums from list arithmetic, overlap resolution from
a recursive fold over score ranks, redaction from an ordered string aggregate.
"""

from __future__ import annotations

from sladd.functions import validators as V
from sladd.plans.fixtures import fixture_sql
from sladd.rules import words as W
from sladd.rules.detectors import BY_KEY, DETECTORS, GENERAL
from sladd.rules.entities import CONTEXT_BOOST, DEFAULT_PLACEHOLDER, ENTITY_TO_PLACEHOLDER, SCORE_THRESHOLD
from sladd.rules.words import DEFAULT_LEXICON

TABLES = ("orders", "customer", "pages", "documents", "conversations", "part", "supplier", "nation", "region")


def fx(name: str) -> str:
    """A fixture as DuckDB SQL."""
    return fixture_sql(name, "duckdb").format(**{t: t for t in TABLES})


def q(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def values(words) -> str:
    return "(" + ", ".join(q(w) for w in sorted(words)) + ")"


# RE2 knows ASCII word edges only. These letters become '_', a word character that no detector pattern names.
_FOREIGN = "[À-ÄÇ-ÖÙ-ßà-äç-öù-ɏ]"
_WORD = r"[\p{L}\p{M}\p{N}_]"
_STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"


def _weighted(digits: str, weights) -> str:
    table = ", ".join(map(str, weights))
    return (
        f"list_sum(list_transform(range(1, {len(weights)} + 1), lambda i: "
        f"TRY_CAST(substr({digits}, CAST(i AS INT), 1) AS INT) * [{table}][i]))"
    )


def _digit(digits: str, i: int) -> str:
    return f"TRY_CAST(substr({digits}, {i}, 1) AS INT)"


def valid_sql(name: str, chunk: str = "chunk") -> str:
    """True, false or null for a chunk; checksums as true or false."""
    d = rf"regexp_replace({chunk}, '\D', '', 'g')"
    if name == "national_id":
        day, month = f"TRY_CAST(substr({d}, 1, 2) AS INT)", f"TRY_CAST(substr({d}, 3, 2) AS INT)"
        k1 = f"(11 - {_weighted(d, (3, 7, 6, 1, 8, 9, 4, 5, 2))} % 11) % 11"
        k2 = f"(11 - {_weighted(d, (5, 4, 3, 2, 7, 6, 5, 4, 3, 2))} % 11) % 11"
        return (
            f"(length({d}) = 11 AND ({day} BETWEEN 1 AND 31 OR {day} BETWEEN 41 AND 71) AND ({month} BETWEEN 1 AND 12 "
            f"OR {month} BETWEEN 21 AND 32 OR {month} BETWEEN 41 AND 52) AND {k1} = {_digit(d, 10)} "
            f"AND {k2} = {_digit(d, 11)})"
        )
    if name == "org_number":
        k = f"(11 - {_weighted(d, (3, 2, 7, 6, 5, 4, 3, 2))} % 11) % 11"
        return f"(length({d}) = 9 AND substr({d}, 1, 1) IN ('8', '9') AND {k} = {_digit(d, 9)})"
    if name == "card":
        x = f"CAST(substr({d}, CAST(length({d}) - i AS INT), 1) AS INT)"
        total = (
            f"list_sum(list_transform(range(0, length({d})), lambda i: CASE WHEN i % 2 = 0 THEN {x} "
            f"WHEN {x} * 2 > 9 THEN {x} * 2 - 9 ELSE {x} * 2 END))"
        )
        return f"(length({d}) BETWEEN 13 AND 19 AND {total} % 10 = 0)"
    if name == "ipv6":
        t = rf"regexp_replace(lower({chunk}), {q(V.IPV4_TAIL)}, ':0:0')"
        sides, n = f"string_split({t}, '::')", f"len(regexp_extract_all({t}, '[0-9a-f]+'))"
        plain = f"len(list_filter({sides}, lambda s: s <> '' AND NOT regexp_matches(s, {q(V.IPV6_GROUPS)}))) = 0"
        return f"CASE WHEN NOT ({plain} AND CASE len({sides}) WHEN 1 THEN {n} = 8 WHEN 2 THEN {n} BETWEEN 1 AND 7 ELSE false END) THEN false END"
    if name == "iban":
        code = f"upper(replace({chunk}, ' ', ''))"
        turned = f"(substr({code}, 5) || substr({code}, 1, 4))"
        vals = (
            f"list_transform(string_split({turned}, ''), lambda c: CASE WHEN c BETWEEN 'A' AND 'Z' "
            f"THEN ascii(c) - 55 ELSE ascii(c) - 48 END)"
        )
        rest = (
            f"list_reduce(list_concat([0], {vals}), lambda r, v: CASE WHEN v > 9 THEN (r * 100 + v) % 97 "
            f"ELSE (r * 10 + v) % 97 END)"
        )
        return f"(regexp_matches({code}, '^[A-Z]{{2}}[0-9]{{2}}[A-Z0-9]{{11,30}}$') AND {rest} = 1)"
    if name == "nhs":
        k = f"(11 - {_weighted(d, range(10, 1, -1))} % 11) % 11"
        return f"(length({d}) = 10 AND {k} = {_digit(d, 10)})"
    if name == "abn":
        return f"(length({d}) = 11 AND ({_weighted(d, (10, 1, 3, 5, 7, 9, 11, 13, 15, 17, 19))} - 10) % 89 = 0)"
    if name == "acn":
        return f"(length({d}) = 9 AND (10 - {_weighted(d, range(8, 0, -1))} % 10) % 10 = {_digit(d, 9)})"
    if name == "dea":
        return f"(length({d}) = 7 AND {_weighted(d, (1, 2, 1, 2, 1, 2))} % 10 = {_digit(d, 7)})"
    if name == "ssn":
        return f"CASE WHEN regexp_matches({chunk}, '^(000|666|9)|-00-|-0000$') THEN false END"
    if name == "phone_length":
        return f"CASE WHEN length({d}) NOT BETWEEN 8 AND 15 THEN false END"
    if name == "postal_city":
        city = rf"string_split_regex({_STRIP.format(chunk)}, '\s+')[2]"
        return (
            f"CASE WHEN {city} IS NULL THEN NULL WHEN {upper_sql(city)} THEN false "
            f"WHEN lower({city}) IN {values(W.COMMON_WORDS)} THEN false ELSE true END"
        )
    if name == "list_name":
        return f"CASE WHEN lower({_STRIP.format(chunk)}) IN {values(W.COMMON_WORDS)} THEN false END"
    raise ValueError(name)


_CHECKSUMS = ("national_id", "org_number", "card", "iban", "nhs", "abn", "acn", "dea")


def upper_sql(x: str) -> str:
    return f"({x} = upper({x}) AND {x} <> lower({x}))"


def check_of(d) -> str | None:
    return "list_name" if d.scope == "names" else d.validator


# --- candidates -------------------------------------------------------------------------------------------------


def _pattern_rows(det: int, d, regex: str, score: float) -> str:
    source = "text" if d.key == "email" else "mt"
    return (
        f"SELECT unit_id, {det} AS det, {score}::DOUBLE AS base, regexp_extract_all({source}, {q('(?i)' + regex)}) AS ms, "
        f"string_split_regex({source}, {q('(?i)' + regex)}) AS gs FROM src WHERE regexp_matches({source}, {q('(?i)' + regex)})"
    )


def _name_rows(det: int, d) -> str:
    """Names over one word or two, from the token table; the second word of a taken pair is no start."""
    single = [n.lower() for n in DEFAULT_LEXICON.names if n.replace("-", " ").count(" ") == 0]
    double = [n.lower() for n in DEFAULT_LEXICON.names if n.replace("-", " ").count(" ") == 1]
    return (
        "SELECT unit_id, " + f"{det} AS det, {d.score}::DOUBLE AS base, start, chunk FROM (SELECT *, "
        "coalesce(lag(pair) OVER (PARTITION BY unit_id ORDER BY start), false) AS taken FROM (SELECT t.unit_id, t.start, "
        f"coalesce(lower(t.two) IN {values(double)}, false) AS pair, "
        f"CASE WHEN lower(t.two) IN {values(double)} THEN t.two WHEN lower(t.one) IN {values(single)} THEN t.one END AS chunk "
        "FROM tok t)) WHERE chunk IS NOT NULL AND NOT (taken AND NOT pair)"
    )


def candidate_ctes(source: str, detectors, use_context: bool = True, threshold: bool = True) -> list:
    """``src`` and ``cand(unit_id, det, entity, start, "end", chunk, score, src)``."""
    detectors = list(detectors)
    rows = [
        _pattern_rows(i, d, p.regex, p.score) for i, d in enumerate(detectors) for p in d.patterns
    ] + [
        _pattern_rows(i, d, r"\b(?:" + "|".join(sorted(d.words, key=len, reverse=True)) + r")\b", d.score)
        for i, d in enumerate(detectors) if d.words
    ]
    ctes = [("src", f"SELECT unit_id, text, regexp_replace(text, '{_FOREIGN}', '_', 'g') AS mt FROM ({source}) AS s0")]
    parts = []
    if rows:
        ctes.append(("m", " UNION ALL ".join(rows)))
        ctes.append((
            "n",
            "SELECT unit_id, det, base, CAST(list_sum(list_transform(gs[1:i], lambda g: length(g))) + coalesce(list_sum("
            "list_transform(ms[1:i - 1], lambda g: length(g))), 0) AS BIGINT) AS start, length(ms[i]) AS size FROM ("
            "SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM m) AS u",
        ))
        parts.append("SELECT n.unit_id, det, base, start, substr(text, start + 1, size) AS chunk FROM n JOIN src USING (unit_id)")
    named = [(i, d) for i, d in enumerate(detectors) if d.scope == "names"]
    if named:
        ctes += token_ctes()
        parts += [_name_rows(i, d) for i, d in named]
    ctes.append(("hit", " UNION ALL ".join(parts)))
    valid = "CASE " + " ".join(
        f"WHEN det = {i} THEN " + (f"CASE WHEN {valid_sql(check_of(d))} THEN true END" if check_of(d) in _CHECKSUMS
                                    else f"({valid_sql(check_of(d))})")
        for i, d in enumerate(detectors) if check_of(d)
    ) + " ELSE NULL END" if any(check_of(d) for d in detectors) else "CAST(NULL AS BOOLEAN)"
    entity = "CASE det " + " ".join(f"WHEN {i} THEN {q(d.entity)}" for i, d in enumerate(detectors)) + " END"
    ctes.append((
        "scored",
        f"SELECT hit.unit_id, det, {entity} AS entity, start, start + length(chunk) AS \"end\", chunk, "
        f"CASE WHEN ({valid}) IS NULL THEN base WHEN ({valid}) THEN 1.0::DOUBLE END AS score0 FROM hit",
    ))
    with_words = [(i, d) for i, d in enumerate(detectors) if d.context]
    boost = "score0"
    if use_context and with_words:
        near = "CASE det " + " ".join(
            f"WHEN {i} THEN len(list_filter([{', '.join(q(w) for w in d.context)}], lambda w: contains(win, w))) > 0"
            for i, d in with_words
        ) + " ELSE false END"
        boost = f"CASE WHEN {near} THEN least(1.0::DOUBLE, greatest(score0 + {CONTEXT_BOOST}::DOUBLE, 0.4::DOUBLE)) ELSE score0 END"
    ctes.append((
        "cand",
        f"SELECT * FROM (SELECT unit_id, det, entity, start, \"end\", chunk, 0 AS src, {boost} AS score FROM (SELECT scored.*, "
        "array_to_string(list_filter(string_split_regex(lower(substr(text, 1, start)), '\\s+'), lambda t: t <> '')[-5:], chr(10)) AS win "
        "FROM scored JOIN src USING (unit_id) WHERE score0 IS NOT NULL)) "
        + (f"WHERE score >= {SCORE_THRESHOLD}" if threshold else ""),
    ))
    return ctes


def token_ctes() -> list:
    """``tok(unit_id, start, one, two)``: every word, and the text from it to the end of the next word."""
    return [
        ("tk", f"SELECT unit_id, text, regexp_extract_all(text, '{_WORD}+') AS ms, string_split_regex(text, '{_WORD}+') AS gs FROM src"),
        ("tl", "SELECT unit_id, text, unnest(list_transform(range(1, len(ms) + 1), lambda i: {'i': i, 'one': ms[i], 'g': gs[i]}), recursive := true) FROM tk"),
        ("ts", "SELECT unit_id, text, one, CAST(sum(length(g) + length(one)) OVER (PARTITION BY unit_id ORDER BY i) - length(one) AS BIGINT) AS start FROM tl"),
        ("tok", "SELECT unit_id, start, one, substr(text, start + 1, lead(start + length(one)) OVER (PARTITION BY unit_id ORDER BY start) - start) AS two FROM ts"),
    ]


def resolve_ctes(cand: str = "cand") -> list:
    """``kept``: the rows of ``cand`` that survive greedy overlap resolution."""
    return [
        ("ranked", f"SELECT *, row_number() OVER (PARTITION BY unit_id ORDER BY score DESC, src, start, \"end\" DESC, entity) AS rn FROM {cand}"),
        ("fold", "SELECT unit_id, rn, [{'s': start, 'e': \"end\", 'r': rn}] AS ks FROM ranked WHERE rn = 1 UNION ALL "
                 "SELECT c.unit_id, c.rn, CASE WHEN len(list_filter(f.ks, lambda k: greatest(k.s, c.start) < least(k.e, c.\"end\"))) > 0 "
                 "THEN f.ks ELSE list_append(f.ks, {'s': c.start, 'e': c.\"end\", 'r': c.rn}) END "
                 "FROM fold f JOIN ranked c ON c.unit_id = f.unit_id AND c.rn = f.rn + 1"),
        ("last_fold", "SELECT unit_id, arg_max(ks, rn) AS ks FROM fold GROUP BY unit_id"),
        ("kept", "SELECT r.* FROM ranked r JOIN (SELECT unit_id, unnest(list_transform(ks, lambda k: k.r)) AS rn FROM last_fold) k "
                 "ON k.unit_id = r.unit_id AND k.rn = r.rn"),
    ]


# --- false-positive rules ---------------------------------------------------------------------------------------

_SUFFIX = q("(?i)(?:" + "|".join(W.COMPOUND_SUFFIXES) + ")$")
_DENIED = values(set(W.COMMON_WORDS) | set(W.PROPERTY_WORDS))
_NAMES = values(DEFAULT_LEXICON.names)
_P = "entity IN ('PERSON', 'NRP')"
_L = "entity = 'LOCATION'"
_MULTI = "contains(c, ' ')"
_TOK = r"string_split_regex(c, '\s+')"
_TAIL = "regexp_replace(c, '[.,;:!?\\-]+$', '')"
_BARE = rf"regexp_replace(t, '[^\p{{L}}\p{{M}}\p{{N}}_]', '', 'g')"
_NAMELIKE = (
    "((substr(t, 1, 1) = upper(substr(t, 1, 1)) AND substr(t, 1, 1) <> lower(substr(t, 1, 1))) "
    f"OR lower(t) IN {values(W.NAME_PARTICLES)})"
)
_ALL_NAMES = f"len(list_filter({_TOK}, lambda t: NOT {_NAMELIKE})) = 0"
_BAD_TOKEN = f"(lower({_BARE}) IN {_DENIED} OR regexp_matches({_BARE}, {_SUFFIX}))"

RULE_SQL = {
    "year": f"(entity IN ('LOCATION', 'NO_ADDRESS') AND regexp_matches(c, '^(19|20)[0-9][0-9]$'))",
    "year_start": r"(entity = 'NO_ADDRESS' AND regexp_matches(c, '^(19|20)[0-9][0-9]\b'))",
    "id_code": f"(({_P} OR {_L}) AND regexp_matches(c, '^[A-Za-z]{{1,4}}[-/][0-9]{{1,6}}[A-Za-z]?$'))",
    "all_caps": f"({_P} AND length(c) >= 2 AND {upper_sql('c')})",
    "denylist": f"({_P} AND lower(c) IN {_DENIED})",
    "short_token": f"({_P} AND NOT {_MULTI} AND length(c) <= 4 AND c NOT IN {_NAMES})",
    "compound_noun": f"({_P} AND NOT {_MULTI} AND regexp_matches(c, {_SUFFIX}))",
    "not_capitalised": f"({_P} AND {_MULTI} AND NOT ({_ALL_NAMES}))",
    "denied_token": f"({_P} AND {_MULTI} AND len(list_filter({_TOK}, lambda t: {_BAD_TOKEN})) > 0)",
    "latin_ext_b": f"({_L} AND regexp_matches(c, '[\\x{{0180}}-\\x{{024F}}]'))",
    "private_use": f"({_L} AND regexp_matches(c, '[\\x{{E000}}-\\x{{F8FF}}]'))",
    "location_newline": f"({_L} AND contains(c, chr(10)))",
    "location_caps": f"({_L} AND length(c) <= 4 AND {upper_sql('c')})",
    "location_denylist": f"({_L} AND lower({_TAIL}) IN {_DENIED})",
    "location_suffix": f"({_L} AND NOT contains({_TAIL}, ' ') AND regexp_matches({_TAIL}, {_SUFFIX}))",
    "location_lower": f"({_L} AND {_MULTI} AND NOT ({_ALL_NAMES}))",
    "address_newline": "(entity = 'NO_ADDRESS' AND contains(c, chr(10)))",
    "date_preposition": "(entity = 'DATE_TIME' AND regexp_matches(c, "
                        + q(r"(?i)^(?:[A-Za-zÆØÅæøå]+\s+)?(?:" + "|".join(W.DATE_PREPOSITIONS) + r")\b") + "))",
}
_EARLY = ("year", "year_start", "id_code", "all_caps", "denylist", "short_token", "compound_noun")


def salvage_ctes(rows: str) -> list:
    """``judged``: rows with trimmed text ``c`` and the salvaged length ``cut`` (null if none)."""
    first_bad = f"list_position(list_transform({_TOK}, lambda t: {_NAMELIKE}), false)"
    return [
        ("trimmed", f"SELECT *, {_STRIP.format('chunk')} AS c FROM {rows}"),
        ("heads", f"SELECT *, CASE WHEN coalesce({first_bad}, 0) = 0 THEN len({_TOK}) ELSE {first_bad} - 1 END AS k FROM trimmed"),
        ("judged",
         f"SELECT *, CASE WHEN k > 0 AND len(list_filter({_TOK}[1:k], lambda t: {_BARE} IN {_NAMES})) > 0 "
         f"AND len(list_filter({_TOK}[1:k], lambda t: {_BAD_TOKEN})) = 0 THEN "
         f"CAST(list_sum(list_transform({_TOK}[1:k], lambda t: length(t))) + coalesce(list_sum(list_transform("
         rf"regexp_extract_all(c, '\s+')[1:k - 1], lambda t: length(t))), 0) AS BIGINT) END AS cut FROM heads"),
    ]


def filter_ctes(rows: str = "kept") -> list:
    """``spans``: what the false-positive rules leave of ``rows``."""
    early = " OR ".join(RULE_SQL[r] for r in _EARLY)
    late = " OR ".join(sql for r, sql in RULE_SQL.items() if r not in _EARLY and r != "not_capitalised")
    lead = r"length(regexp_extract(chunk, '^\s*'))"
    return [
        *salvage_ctes(rows),
        ("spans",
         f"SELECT unit_id, entity, start, CASE WHEN {RULE_SQL['not_capitalised']} THEN start + {lead} + cut ELSE \"end\" END AS \"end\", "
         f"score, src FROM judged WHERE NOT ({early}) AND CASE WHEN {RULE_SQL['not_capitalised']} THEN cut IS NOT NULL "
         f"ELSE NOT ({late}) END"),
    ]


def placeholder_sql(entity: str = "entity", extra: dict | None = None) -> str:
    table = {**ENTITY_TO_PLACEHOLDER, **(extra or {})}
    return f"CASE {entity} " + " ".join(f"WHEN {q(e)} THEN {q(p)}" for e, p in table.items()) + f" ELSE {q(DEFAULT_PLACEHOLDER)} END"


def redact_ctes(rows: str = "spans", extra: dict | None = None) -> list:
    """``redacted(unit_id, text, redacted, n)`` for every unit."""
    return [
        ("ordered", f"SELECT sp.*, text, coalesce(lag(sp.\"end\") OVER (PARTITION BY sp.unit_id ORDER BY start), 0) AS prev FROM {rows} sp JOIN src USING (unit_id)"),
        ("built", f"SELECT unit_id, string_agg(substr(text, prev + 1, start - prev) || {placeholder_sql('entity', extra)}, '' ORDER BY start) "
                  "|| substr(any_value(text), max(\"end\") + 1) AS redacted, count(*) AS n FROM ordered GROUP BY unit_id"),
        ("redacted", "SELECT src.unit_id, src.text, coalesce(built.redacted, src.text) AS redacted, coalesce(built.n, 0) AS n "
                     "FROM src LEFT JOIN built USING (unit_id)"),
    ]


def with_(ctes, final: str) -> str:
    return "WITH RECURSIVE " + ", ".join(f"{name} AS ({sql})" for name, sql in ctes) + " " + final


# --- assembled texts --------------------------------------------------------------------------------------------

HIT_COLUMNS = 'unit_id, entity, start, "end" AS stop, chunk, round(score, 4) AS score'


def detect_sql(source: str, keys) -> str:
    return with_([*candidate_ctes(source, [BY_KEY[k] for k in keys]), *resolve_ctes()], f"SELECT {HIT_COLUMNS} FROM kept")


def analysis_ctes(source: str, detectors=DETECTORS) -> list:
    return [*candidate_ctes(source, detectors), *resolve_ctes(), *filter_ctes()]


def analyze_sql(source: str, detectors=DETECTORS) -> str:
    return with_(analysis_ctes(source, detectors), 'SELECT unit_id, entity, start, "end" AS stop, round(score, 4) AS score FROM spans')


def redact_sql(source: str, detectors=DETECTORS, select="unit_id, redacted, n", extra=None) -> str:
    return with_([*analysis_ctes(source, detectors), *redact_ctes(extra=extra)], f"SELECT {select} FROM redacted")


DOCUMENTS = "SELECT doc_id AS unit_id, text FROM documents"
GENERAL_KEYS = tuple(d.key for d in GENERAL)
