"""Detection of a whole detector set on one text column, and redaction built on it.

Everything is one row-local expression: no shuffle, no Python per row.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import Column, DataFrame, functions as F

from sladd.functions import filters, spans as S
from sladd.functions.context import boosted, has_context, preceding_tokens
from sladd.functions.text import escape_regex, in_words, let, literal_array, not_blank, sql_text
from sladd.functions.validators import apply_validation, verdict
from sladd.rules.detectors import DETECTORS
from sladd.rules.entities import SCORE_THRESHOLD
from sladd.rules.words import DEFAULT_LEXICON

_RICH = S.RICH_TYPE


class RuleTable:
    """Detectors flattened to numbered rules: one per pattern, word list or name list."""

    def __init__(self, detectors, lexicon):
        self.detectors, self.lexicon = tuple(detectors), lexicon
        # names out of a table come with the unit, the others are searched here
        self.listed = lexicon.known is not None and any(d.scope == "names" for d in self.detectors)
        self.word_scopes = ("words",) if lexicon.known else ("words", "names")
        self.rules = []  # (number of the detector, base score)
        self.first = []  # number of the first rule of each detector
        for i, d in enumerate(self.detectors):
            self.first.append(len(self.rules))
            self.rules += [(i, p.score) for p in d.patterns] or [(i, d.score)]

    def scoped(self, *scopes):
        return [(i, d) for i, d in enumerate(self.detectors) if d.scope in scopes]

    def detector(self, rule: Column) -> Column:
        return F.element_at(literal_array([i for i, _ in self.rules], "int"), rule + 1)

    def base(self, rule: Column) -> Column:
        return F.element_at(literal_array([s for _, s in self.rules], "double"), rule + 1)

    def entity(self, detector: Column) -> Column:
        return F.element_at(literal_array([d.entity for d in self.detectors], "string"), detector + 1)

    def patterns(self, scoped):
        """Rule numbers and patterns of some detectors."""
        return zip(*[(self.first[i] + k, "(?iU)" + (p.java or p.regex)) for i, d in scoped for k, p in enumerate(d.patterns)])


def _numbered_hits(text, scoped, table, offset=lambda start: start):
    numbers, regexes = table.patterns(scoped)
    rule = literal_array(numbers, "int")
    return F.transform(
        S.matches(text, regexes),
        lambda h: S.hit(F.element_at(rule, h["rule"] + 1), offset(h["start"]), h["chunk"]),
    )


def _digit_hits(view, table):
    """Number-like detectors on the short view of the text, mapped back to source offsets."""
    hits = _numbered_hits(
        view["text"], table.scoped("digits"), table, lambda start: S.source_offset(start, view["marks"])
    )
    return F.when(view["text"] != "", hits).otherwise(S.empty(S.HIT_TYPE))


def _present_words(text: Column, vocabulary) -> Column:
    """Which words of a lower-case vocabulary occur in a text: one set lookup per token."""
    tokens = F.split(F.lower(text), r"(?U)\W+")
    return F.array_distinct(F.filter(tokens, lambda t: t.isin(sorted(vocabulary))))


def name_vocabulary(names) -> set:
    """Every word that can start or continue a listed name."""
    return {word for name in names for word in re.findall(r"\w+", name.lower())}


def _words_pattern(alternatives: Column) -> Column:
    """Whole-word pattern of the given alternatives in their order; null when there are none."""
    body = F.concat(F.lit(r"(?iU)\b(?:"), F.array_join(alternatives, "|"), F.lit(r")\b"))
    return F.when(F.size(alternatives) > 0, body)


def _name_alternatives(words: Column, names) -> Column:
    """Listed names that can occur given the words present; longer names first, as they win."""
    lower = {n.lower() for n in names}
    single = {n for n in lower if re.fullmatch(r"\w+", n)}
    longer = [sql_text(escape_regex(n)) for n in sorted(lower - single, key=lambda n: (-len(n), n))]
    known = F.filter(words, lambda w: in_words(w, single))
    if not longer:
        return known
    # a constant, so the names are split once and not for every text
    cut = F.expr("array(" + ", ".join(f"struct({n} AS name, split({n}, '(?U)\\\\W+') AS words)" for n in longer) + ")")
    possible = F.filter(cut, lambda n: F.forall(n["words"], lambda w: (w == "") | F.array_contains(words, w)))
    return F.concat(F.transform(possible, lambda n: n["name"]), known)


def _listed_hits(listed, table):
    """Names that a table of names has found already."""

    def of_rule(number):
        return F.transform(listed, lambda r: S.hit(F.lit(number), r["start"], r["chunk"]))

    return F.concat(*[of_rule(table.first[i]) for i, _ in table.scoped("names")])


def _word_level_hits(text, words, table):
    """Word lists and names, searched only for what is present, so the cost does not grow with the lists."""
    scoped = table.scoped(*table.word_scopes)
    rule = literal_array([table.first[i] for i, _ in scoped], "int")

    def among(own):
        return F.filter(words, lambda w: in_words(w, own))

    patterns = [
        _words_pattern(
            _name_alternatives(words, table.lexicon.names) if d.scope == "names" else among({w.lower() for w in d.words})
        )
        for _, d in scoped
    ]
    hits = F.transform(
        S.matches(text, patterns), lambda h: S.hit(F.element_at(rule, h["rule"] + 1), h["start"], h["chunk"])
    )
    return F.when(F.size(words) > 0, hits).otherwise(S.empty(S.HIT_TYPE))


def _score(text, hit, detector, table, use_context, cut):
    """Validated and boosted score; null when the validator rejects the hit."""
    valid = F.lit(None).cast("boolean")
    for i, d in enumerate(table.detectors):
        check = "list_name" if d.scope == "names" else d.validator
        if check:
            valid = F.when(detector == i, verdict(check, hit["chunk"], table.lexicon)).otherwise(valid)
    with_words = [(i, d) for i, d in enumerate(table.detectors) if d.context]

    def raise_(score):
        if not (use_context and with_words):
            return score

        def look(window):
            near = F.lit(False)
            for i, d in with_words:
                near = F.when(detector == i, has_context(window, d.context)).otherwise(near)
            return F.when(near, boosted(score)).otherwise(score)

        # A full score cannot rise and a rejected hit must not, so no window is read for those.
        return F.when(score < 1.0, let(preceding_tokens(text, hit["start"], cut=cut), look)).otherwise(score)

    return let(let(valid, lambda v: apply_validation(v, table.base(hit["rule"]))), raise_)


class Stages:
    """Steps from a text to its final spans. Each maps a struct Column to the next one.

    Steps are projections of their own: an intermediate result is computed once, and expressions stay shallow,
    which the analyzer needs. A unit starts as ``struct<text, external>``; blank text has no spans.
    """

    def __init__(self, detectors=DETECTORS, lexicon=DEFAULT_LEXICON, use_context: bool = True):
        self.table = RuleTable(detectors, lexicon)
        self.lexicon, self.use_context = lexicon, use_context

    @staticmethod
    def unit(text: Column, external: Column | None = None, listed: Column | None = None) -> Column:
        extra = S.empty(S.SPAN_TYPE) if external is None else F.coalesce(external, S.empty(S.SPAN_TYPE))
        fields = [F.when(not_blank(text), S.guard(text)).alias("text"), extra.alias("external")]
        return F.struct(*fields, *([] if listed is None else [listed.alias("listed")]))

    def views(self, u: Column) -> Column:
        """The short view around digits and the listed words that occur."""
        vocabulary = set()
        for _, d in self.table.scoped(*self.table.word_scopes):
            vocabulary |= name_vocabulary(self.lexicon.names) if d.scope == "names" else {w.lower() for w in d.words}
        fields = [u["text"].alias("text"), u["external"].alias("external")]
        if self.table.listed:
            fields.append(u["listed"].alias("listed"))
        if self.table.scoped("digits"):
            fields.append(S.digit_view(u["text"]).alias("view"))
        if vocabulary:
            fields.append(_present_words(u["text"], vocabulary).alias("words"))
        return F.struct(*fields)

    def hits(self, u: Column) -> Column:
        """Hits of all rules, as they are found."""
        text, parts = u["text"], []
        if self.table.scoped("digits"):
            parts.append(_digit_hits(u["view"], self.table))
        if self.table.listed:
            parts.append(_listed_hits(u["listed"], self.table))
        if self.table.scoped(*self.table.word_scopes):
            parts.append(_word_level_hits(text, u["words"], self.table))
        for i, d in self.table.scoped("text"):
            found = _numbered_hits(text, [(i, d)], self.table)
            parts.append(F.when(text.contains(d.needs), found).otherwise(S.empty(S.HIT_TYPE)) if d.needs else found)
        found = F.concat(*parts) if len(parts) > 1 else parts[0]
        return F.struct(text.alias("text"), u["external"].alias("external"), found.alias("hits"))

    def scores(self, u: Column) -> Column:
        """Validated, boosted spans at or above the threshold, with their text; outside spans join here."""
        text = u["text"]

        def scored(cut):
            def finish(h):
                return let(
                    self.table.detector(h["rule"]),
                    lambda d: F.struct(
                        self.table.entity(d).alias("entity"), h["start"].alias("start"),
                        (h["start"] + F.length(h["chunk"])).alias("end"),
                        _score(text, h, d, self.table, self.use_context, cut).alias("score"),
                        F.lit(0).alias("src"), h["chunk"].alias("chunk"),
                    ),
                )

            def outside(s):
                return F.struct(
                    s["entity"].alias("entity"), s["start"].alias("start"), s["end"].alias("end"),
                    s["score"].alias("score"), s["src"].alias("src"),
                    cut(s["start"], s["end"] - s["start"]).alias("chunk"),
                )

            usable = F.filter(u["external"], lambda s: s["end"] > s["start"])
            spans = F.concat(F.transform(u["hits"], finish), F.transform(usable, outside))
            return F.filter(spans, lambda s: s["score"] >= SCORE_THRESHOLD)

        none = (F.size(u["hits"]) == 0) & (F.size(u["external"]) == 0)
        return F.when(none | text.isNull(), S.empty(_RICH)).otherwise(S.with_slices(text, scored))

    @staticmethod
    def resolved(spans: Column) -> Column:
        return F.when(F.size(spans) < 2, spans).otherwise(S.resolve(spans, _RICH))

    def filtered(self, spans: Column) -> Column:
        return filter_spans(spans, self.lexicon)

    def upto(self, last: str):
        names = ("views", "hits", "scores", "resolved", "filtered")
        return [getattr(self, n) for n in names[: names.index(last) + 1]]


@lru_cache(maxsize=256)
def _stage_columns(app: str, column: str, many: bool, last: str, detectors, lexicon, use_context: bool):
    """The projections of all steps. Building them takes thousands of driver calls, so they are kept."""
    steps = Stages(detectors, lexicon, use_context).upto(last)
    return [F.transform(F.col(column), step) if many else step(F.col(column)) for step in steps]


def run_stages(df: DataFrame, units: Column, column: str, many: bool = False, last: str = "filtered",
               detectors=DETECTORS, lexicon=DEFAULT_LEXICON, use_context: bool = True) -> DataFrame:
    """Add ``column``: spans of one unit, or with ``many`` an array of spans per unit of an array."""
    app = df.sparkSession.sparkContext.applicationId
    out = df.withColumn(column, units)
    for step in _stage_columns(app, column, many, last, tuple(detectors), lexicon, use_context):
        out = out.withColumn(column, step)
    return out


def filter_spans(spans: Column, lexicon=DEFAULT_LEXICON) -> Column:
    """Apply the false-positive rules; the result no longer carries the matched text."""

    def judge(span):
        lead = F.length(F.regexp_extract(span["chunk"], r"(?U)^\s*", 0))

        def measured(trimmed):
            def final(kept):
                end = F.when(kept == F.length(trimmed), span["end"]).otherwise(span["start"] + lead + kept)
                return F.struct(
                    span["entity"].alias("entity"), span["start"].alias("start"), end.alias("end"),
                    span["score"].alias("score"), span["src"].alias("src"),
                )

            return let(filters.kept_length(span["entity"], trimmed, lexicon), final)

        return let(F.regexp_replace(span["chunk"], r"(?U)^\s+|\s+$", ""), measured)

    return F.filter(F.transform(spans, judge), lambda s: s["end"].isNotNull())


def with_spans(df: DataFrame, text: str = "text", detectors=DETECTORS, lexicon=DEFAULT_LEXICON,
               external: str | None = None, column: str = "spans", last: str = "filtered",
               use_context: bool = True, names=None) -> DataFrame:
    """Add the spans of a text column: final ones, or those after an earlier step.

    ``last="scores"`` gives all candidates, ``last="resolved"`` those left by overlap resolution; both carry
    the matched text as ``chunk``. ``names`` (operators.lexicons.NameTable) replaces the names of the lexicon by a table.
    """
    ext = F.col(external) if external else None
    if names is None:
        return run_stages(df, Stages.unit(F.col(f"`{text}`"), ext), column, False, last, detectors, lexicon, use_context)
    units = Stages.unit(F.col(f"`{text}`"), ext, F.col(names.LISTED))
    done = run_stages(names.attach(df, text), units, column, False, last, detectors, names.lexicon(lexicon), use_context)
    return done.drop(names.LISTED, names.EXACT)


def own_placeholders(detectors) -> dict:
    return {d.entity: d.placeholder for d in detectors if d.placeholder}


def anonymize(df: DataFrame, text: str = "text", detectors=DETECTORS, lexicon=DEFAULT_LEXICON,
              external: str | None = None, keep_spans: bool = True, names=None) -> DataFrame:
    """Replace ``text`` by ``redacted``, add ``spans`` and the number of replacements ``n``.

    Spans are a projection of their own, so they are computed once and what is not asked for is pruned. ``names``
    (operators.lexicons.NameTable) gives a list of names of any length.
    """
    found = with_spans(df, text, detectors, lexicon, external, "spans", names=names)
    rest = [c for c in df.columns if c not in (text, external)]
    redacted = S.redact(F.col(f"`{text}`"), F.col("spans"), own_placeholders(detectors))
    shown = ["spans"] if keep_spans else []
    return found.select(*rest, redacted.alias("redacted"), *shown, F.size("spans").cast("bigint").alias("n"))

