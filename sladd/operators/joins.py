"""Lookups against lexicons that may be too long for an expression, and value propagation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sladd.functions import spans as S
from sladd.functions.text import let, strip
from sladd.plans.analyze import with_spans
from sladd.rules.detectors import DETECTORS
from sladd.rules.words import DEFAULT_LEXICON


# Word tables up to this length and this many characters are broadcast or become literals; both are counted first.
BROADCAST_WORDS = 200_000
BROADCAST_CHARS = 8_000_000


def is_short(words: DataFrame) -> bool:
    """Whether a one-column word table is small enough to be broadcast."""
    head = words.select(F.length(words.columns[0]).alias("n")).limit(BROADCAST_WORDS + 1)
    n, chars = head.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    return n <= BROADCAST_WORDS and chars <= BROADCAST_CHARS


def word_table(spark, words, column: str) -> DataFrame:
    return spark.createDataFrame([(w,) for w in sorted(words)], f"{column} string")


def name_list_join(df: DataFrame, names: DataFrame, unit: str = "unit_id", text: str = "text", longest: int | None = None,
                   salts: int = 16) -> DataFrame:
    """Words and word runs that are listed names, for lexicons of any length: ``unit, start, end, chunk``.

    Runs are as long as the longest listed name unless ``longest`` says otherwise; see :mod:`sladd.operators.lexicons`.
    """
    from sladd.operators.lexicons import name_hits  # it needs is_short

    return name_hits(df, names, unit, text, longest, salts)


def longest_name_first(hits: DataFrame, unit: str = "unit_id") -> DataFrame:
    """The longest hit per start; partial aggregation keeps one candidate per start and task."""
    return (
        hits.groupBy(unit, "start")
        .agg(F.max_by("chunk", F.length("chunk")).alias("chunk"))
        .select(unit, "start", (F.col("start") + F.length("chunk")).alias("end"), "chunk")
    )


def denylist_antijoin(candidates: DataFrame, denied: DataFrame, chunk: str = "chunk") -> DataFrame:
    """Candidates whose trimmed lower-case text is not a denied word."""
    keyed = candidates.withColumn("_key", F.lower(strip(F.col(chunk))))
    words = denied.select(F.lower("word").alias("_key")).distinct()
    if is_short(words):
        words = F.broadcast(words)
    return keyed.join(words, "_key", "left_anti").drop("_key")


def _escaped(value: Column) -> Column:
    return F.regexp_replace(value, r"([\\.\[\](){}*+?^$|])", r"\\$1")


def _alternation(values: Column) -> Column:
    """A pattern of all values, longer ones first; values with the same first character share a branch."""
    firsts = F.array_distinct(F.transform(values, lambda v: F.left(v, F.lit(1))))

    def branch(first):
        own = F.transform(F.filter(values, lambda v: v.startswith(first)), lambda v: F.struct((-F.length(v)).alias("size"), v.alias("value")))
        rest = F.transform(F.array_sort(own), lambda v: _escaped(F.substring(v["value"], 2, F.length(v["value"]))))
        return F.concat(_escaped(first), F.lit("(?:"), F.array_join(rest, "|"), F.lit(")"))

    return F.concat(F.lit("(?iu)(?:"), F.array_join(F.transform(firsts, branch), "|"), F.lit(")"))


def propagate_values(text: Column, spans: Column) -> Column:
    """Mask every occurrence of each detected value, not only the detected one, longer values first.

    Occurrences are searched without regard to case in the original text, so a placeholder is never masked
    again. A value takes the placeholder of its first span. An occurrence that lower-casing doesn't bring back
    to its value (such as a dotted capital I) is compared with each value by the pattern's own rules of case.
    """

    def run(clean):
        def values(found):
            def cut_out(cut):
                each = F.transform(found, lambda s, i: F.struct(
                    F.lower(strip(cut(s["start"], s["end"] - s["start"]))).alias("value"), i.alias("at"), s["entity"].alias("entity")))
                return F.array_sort(F.filter(each, lambda v: v["value"] != ""))

            def first_of_each(ordered):
                return F.filter(ordered, lambda v, i: (i == 0) | (F.get(ordered, i - 1)["value"] != v["value"]))

            return let(S.with_slices(clean, cut_out), first_of_each)

        def mask(known):
            def spans_of(table):
                def as_span(h):
                    alike = F.filter(known, lambda v: F.rlike(h["chunk"], F.concat(F.lit("(?iu)\\A"), _escaped(v["value"]), F.lit("\\z"))))
                    entity = F.coalesce(F.element_at(table, F.lower(h["chunk"])), F.get(alike, 0)["entity"], F.lit("UNKNOWN"))
                    return F.struct(
                        entity.alias("entity"), h["start"].alias("start"), (h["start"] + F.length(h["chunk"])).alias("end"),
                        F.lit(1.0).alias("score"), F.lit(0).alias("src"),
                    )

                pattern = _alternation(F.transform(known, lambda v: v["value"]))
                return F.transform(S.matches(clean, [pattern]), as_span)

            table = F.map_from_entries(F.transform(known, lambda v: F.struct(v["value"].alias("key"), v["entity"].alias("value"))))
            return F.when(F.size(known) == 0, clean).otherwise(S.redact(clean, let(table, spans_of)))

        return let(let(spans, values), mask)

    return let(S.guard(text), run)


def value_propagation(df: DataFrame, text: str = "text", detectors=DETECTORS, lexicon=DEFAULT_LEXICON) -> DataFrame:
    rest = [c for c in df.columns if c != text]
    found = with_spans(df, text, detectors, lexicon)
    return found.select(*rest, propagate_values(F.col(text), F.col("spans")).alias("redacted"))


def lexicon_union(*tables: DataFrame) -> DataFrame:
    """Distinct words of several one-column tables."""
    out = tables[0]
    for other in tables[1:]:
        out = out.unionByName(other)
    return out.where(F.length("word") > 0).distinct()
