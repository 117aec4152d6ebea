"""The whole analysis of very long units: a unit is cut into blocks, the blocks are rows of their own, the results are put together.

The outcome equals that of the uncut unit, because a cut lies where nothing reaches across:

- **Hits.** No pattern of the detectors takes a break in: one of ``, ; ! ? "``, or a white space behind a letter and a full stop. So a
  match lies on one side, and a scan that starts behind a break finds what a scan of the whole text finds from there.
- **Context.** A hit's score depends on the tokens before it. Each block carries the last tokens of the text before it as its
  ``lead``, which is analysed with it; spans that start in the lead belong to an earlier block and are left out.
- **Overlaps and false positives** concern spans and their own text, hence one block.

Detectors and names of one's own must not match across a break either, or come with ``breaks`` of their own. Listed names are checked.
A stretch of text without any break stays one block. Null and blank units have no blocks with spans; equal long texts are analysed once.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from sladd.functions import spans as S
from sladd.plans.analyze import own_placeholders, with_spans
from sladd.rules.detectors import DETECTORS
from sladd.rules.entities import CONTEXT_TOKENS
from sladd.rules.words import DEFAULT_LEXICON

#: Longer units are cut, into blocks of at least this many characters.
BLOCK_CHARS = 1 << 16
BREAKS = r"[,;!?\x22]|\p{L}\.\s"
# Enough white space to tell whether a name could hold a break.
_NAME_BREAK = r"[,;!?\x22]|\.\s"
_AT, _BODY, _LEAD, _UNIT = "_at", "_body", "_lead", "_unit"


def _lead(text: Column) -> Column:
    """The end of a text with one whole token more than the context needs; all of it where it holds fewer."""
    back = rf"(?U)^\s*+(?:\S++\s++){{0,{CONTEXT_TOKENS}}}\S*+"
    return F.reverse(F.regexp_extract(F.reverse(text), back, 0))


def pieces(text: Column, size: int = BLOCK_CHARS, breaks: str = BREAKS) -> Column:
    """A text in consecutive parts of at least ``size`` characters that end behind a break; the last one may be shorter."""
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{{size}}}.*?(?:{breaks})|.+"), 0)


def cut_units(df: DataFrame, text: str = "text", size: int = BLOCK_CHARS, breaks: str = BREAKS) -> DataFrame:
    """One row a block: the other columns, ``_at`` (offset in the unit), ``_lead`` and ``_body``. Bodies in order are the unit."""
    rest = [c for c in df.columns if c != text]
    parts = df.select(*rest, pieces(F.col(f"`{text}`"), size, breaks).alias("_parts"))
    starts = S.running(F.transform("_parts", F.length), lambda a, b: a + b)

    def step(acc, part):
        """A short block passes the tokens of the blocks before it on."""
        return F.struct(_lead(F.concat(acc["lead"], part)).alias("lead"), F.concat(acc["out"], F.array(acc["lead"])).alias("out"))

    zero = F.expr("named_struct('lead', '', 'out', cast(array() as array<string>))")
    leads = F.aggregate("_parts", zero, step, lambda a: a["out"])
    placed = parts.withColumn("_starts", starts).withColumn("_leads", leads)
    rows = placed.select(*rest, F.explode(F.arrays_zip("_starts", "_leads", "_parts")).alias("_b"))
    return rows.select(*rest, F.col("_b._starts").alias(_AT), F.col("_b._leads").alias(_LEAD), F.col("_b._parts").alias(_BODY))


def _checked_names(lexicon, names) -> None:
    """Names must not hold a break, as they are found inside blocks."""
    held = [n for n in lexicon.names if re.search(_NAME_BREAK, n)][:1] if names is None else [
        r.name for r in names.names.where(F.col("name").rlike(_NAME_BREAK)).limit(1).collect()]
    if held:
        raise ValueError(f"the listed name {held[0]!r} holds a break; give ``breaks`` that no name holds")


def block_spans(df: DataFrame, text: str = "text", detectors=DETECTORS, lexicon=DEFAULT_LEXICON, names=None,
                size: int = BLOCK_CHARS, breaks: str = BREAKS) -> DataFrame:
    """One row a block: the other columns, ``_at``, ``_body`` and ``spans``, whose offsets count from the block's start.

    Blocks are dealt out evenly, so that one unit is analysed by many tasks. Nothing is gathered by unit here.
    """
    if breaks == BREAKS:
        _checked_names(lexicon, names)
    rows = cut_units(df, text, size, breaks)
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(max(tasks, df.sparkSession.sparkContext.defaultParallelism))
    whole = dealt.withColumn("_long", F.concat(_LEAD, _BODY)).withColumn(_LEAD, F.length(_LEAD))
    found = with_spans(whole, "_long", detectors, lexicon, column="spans", names=names).drop("_long")
    return found.withColumn("spans", _moved(F.col("spans"), -F.col(_LEAD))).drop(_LEAD)


def _moved(spans: Column, by: Column) -> Column:
    """Spans with shifted offsets; those that then start before the text are left out."""
    def move(s):
        return s.withField("start", s["start"] + by).withField("end", s["end"] + by)

    return F.filter(F.transform(spans, move), lambda s: s["start"] >= 0)


def anonymize_blocks(df: DataFrame, text: str = "text", detectors=DETECTORS, lexicon=DEFAULT_LEXICON, keep_spans: bool = True,
                     names=None, size: int = BLOCK_CHARS, breaks: str = BREAKS) -> DataFrame:
    """Same rows as ``plans.analyze.anonymize``, with units longer than ``size`` analysed in blocks.

    Short units stay where they are. A long unit is known by two hashes of its text, so that no key is asked of the caller; its
    redacted blocks and spans come back as one value a unit, since that is what a unit's row holds. Who wants no such value
    takes :func:`block_spans`.
    """
    c = F.col(f"`{text}`")
    extra = own_placeholders(detectors)
    rest = [x for x in df.columns if x != text]
    long = F.coalesce(F.length(c) > size, F.lit(False))
    shown = ["spans"] if keep_spans else []

    short = with_spans(df.where(~long), text, detectors, lexicon, column="spans", names=names)
    short = short.select(*rest, S.redact(c, F.col("spans"), extra).alias("redacted"), *shown, F.size("spans").cast("bigint").alias("n"))

    unit = F.struct(F.xxhash64(c).alias("a"), F.md5(c).alias("b"))
    units = df.where(long).withColumn(_UNIT, unit)
    texts = units.groupBy(_UNIT).agg(F.any_value(c).alias("text"))
    blocks = block_spans(texts, "text", detectors, lexicon, names, size, breaks)
    redacted = S.redact(F.col(_BODY), F.col("spans"), extra)
    done = blocks.select(_UNIT, _AT, redacted.alias("_red"), _moved(F.col("spans"), F.col(_AT)).alias("_spans"), F.size("spans").alias("_n"))
    part = F.struct(_AT, "_red", *(["_spans"] if keep_spans else []))
    gathered = done.groupBy(_UNIT).agg(F.array_sort(F.collect_list(part)).alias("_all"), F.sum("_n").cast("bigint").alias("n"))
    values = [F.array_join(F.col("_all._red"), "").alias("redacted"), *([F.flatten("_all._spans").alias("spans")] if keep_spans else []), "n"]
    back = units.select(*rest, _UNIT).join(gathered.select(_UNIT, *values), _UNIT)
    return short.unionByName(back.select(*rest, "redacted", *shown, "n"))
