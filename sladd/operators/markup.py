"""Clean-up of markup text: metadata, tracked changes, comments and embedded media."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sladd.functions import spans as S
from sladd.functions.text import let
from sladd.plans.analyze import own_placeholders, with_spans
from sladd.rules.detectors import DETECTORS
from sladd.rules.media import AUDIO_REMOVED, COMMENT_REMOVED, IMAGE_REMOVED, MEDIA_REMOVED, VIDEO_REMOVED
from sladd.rules.words import DEFAULT_LEXICON

COMMENT = r"(?s)<!--.*?-->"
# (pattern, placeholder); elements with a body come before the bare tags they may hold.
MEDIA = (
    (r"(?is)<video\b[^>]*>.*?</video>", VIDEO_REMOVED),
    (r"(?is)<audio\b[^>]*>.*?</audio>", AUDIO_REMOVED),
    (r"(?is)<object\b[^>]*>.*?</object>|<embed\b[^>]*>", MEDIA_REMOVED),
    (r"(?is)<svg\b[^>]*>.*?</svg>|<img\b[^>]*>", IMAGE_REMOVED),
)
# Fields that may name people or organisations.
METADATA_FIELDS = ("author", "creator", "last_modified_by", "company", "manager", "subject", "keywords", "category",
                   "comments", "description", "identifier", "producer")
_META = r"(?is)<meta\b[^>]*\b(?:name|property)\s*=\s*[\"']?(?:[a-z]+:)?(?:" + "|".join(METADATA_FIELDS) + r")\b[^>]*>"
_TITLE = r"(?is)(<title\b[^>]*>).*?(</title>)"

# A tag with its attributes, a declaration, or a script or style with its body.
MARKUP = (r"(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|"
          r"<(?:/?[a-z]|!)(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>")
# Tags inside a line of text; a word may go on behind them.
INLINE = (r"(?i)\A</?(?:a|abbr|b|bdi|bdo|big|cite|code|data|dfn|em|font|i|kbd|mark|q|rp|rt|ruby|s|samp|small|span|strike|strong|"
          r"sub|sup|time|tt|u|var|wbr)(?:[\s/]|>)")
#: Stands between blocks of text; its middle is a noncharacter, neither word nor space.
BREAK = " \ufdd0 "


def strip_comments(html: Column) -> Column:
    return F.regexp_replace(html, COMMENT, "")


def comment_count(html: Column) -> Column:
    return F.regexp_count(html, F.lit(COMMENT)).cast("bigint")


def replace_media(html: Column) -> Column:
    out = html
    for pattern, placeholder in MEDIA:
        out = F.regexp_replace(out, pattern, placeholder)
    return out


def media_counts(html: Column) -> Column:
    """``struct<placeholder, n>`` per kind, each counted after the kinds before it are replaced."""
    rest, found = html, []
    for pattern, placeholder in MEDIA:
        n = F.regexp_count(rest, F.lit(pattern)).cast("bigint")
        found.append(F.struct(F.lit(placeholder).alias("placeholder"), n.alias("n")))
        rest = F.regexp_replace(rest, pattern, placeholder)
    return F.array(*found)


def strip_metadata(html: Column) -> Column:
    """Empty the title and drop meta tags of personal fields."""
    return F.regexp_replace(F.regexp_replace(html, _META, ""), _TITLE, "$1$2")


def accept_changes(html: Column) -> Column:
    """Drop deleted text and unwrap inserted text."""
    return F.regexp_replace(F.regexp_replace(html, r"(?is)<del\b[^>]*>.*?</del>", ""), r"(?i)</?ins\b[^>]*>", "")


def text_view(html: Column) -> Column:
    """What a reader sees: ``struct<pieces, parts>``.

    Every second of the ``pieces`` is markup (tags, comments, scripts and styles), the others are text. ``parts`` has what each
    piece adds to the view: text itself, nothing for inline markup, a break that no pattern crosses for all other markup.
    """
    pieces = F.split(F.regexp_replace(S.guard(html), MARKUP, f"{S.MARK}$0{S.MARK}"), S.MARK, -1)

    def part(piece, i):
        return F.when(i % 2 == 0, piece).when(piece.rlike(INLINE), "").otherwise(F.lit(BREAK))

    return let(pieces, lambda p: F.struct(p.alias("pieces"), F.transform(p, part).alias("parts")))


def masked_pieces(pieces: Column, parts: Column, spans: Column, extra: dict | None = None) -> Column:
    """The markup with the spans of its view masked; markup stays, and a value split by tags keeps its first place.

    Pieces are taken in blocks, so that each looks at the spans near it only.
    """
    starts = S.running(F.transform(parts, lambda p: F.length(p)), lambda a, b: a + b)

    def build(at):
        each = F.zip_with(pieces, F.zip_with(at, parts, lambda a, p: F.struct(a.alias("start"), (a + F.length(p)).alias("end"))),
                          lambda piece, x: F.struct(piece.alias("piece"), x["start"].alias("start"), x["end"].alias("end")))
        last = F.floor((F.size(pieces) - 1) / S.BLOCK).cast("int")

        def block(items):
            def of_block(b):
                own = F.slice(items, b * S.BLOCK + 1, F.lit(S.BLOCK))
                near = F.filter(spans, lambda s: (s["start"] < F.element_at(own, -1)["end"]) & (s["end"] > own[0]["start"]))
                return let(near, lambda n: F.transform(own, lambda x, i: F.when(i % 2 == 1, x["piece"]).otherwise(cut_out(x, n))))

            return F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), last), of_block)), "")

        return let(each, block)

    def cut_out(x, near):
        def clipped(s):
            return F.struct(
                F.greatest(s["start"] - x["start"], F.lit(0)).alias("start"), F.least(s["end"], x["end"]).alias("stop"),
                F.when(s["start"] >= x["start"], S.placeholder_of(s["entity"], extra)).otherwise("").alias("mask"))

        def local(s):
            return F.struct(s["start"].alias("start"), (s["stop"] - x["start"]).alias("end"), s["mask"].alias("mask"))

        own = F.filter(near, lambda s: (s["start"] < x["end"]) & (s["end"] > x["start"]))
        return S.replaced(x["piece"], F.transform(F.transform(own, clipped), local), lambda s: s["mask"])

    return let(starts, build)


def anonymize_page(df: DataFrame, page: str = "page_id", html: str = "html", detectors=DETECTORS,
                   lexicon=DEFAULT_LEXICON) -> DataFrame:
    """Metadata, changes, comments and media, then the text a reader sees: ``page, redacted, counts``.

    Values that inline tags split are found; tags and their attributes are not read as prose and stay as they are.
    """
    source = df.select(page, accept_changes(strip_metadata(F.col(html))).alias("_source"))
    view = source.withColumn("_seen", text_view(replace_media(strip_comments(F.col("_source")))))
    view = view.withColumn("_view", F.array_join("_seen.parts", ""))
    found = with_spans(view, "_view", detectors, lexicon)
    comments = F.struct(F.lit(COMMENT_REMOVED).alias("placeholder"), comment_count(F.col("_source")).alias("n"))
    removed = F.concat(F.array(comments), media_counts(strip_comments(F.col("_source"))))
    seen = F.map_from_entries(F.filter(removed, lambda m: m["n"] > 0))
    extra = own_placeholders(detectors)
    body = masked_pieces(F.col("_seen.pieces"), F.col("_seen.parts"), F.coalesce(F.col("spans"), S.empty(S.SPAN_TYPE)), extra)
    return found.select(
        page,
        F.when(F.col("_source").isNotNull(), body).alias("redacted"),
        F.map_concat(seen, S.label_counts(F.col("spans"), extra)).alias("counts"),
    )
