"""Span extraction, overlap resolution and replacement as row-local expressions.

A span is ``struct<entity, start, end, score, src>`` with 0-based, half-open
character offsets; a unit holds an array of them.
"""

from pyspark.sql import Column, functions as F

from sladd.functions.text import let, sql_text
from sladd.rules.entities import DEFAULT_PLACEHOLDER, ENTITY_TO_PLACEHOLDER

SPAN_TYPE = "struct<entity:string,start:int,end:int,score:double,src:int>"
HIT_TYPE = "struct<rule:int,start:int,chunk:string>"
RICH_TYPE = "struct<entity:string,start:int,end:int,score:double,src:int,chunk:string>"

# Unicode noncharacters: never word or space characters, so no pattern matches them.
MARK = "\uffff"
GAP = "\ufffe"
_SPARE = "\ufdd0"

# Above these sizes the work per row is cut up to stay near linear.
BLOCK = 128
MANY_CHARS = 16_384
MANY_SPANS = 64
MANY_REGIONS = 256

# Characters kept on either side of a digit.
NEAR_DIGITS = 96


def empty(element_type: str) -> Column:
    return F.expr(f"cast(array() as array<{element_type}>)")


def guard(text: Column) -> Column:
    """Replace our separators should the text hold them; offsets stay the same."""
    dirty = text.contains(MARK) | text.contains(GAP)
    return F.when(dirty, F.translate(text, MARK + GAP, _SPARE * 2)).otherwise(text)


def running(values: Column, merge, element_type: str = "int") -> Column:
    """Per element, ``merge`` over all elements before it, starting from 0.

    Appending to an array copies it, so long arrays are folded in blocks and the blocks are then shifted.
    """

    def fold(items):
        def step(acc, x):
            return F.struct(
                merge(acc["now"], x).alias("now"), F.concat(acc["out"], F.array(acc["now"])).alias("out")
            )

        zero = F.expr(f"named_struct('now', 0, 'out', cast(array() as array<{element_type}>))")
        return F.aggregate(items, zero, step, lambda a: a["out"])

    def blocked(items):
        last = F.floor((F.size(items) - 1) / BLOCK).cast("int")
        blocks = F.transform(
            F.sequence(F.lit(0), last), lambda i: F.slice(items, i * BLOCK + 1, F.lit(BLOCK))
        )

        def shift(parts):
            before = fold(F.transform(parts, lambda part: F.aggregate(part, F.lit(0), merge)))
            return F.flatten(
                F.zip_with(parts, before, lambda part, base: F.transform(fold(part), lambda x: merge(base, x)))
            )

        return let(blocks, shift)

    return let(values, lambda v: F.when(F.size(v) <= 2 * BLOCK, fold(v)).otherwise(blocked(v)))


def marked_pieces(marked: Column, rule: Column) -> Column:
    """Split a text whose hits are wrapped in MARK into hits with offsets; every second piece is a hit."""

    def build(pieces):
        starts = running(F.transform(pieces, lambda p: F.length(p)), lambda a, b: a + b)
        return let(
            starts,
            lambda at: F.transform(
                F.sequence(F.lit(1), F.size(pieces) - 2, F.lit(2)), lambda i: hit(rule, at[i], pieces[i])
            ),
        )

    return F.when(marked.contains(MARK), let(F.split(marked, MARK, -1), build)).otherwise(empty(HIT_TYPE))


def hit(rule: Column, start: Column, chunk: Column) -> Column:
    return F.struct(rule.alias("rule"), start.alias("start"), chunk.alias("chunk"))


def matches(text: Column, regexes) -> Column:
    """All matches of each pattern with their offsets: one pass of each pattern over the text.

    Patterns are independent, so hits of different patterns may overlap; ``rule`` is the pattern's number.
    A pattern may be a Column; a null one has no hits.
    ``text`` must have gone through :func:`guard`; patterns must not match the empty string.
    """
    replacement = F.lit(f"{MARK}$0{MARK}")
    patterns = [r if isinstance(r, Column) else F.lit(r) for r in regexes]
    marked = F.array(*[F.regexp_replace(text, p, replacement) for p in patterns])
    return F.flatten(F.transform(marked, lambda m, i: marked_pieces(m, i)))


def extract_spans(text: Column, pattern: str, entity: str, score: float, src: int = 0) -> Column:
    """Spans of one case-insensitive pattern."""
    return F.transform(
        matches(guard(text), ["(?iU)" + pattern]),
        lambda h: F.struct(
            F.lit(entity).alias("entity"), h["start"].alias("start"),
            (h["start"] + F.length(h["chunk"])).alias("end"), F.lit(float(score)).alias("score"),
            F.lit(src).alias("src"),
        ),
    )


def digit_view(text: Column) -> Column:
    """The parts of a text near digits, with the marks needed to map offsets back.

    Prose is mostly far from digits, so the many number patterns then run over a short string. Long
    digit-free stretches shrink to their two ends, joined by GAP. What is left always holds the two whole
    tokens after and the three before a token with digits; a stretch whose ends hold fewer is kept whole,
    and so is a text with very many stretches. Patterns of that reach give the same hits as on the full text.
    """
    pieces = F.split(F.regexp_replace(text, r"(?U)\d+", f"{MARK}$0{MARK}"), MARK, -1)

    def build(p):
        last = F.size(p) - 1

        def shrink(piece, i):
            def ends(e):
                first = i == 0
                final = i == last
                enough = (first | e["head"].rlike(r"(?U)^\S*\s+\S+\s+\S+\s")) & (
                    final | e["tail"].rlike(r"(?U)^\s+\S+\s+\S+\s+\S+\s")
                )
                cut = F.struct(
                    F.when(first, "").otherwise(e["head"]).alias("head"),
                    F.when(final, "").otherwise(e["tail"]).alias("tail"),
                    F.length(piece).alias("size"),
                )
                return F.when(enough, cut).otherwise(whole)

            whole = F.struct(piece.alias("head"), F.lit(None).cast("string").alias("tail"), F.length(piece).alias("size"))
            both = F.struct(
                F.regexp_replace(F.left(piece, F.lit(NEAR_DIGITS)), r"(?U)\S++$", "").alias("head"),
                F.regexp_replace(F.right(piece, F.lit(NEAR_DIGITS)), r"(?U)^\S++", "").alias("tail"),
            )
            return F.when((i % 2 == 0) & (F.length(piece) > 2 * NEAR_DIGITS), let(both, ends)).otherwise(whole)

        def place(acc, part):
            """Advance in the short text (here) and in the source (there); a cut starts a new mark."""
            here = acc["here"] + F.length(part["head"])
            there = acc["there"] + part["size"]
            row = F.struct((here + 1).alias("here"), (there - F.length(part["tail"])).alias("there"))
            return F.when(
                part["tail"].isNull(),
                F.struct(here.alias("here"), there.alias("there"), acc["marks"].alias("marks")),
            ).otherwise(
                F.struct(
                    (here + 1 + F.length(part["tail"])).alias("here"), there.alias("there"),
                    F.concat(acc["marks"], F.array(row)).alias("marks"),
                )
            )

        zero = F.expr("named_struct('here', 0, 'there', 0, 'marks', array(named_struct('here', 0, 'there', 0)))")

        def finish(parts):
            short = F.transform(parts, lambda x: F.concat(x["head"], F.coalesce(F.concat(F.lit(GAP), x["tail"]), F.lit(""))))
            return let(
                F.aggregate(parts, zero, place, lambda a: a["marks"]),
                lambda marks: F.when(
                    F.size(marks) > MANY_REGIONS,
                    F.struct(text.alias("text"), F.slice(marks, 1, 1).alias("marks")),
                ).otherwise(F.struct(F.array_join(short, "").alias("text"), marks.alias("marks"))),
            )

        none = F.struct(F.lit("").alias("text"), zero["marks"].alias("marks"))
        return F.when(F.size(p) == 1, none).otherwise(let(F.transform(p, shrink), finish))

    return let(pieces, build)


def source_offset(start: Column, marks: Column) -> Column:
    return let(
        F.element_at(F.filter(marks, lambda m: m["here"] <= start), -1),
        lambda m: start - m["here"] + m["there"],
    )


def _overlaps(a: Column, b: Column) -> Column:
    return F.greatest(a["start"], b["start"]) < F.least(a["end"], b["end"])


def by_score(spans: Column) -> Column:
    """Score descending, then source, start, longer first, entity: a total, repeatable order."""
    keyed = F.transform(
        spans,
        lambda s: F.struct(
            (-s["score"]).alias("a"), s["src"].alias("b"), s["start"].alias("c"), (-s["end"]).alias("d"),
            s["entity"].alias("e"), s.alias("span"),
        ),
    )
    return F.transform(F.array_sort(keyed), lambda k: k["span"])


def _greedy(spans: Column, span_type: str) -> Column:
    def step(kept, span):
        clash = F.exists(kept, lambda k: _overlaps(k, span))
        return F.when(clash, kept).otherwise(F.concat(kept, F.array(span)))

    return F.aggregate(by_score(spans), empty(span_type), step)


def by_start(spans: Column) -> Column:
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("a"), s["end"].alias("b"), s.alias("span")))
    return F.transform(F.array_sort(keyed), lambda k: k["span"])


def _islands(spans: Column) -> Column:
    """Cut spans into groups that share no character; conflicts stay inside a group."""

    def cut(items):
        reach = running(F.transform(items, lambda x: x["end"]), lambda a, b: F.greatest(a, b))

        def groups(r):
            first = F.filter(
                F.sequence(F.lit(0), F.size(items) - 1), lambda i: (i == 0) | (items[i]["start"] >= r[i])
            )
            return let(
                first,
                lambda at: F.transform(
                    at,
                    lambda start, i: F.slice(
                        items, start + 1, F.coalesce(F.get(at, i + 1), F.size(items)) - start
                    ),
                ),
            )

        return let(reach, groups)

    return let(by_start(spans), cut)


def resolve(spans: Column, span_type: str = SPAN_TYPE) -> Column:
    """Keep the best of overlapping spans, greedily by score; touching spans do not overlap.

    Returns the kept spans by start. Long arrays are resolved island by island.
    """

    def pick(s):
        return (
            F.when(F.size(s) < 2, s)
            .when(F.size(s) <= MANY_SPANS, _greedy(s, span_type))
            .otherwise(F.flatten(F.transform(_islands(s), lambda g: _greedy(g, span_type))))
        )

    return by_start(let(spans, pick))


def with_slices(text: Column, body) -> Column:
    """``body(cut)`` where ``cut(start, size)`` is a substring by 0-based offset.

    A substring is found by counting characters from the front. A long text is therefore cut into blocks once,
    and a substring reads only the blocks it lies in.
    """
    blocks = F.when(
        F.length(text) > MANY_CHARS, F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK * 8}}}"), 0)
    )

    def use(pieces):
        def cut(start, size):
            block = F.floor(start / (BLOCK * 8)).cast("int")
            count = F.floor((start + size) / (BLOCK * 8)).cast("int") - block + 1
            near = F.array_join(F.slice(pieces, block + 1, count), "")
            return F.when(pieces.isNull(), F.substring(text, start + 1, size)).otherwise(
                F.substring(near, start - block * (BLOCK * 8) + 1, size)
            )

        return body(cut)

    return let(blocks, use)


def placeholder_of(entity: Column, extra: dict | None = None) -> Column:
    table = {**ENTITY_TO_PLACEHOLDER, **(extra or {})}
    pairs = ", ".join(sql_text(x) for pair in table.items() for x in pair)
    return F.coalesce(F.element_at(F.expr(f"map({pairs})"), entity), F.lit(DEFAULT_PLACEHOLDER))


def replaced(text: Column, spans: Column, mask) -> Column:
    """Replace non-overlapping spans, given by start, by what ``mask`` gives for each."""

    def build(s):
        def pieces(cut):
            def part(span, i):
                before = F.when(i > 0, F.get(s, i - 1)["end"]).otherwise(F.lit(0))
                return F.concat(cut(before, span["start"] - before), mask(span))

            last = F.element_at(s, -1)["end"]
            return F.concat(F.array_join(F.transform(s, part), ""), cut(last, F.length(text) - last))

        return F.when(F.size(s) == 0, text).otherwise(with_slices(text, pieces))

    return let(spans, build)


def redact(text: Column, spans: Column, extra: dict | None = None) -> Column:
    """Replace non-overlapping spans, given by start, by their placeholders."""
    return replaced(text, spans, lambda span: placeholder_of(span["entity"], extra))


def label_counts(spans: Column, extra: dict | None = None) -> Column:
    """Placeholder -> number of spans, as a map with sorted keys."""
    return count_labels(F.transform(spans, lambda s: placeholder_of(s["entity"], extra)))


def count_labels(labels: Column) -> Column:
    """Label -> number, as a map with sorted keys."""
    return let(
        labels,
        lambda all_: F.map_from_entries(
            F.transform(
                F.array_sort(F.array_distinct(all_)),
                lambda x: F.struct(
                    x.alias("key"), F.size(F.filter(all_, lambda y: y == x)).cast("bigint").alias("value")
                ),
            )
        ),
    )
