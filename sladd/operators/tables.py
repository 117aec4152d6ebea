"""Header-driven masking of tables: wide DataFrames and cell tables."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F, types as T

from sladd.functions import spans as S
from sladd.functions.text import exploded, let, not_blank, strip
from sladd.plans.analyze import Stages, own_placeholders, run_stages, with_spans
from sladd.rules.detectors import DETECTORS
from sladd.rules.headers import HEADER_RULES
from sladd.rules.words import DEFAULT_LEXICON

# Rule tables larger than this do not belong in an expression.
MAX_RULES = 1_000


def header_placeholder(header: str | None) -> str | None:
    """Placeholder that a column name forces, decided on the driver once per table."""
    name = (header or "").strip()
    for placeholder, pattern in HEADER_RULES:
        if name and re.search(pattern, name, re.IGNORECASE):
            return placeholder
    return None


def first_rule(header: Column, rules) -> Column:
    """``struct<prio, placeholder>`` of the first matching ``(prio, placeholder, pattern)``, or null."""
    chain = None
    for prio, placeholder, pattern in rules:
        hit = header.rlike("(?iU)" + pattern)
        value = F.struct(F.lit(prio).alias("prio"), F.lit(placeholder).alias("placeholder"))
        chain = F.when(hit, value) if chain is None else chain.when(hit, value)
    return F.when(header != "", chain)


def default_rules():
    return [(i, placeholder, pattern) for i, (placeholder, pattern) in enumerate(HEADER_RULES, 1)]


def header_rule(header: Column) -> Column:
    """Placeholder forced by a header value; null for blank or unknown headers."""
    return let(strip(header), lambda h: first_rule(h, default_rules())["placeholder"])


def header_rule_join(headers: DataFrame, header: str, rules: DataFrame | None = None) -> DataFrame:
    """Headers matched to their first rule, as ``prio`` and ``placeholder``.

    A rule table (``prio, placeholder, pattern``) is a short dimension: its size is checked, then each rule is a
    constant pattern that compiles once per task. A join on ``rlike`` would compile one per row and rule.
    """
    table = default_rules()
    if rules is not None:
        rows = rules.orderBy("prio").limit(MAX_RULES + 1).collect()
        if len(rows) > MAX_RULES:
            raise ValueError(f"more than {MAX_RULES} header rules")
        table = [(r["prio"], r["placeholder"], r["pattern"]) for r in rows]
    found = let(strip(F.col(header)), lambda h: first_rule(h, table))
    return headers.withColumn("_rule", found).select("*", "_rule.prio", "_rule.placeholder").drop("_rule")


def forced_mask(value: Column, placeholder: str) -> Column:
    """The placeholder for every cell that is not blank."""
    return F.when(not_blank(value), F.lit(placeholder)).otherwise(value)


def string_columns(df: DataFrame):
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def column_roles(df: DataFrame, exclude=()):
    """``(forced, analysed)``: forced columns with their placeholder, and the other string columns."""
    names = [c for c in string_columns(df) if c not in exclude]
    forced = {c: header_placeholder(c) for c in names if header_placeholder(c)}
    return forced, [c for c in names if c not in forced]


def _prefix(header: Column) -> Column:
    lead = F.lower(strip(header))
    return F.when(lead != "", F.concat(lead, F.lit(": "))).otherwise(F.lit(""))


def redact_value_cells(df: DataFrame, cells: Column, out: str, detectors=DETECTORS,
                       lexicon=DEFAULT_LEXICON, labels: str | None = None) -> DataFrame:
    """Add ``out``: redacted values of an array of ``struct<h, v>`` (header, value); and ``labels``: their placeholders.

    A value is read as ``"<header>: <value>"``, so that the header counts as context. When a span touches the
    header part, the bare value is analysed instead. A blank header gives no context.

    The two readings are projections of their own over whole arrays, so each detection expression is in the
    plan once whatever the number of cells.
    """
    extra = own_placeholders(detectors)

    def prepare(cell):
        lead = _prefix(cell["h"])
        return F.struct(F.length(lead).alias("size"), F.concat(lead, cell["v"]).alias("full"), cell["v"].alias("v"))

    def judged(cell, spans):
        size = cell["size"]
        touched = F.exists(spans, lambda s: s["start"] < size)
        moved = F.transform(
            spans,
            lambda s: F.struct(
                s["entity"].alias("entity"), (s["start"] - size).alias("start"), (s["end"] - size).alias("end"),
                s["score"].alias("score"), s["src"].alias("src"),
            ),
        )
        return F.struct(
            cell["v"].alias("v"), F.when(touched, cell["v"]).alias("again"),
            F.when(~touched, moved).alias("spans"),
        )

    def written(cell, again):
        found = F.coalesce(cell["spans"], again)
        return F.when(not_blank(cell["v"]), S.redact(cell["v"], found, extra)).otherwise(cell["v"])

    def read(df_, field, column):
        units = F.transform(F.col("_cell"), lambda c: Stages.unit(F.when(not_blank(c["v"]), c[field])))
        return run_stages(df_, units, column, True, "filtered", detectors, lexicon)

    first = read(df.withColumn("_cell", F.transform(cells, prepare)), "full", "_first")
    second = read(first.withColumn("_cell", F.zip_with("_cell", "_first", judged)), "again", "_second")
    done = second.withColumn(out, F.zip_with("_cell", "_second", written))
    if labels:
        found = F.zip_with("_cell", "_second", lambda c, again: F.when(not_blank(c["v"]), F.coalesce(c["spans"], again)).otherwise(S.empty(S.SPAN_TYPE)))
        done = done.withColumn(labels, F.transform(F.flatten(found), lambda s: S.placeholder_of(s["entity"], extra)))
    return done.drop("_cell", "_first", "_second")


def text_arrays(df: DataFrame):
    """Columns that hold arrays of text, such as the cells beyond a CSV header."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StringType)]


def redact_table(df: DataFrame, detectors=DETECTORS, lexicon=DEFAULT_LEXICON, exclude=(), counts: str | None = None) -> DataFrame:
    """Mask forced columns, analyse the other text columns, leave everything else alone. No shuffle.

    Cells of an array of text are analysed without a header. ``counts`` adds a map of placeholders to their number
    in the row: spans of analysed cells, and forced cells that the mask changes.
    """
    forced, analysed = column_roles(df, exclude)
    arrays = [c for c in text_arrays(df) if c not in exclude]
    done = df
    if analysed or arrays:
        none = S.empty("struct<h:string,v:string>")
        cells = F.array(*[F.struct(F.lit(c).alias("h"), F.col(f"`{c}`").alias("v")) for c in analysed]) if analysed else none
        for name in arrays:
            loose = F.transform(F.col(f"`{name}`"), lambda v: F.struct(F.lit("").alias("h"), v.alias("v")))
            cells = F.concat(cells, F.coalesce(loose, none))
        done = redact_value_cells(df, cells, "_cells", detectors, lexicon, "_labels")
    out, at = [], F.lit(len(analysed) + 1)
    for name in df.columns:
        value = F.col(f"`{name}`")
        if name in forced:
            out.append(forced_mask(value, forced[name]).alias(name))
        elif name in analysed:
            out.append(F.col("_cells")[analysed.index(name)].alias(name))
        elif name not in arrays:
            out.append(value)
        else:
            before = sum((F.coalesce(F.size(F.col(f"`{c}`")), F.lit(0)) for c in arrays[: arrays.index(name)]), at)
            out.append(F.when(value.isNotNull(), F.slice("_cells", before, F.size(value))).alias(name))
    if counts:
        masks = [F.when(not_blank(F.col(f"`{c}`")) & (F.col(f"`{c}`") != p), F.lit(p)) for c, p in forced.items()]
        changed = F.filter(F.array(*masks), lambda x: x.isNotNull()) if masks else S.empty("string")
        out.append(S.count_labels(F.concat(F.col("_labels"), changed) if analysed or arrays else changed).alias(counts))
    return done.select(*out)


def table_label_counts(df: DataFrame, detectors=DETECTORS, lexicon=DEFAULT_LEXICON, exclude=()) -> DataFrame:
    """``placeholder, n`` of a whole table; partial sums before the shuffle."""
    rows = exploded(redact_table(df, detectors, lexicon, exclude, counts="_counts"), [], F.map_entries("_counts"), "e")
    return rows.groupBy(F.col("e.key").alias("placeholder")).agg(F.sum("e.value").alias("n"))


def column_profile(df: DataFrame, detectors=DETECTORS, lexicon=DEFAULT_LEXICON, exclude=()) -> DataFrame:
    """Per string column: forced or not, placeholder, cells with text and cells that masking changes.

    The sums are taken per column over one scan and turned into rows afterwards.
    """
    forced, analysed = column_roles(df, exclude)
    masked = redact_table(df.select(*[F.col(f"`{c}`") for c in df.columns], F.struct("*").alias("_before")),
                          detectors, lexicon, exclude)
    names = [c for c in string_columns(df) if c not in exclude]
    sums = []
    for i, name in enumerate(names):
        before, after = F.col("_before")[name], F.col(f"`{name}`")
        sums.append(F.count_if(not_blank(before)).alias(f"cells_{i}"))
        sums.append(F.count_if(~before.eqNullSafe(after)).alias(f"masked_{i}"))
    rows = F.array(*[
        F.struct(
            F.lit(name).alias("column_name"), F.lit(name in forced).alias("forced"),
            F.lit(forced.get(name)).cast("string").alias("placeholder"),
            F.col(f"cells_{i}").alias("cells"), F.col(f"masked_{i}").alias("masked"),
        )
        for i, name in enumerate(names)
    ])
    return masked.agg(*sums).select(F.explode(rows).alias("r")).select("r.*")


def cell_header_join(cells: DataFrame, salts: int = 16) -> DataFrame:
    """Cells with the placeholder that their own row 0 forces (``forced``), null in row 0 and elsewhere.

    Cells are keyed by ``doc_id, table_no, col_no``. One document may hold much of the data, so the key is
    salted by the row number; only the headers that force a placeholder are repeated per salt.
    """
    keys = ["doc_id", "table_no", "col_no"]
    headers = (
        cells.where("row_no = 0")
        .select(*keys, header_rule(F.col("text")).alias("forced"))
        .where("forced is not null")
        .dropDuplicates(keys)
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    )
    salted = cells.withColumn("salt", F.pmod(F.col("row_no"), F.lit(salts)).cast("int"))
    joined = salted.join(headers, [*keys, "salt"], "left").drop("salt")
    return joined.select(*cells.columns, F.when(F.col("row_no") > 0, F.col("forced")).alias("forced"))


def redact_cells(cells: DataFrame, detectors=DETECTORS, lexicon=DEFAULT_LEXICON, salts: int = 16, counts: str | None = None) -> DataFrame:
    """Mask forced columns of cell tables and analyse every other cell, row 0 included.

    ``counts`` adds a map of placeholders to their number in the cell; a forced cell with text counts once.
    """
    joined = cell_header_join(cells, salts)
    masked = F.col("forced").isNotNull() & not_blank(F.col("text"))
    # Cells to be masked are not analysed: their text is null in the analysed column.
    found = with_spans(joined.withColumn("_rest", F.when(~masked, F.col("text"))), "_rest", detectors, lexicon)
    text = F.when(masked, F.col("forced")).otherwise(
        S.redact(F.col("text"), F.col("spans"), own_placeholders(detectors))
    )
    if counts:
        extra = own_placeholders(detectors)
        labels = F.when(masked, F.array("forced")).otherwise(F.transform("spans", lambda s: S.placeholder_of(s["entity"], extra)))
        found = found.withColumn(counts, S.count_labels(labels))
    return found.withColumn("text", text).drop("_rest", "spans")


def cell_label_counts(cells: DataFrame, doc: str = "doc_id", detectors=DETECTORS, lexicon=DEFAULT_LEXICON) -> DataFrame:
    """``doc, placeholder, n`` of the cell tables of each document."""
    rows = exploded(redact_cells(cells, detectors, lexicon, counts="_counts"), [doc], F.map_entries("_counts"), "e")
    return rows.groupBy(doc, F.col("e.key").alias("placeholder")).agg(F.sum("e.value").alias("n"))
