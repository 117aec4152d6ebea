"""Audit records, one per input, and isolation of inputs that cannot be read."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sladd.functions.spans import label_counts
from sladd.operators.flags import manual_review, special_categories
from sladd.operators.language import is_supported
from sladd.plans.analyze import own_placeholders, with_spans
from sladd.rules.detectors import DETECTORS
from sladd.rules.words import DEFAULT_LEXICON


#: Every record has these fields, those of errors too.
FIELDS = ("input_file", "input_path", "output_path", "detected_language", "language_warning", "article9_categories_detected",
          "article9_manual_review_required", "pii_found", "total_replacements", "status", "error")


def _named(rows: DataFrame, key: str, paths: DataFrame | None) -> DataFrame:
    """File name and paths of the inputs, where the caller knows them (``key, input_path, output_path``)."""
    if paths is None:
        rows = rows.withColumn("input_path", F.lit(None).cast("string")).withColumn("output_path", F.lit(None).cast("string"))
    else:
        rows = rows.join(paths.select(key, "input_path", "output_path"), key, "left")
    return rows.withColumn("input_file", F.regexp_extract("input_path", r"([^/\\\\]*)\z", 1))


def audit_records(docs: DataFrame, languages: DataFrame | None = None, doc: str = "doc_id", text: str = "text",
                  detectors=DETECTORS, lexicon=DEFAULT_LEXICON, paths: DataFrame | None = None) -> DataFrame:
    """Names, counts, categories, language and status per document.

    Counts and categories come from the row itself; only the short rows, without text, meet languages and paths.
    """
    found = with_spans(docs.select(doc, text), text, detectors, lexicon)
    rows = found.select(
        doc,
        label_counts(F.col("spans"), own_placeholders(detectors)).alias("pii_found"),
        F.size("spans").cast("bigint").alias("total_replacements"),
        special_categories(F.col(text)).alias("article9_categories_detected"),
    )
    return _record(rows, languages, doc, paths)


def table_audit_records(counts: DataFrame, categories: DataFrame | None = None, languages: DataFrame | None = None, doc: str = "doc_id",
                        paths: DataFrame | None = None) -> DataFrame:
    """Records of tables, from ``doc, placeholder, n`` rows and optional ``doc, categories``."""
    entries = F.array_sort(F.collect_list(F.struct("placeholder", "n")))
    rows = counts.groupBy(doc).agg(F.map_from_entries(entries).alias("pii_found"), F.sum("n").alias("total_replacements"))
    none = F.expr("cast(array() as array<string>)")
    if categories is not None:
        rows = categories.select(doc, F.col("categories").alias("found")).join(rows, doc, "left")
    else:
        rows = rows.withColumn("found", none)
    empty = F.expr("cast(map() as map<string,bigint>)")
    rows = rows.select(doc, F.coalesce("pii_found", empty).alias("pii_found"), F.coalesce("total_replacements", F.lit(0)).alias("total_replacements"),
                       F.coalesce("found", none).alias("article9_categories_detected"))
    return _record(rows, languages, doc, paths)


def _record(rows, languages, doc, paths, status="success"):
    if languages is None:
        rows = rows.withColumn("language", F.lit(None).cast("string"))
    else:
        rows = rows.join(languages.select(doc, "language"), doc, "left")
    rows = rows.withColumn("detected_language", F.coalesce("language", F.lit("unknown")))
    rows = rows.withColumn("language_warning", ~is_supported(F.col("language")))
    rows = rows.withColumn("article9_manual_review_required", manual_review(F.col("article9_categories_detected")))
    if "error" not in rows.columns:
        rows = rows.withColumn("error", F.lit(None).cast("string"))
    return _named(rows.withColumn("status", F.lit(status)), doc, paths).select(doc, *FIELDS)


def error_isolation(inputs: DataFrame, key: str, content: str = "content", languages: DataFrame | None = None, paths: DataFrame | None = None):
    """``(good, errors)``: inputs that can be read, and a record of the fields above for each of the others.

    Bytes that are not UTF-8 are read as Latin-1, so only missing content is an error of a text.
    """
    missing = F.col(content).isNull()
    bad = inputs.where(missing).select(key, F.lit("missing content").alias("error"))
    return inputs.where(~missing), error_records(bad, key, languages, paths)


def error_records(bad: DataFrame, key: str, languages: DataFrame | None = None, paths: DataFrame | None = None) -> DataFrame:
    """Records of inputs that failed (``key, error``), in the schema of the others, so that one sink takes both."""
    rows = bad.select(key, "error", F.expr("cast(map() as map<string,bigint>)").alias("pii_found"), F.lit(0).cast("bigint").alias("total_replacements"),
                      F.expr("cast(array() as array<string>)").alias("article9_categories_detected"))
    return _record(rows, languages, key, paths, "error")
