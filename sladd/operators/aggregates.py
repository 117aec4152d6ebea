"""Counts over spans. ``spans`` columns hold one array per unit."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sladd.functions.spans import SPAN_TYPE, label_counts, placeholder_of, resolve
from sladd.functions.text import exploded


def label_counts_unit(df: DataFrame, unit: str = "unit_id", spans: str = "spans") -> DataFrame:
    """``unit, placeholder, n``. A unit is one row, so counting needs no shuffle."""
    entries = exploded(df, [unit], F.map_entries(label_counts(F.col(spans))), "e")
    return entries.select(unit, F.col("e.key").alias("placeholder"), F.col("e.value").alias("n"))


def label_counts_doc(counts: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Unit counts merged per document; partial sums before the shuffle."""
    return counts.groupBy(doc, "placeholder").agg(F.sum("n").alias("n"))


def label_counts_map(counts: DataFrame, doc: str = "doc_id") -> DataFrame:
    """One map per document with sorted keys, from document counts."""
    entries = F.array_sort(F.collect_list(F.struct("placeholder", "n")))
    return counts.groupBy(doc).agg(F.map_from_entries(entries).alias("pii_found"))


def total_replacements(counts: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Total per document, and for the run in the row where ``doc`` is null."""
    return counts.rollup(doc).agg(F.sum("n").alias("total"))


def summary_sorted(counts: DataFrame) -> DataFrame:
    """Run summary by placeholder."""
    return counts.groupBy("placeholder").agg(F.sum("n").alias("n")).orderBy("placeholder")


def collect_spans(rows: DataFrame, unit: str = "unit_id") -> DataFrame:
    """Span rows (``unit, entity, start, end, score, src``) gathered into one array per unit.

    The array is bounded by the text of the unit.
    """
    span = F.struct("entity", "start", "end", F.col("score").cast("double").alias("score"), "src").cast(SPAN_TYPE)
    return rows.groupBy(unit).agg(F.collect_list(span).alias("spans"))


def resolve_spans(rows: DataFrame, unit: str = "unit_id") -> DataFrame:
    """Overlap resolution of span rows: the kept ones, as rows."""
    kept = exploded(collect_spans(rows, unit), [unit], resolve(F.col("spans")), "s")
    return kept.select(unit, "s.*")


def with_placeholder(rows: DataFrame, entity: str = "entity") -> DataFrame:
    return rows.withColumn("placeholder", placeholder_of(F.col(entity)))
