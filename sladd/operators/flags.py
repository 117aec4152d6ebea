"""Special-category flags per document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sladd.functions.text import exploded, holds, let, not_blank, spelled_out, symbol_tree
from sladd.rules.special import SPECIAL_CATEGORIES, SPECIAL_KEYS


def terms_pattern(terms) -> str:
    """Whole-word pattern for lower-case text in which terms share their prefixes."""
    return rf"(?U)\b{symbol_tree(v for term in terms for v in spelled_out(term))}\b"


_BY_KEY = dict(zip(SPECIAL_KEYS, SPECIAL_CATEGORIES))
_ANY = terms_pattern([t for _, terms in SPECIAL_CATEGORIES for t in terms])


def has_category(text: Column, key: str) -> Column:
    """True when a text holds a term of one category."""
    return F.coalesce(holds(F.lower(text), terms_pattern(_BY_KEY[key][1])), F.lit(False))


def special_categories(text: Column) -> Column:
    """Labels of all categories found, in table order; empty for blank text.

    One pass looks for any term; the nine passes that tell categories apart run only on texts with one.
    """

    def labels(low):
        each = [F.when(holds(low, terms_pattern(terms)), F.lit(label)) for label, terms in SPECIAL_CATEGORIES]
        return F.when(holds(low, _ANY), F.array_compact(F.array(*each)))

    none = F.expr("cast(array() as array<string>)")
    return F.coalesce(F.when(not_blank(text), let(F.lower(text), labels)), none)


def manual_review(categories: Column) -> Column:
    return F.size(categories) > 0


def special_summary(flagged: DataFrame, categories: str = "categories") -> DataFrame:
    """Documents per category; the row with category null counts the documents that need manual review.

    One pass: each document contributes its labels and, if it has any, one label for the total.
    """
    total = "*"
    labels = F.when(manual_review(F.col(categories)), F.concat(F.col(categories), F.array(F.lit(total))))
    counted = exploded(flagged, [], labels, "category").groupBy("category").agg(F.count(F.lit(1)).alias("documents"))
    return counted.withColumn("category", F.when(F.col("category") != total, F.col("category")))
