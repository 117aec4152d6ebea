"""URL filtering with mined association rules, in DataFrame functions only.

URLs of labelled pages become sets of host and path tokens plus their label. Frequent tokens that occur in exactly the same
labelled rows are one item, so that a long URL with many labels is one item rather than all subsets of its tokens. Spark's
FP-growth mines the frequent combinations of items; those that imply the label ``block`` with enough confidence and support are the rules. A rule stands in an
inverted index under its rarest item, so a URL meets only rules whose rarest item it has, and each of these is then
compared in full. A URL has an item if it has one of its tokens: each of them alone has the item's support and confidence.
A rule with more items and no more confidence than one that its items contain is pruned: it decides nothing.
A list of host and path rules comes first and is matched row by row.

Cases: a null URL or one without ``://`` has an empty host and path and meets no rule, so it is allowed; the longest of
several list rules wins; equal URLs share one look-up; without labels nothing is mined; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, functions as F

from sladd.llm.common import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ADDRESS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: Verdict and rule, a host followed by the start of a path.
LISTED = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: List rules are matched row by row, so there may be so many at most.
MAX_LISTED = 1000
SUPPORT, LEAST_ROWS, CONFIDENCE = 0.002, 5, 0.5
BLOCK = "!block"


def address(url: Column) -> tuple[Column, Column]:
    """Host, with A-Z lower-cased, and path; both empty for a null URL or one without ``://``."""
    text = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(text, ADDRESS, 1), UPPER, LOWER), F.regexp_extract(text, ADDRESS, 2)


def url_tokens(host: Column, path: Column) -> Column:
    """Distinct tokens: labels of the host as ``h:``, alphanumeric parts of the path as ``p:``."""
    def tagged(text, split, tag):
        found = F.filter(F.split(text, split), lambda x: x != "")
        return F.transform(found, lambda x: F.concat(F.lit(tag), x))

    return F.array_distinct(F.concat(tagged(host, r"\.", "h:"), tagged(F.translate(path, UPPER, LOWER), r"[^0-9a-z]+", "p:")))


def listed_rule(host: Column, path: Column, rules=LISTED) -> Column:
    """The longest list rule that fits, as a struct ``length, rule, verdict``; null if none fits."""
    if len(rules) > MAX_LISTED:
        raise ValueError(f"more than {MAX_LISTED} list rules")
    entries = []
    for verdict, rule in rules:
        start, _, rest = rule.partition("/")
        fits = ((host == start) | host.endswith("." + start)) & path.startswith("/" + rest)
        entries.append(F.when(fits, F.struct(F.lit(len(rule)).alias("length"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.array_max(F.array(*entries)) if entries else F.lit(None).cast("struct<length:int,rule:string,verdict:string>")


def least_rows(n: int, support: float, least: int) -> int:
    return max(least, math.ceil(support * n))


def same_rows(labelled: DataFrame, tokens: str = "tokens", support: float = SUPPORT, least: int = LEAST_ROWS) -> DataFrame:
    """``token, item`` of the frequent tokens; tokens of exactly the same rows share an item, the first of them by name.

    Rows are told apart by their number ``row``; a set of rows is known by its size, a sum and an exclusive or of two hashes.
    """
    a, b = F.xxhash64("row"), F.xxhash64("row", F.lit(1))
    each = labelled.select(F.explode(tokens).alias("token"), a.cast("decimal(38,0)").alias("a"), b.alias("b"))
    sets = each.groupBy("token").agg(F.count("*").alias("n"), F.sum("a").alias("a"), F.bit_xor("b").alias("b"))
    often = sets.filter(F.col("n") >= least_rows(labelled.count(), support, least))
    first = often.groupBy("n", "a", "b").agg(F.min("token").alias("item"))
    return often.join(first, ["n", "a", "b"]).select("token", "item")


def as_items(rows: DataFrame, classes: DataFrame, tokens: str = "tokens") -> DataFrame:
    """The same rows with the items of their tokens instead; rows without any are left out."""
    rest = [c for c in rows.columns if c != tokens]
    numbered = rows.withColumn("token", F.explode(tokens)).drop(tokens)
    return numbered.join(classes, "token").groupBy(*rest).agg(F.collect_set("item").alias(tokens))


def mine(labelled: DataFrame, tokens: str = "tokens", block: str = "block", support: float = SUPPORT, least: int = LEAST_ROWS,
         confidence: float = CONFIDENCE) -> DataFrame:
    """``rule_tokens, confidence, key`` of the rules for blocking, over the items that :func:`judge` makes; ``key`` is the rarest."""
    n = labelled.count()
    rows = least_rows(n, support, least)
    items = labelled.select(F.concat(F.col(tokens), F.when(F.col(block), F.array(F.lit(BLOCK))).otherwise(F.array().cast("array<string>"))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, (rows - 0.5) / max(n, 1)), minConfidence=confidence).fit(items)
    rules = model.associationRules.filter(F.col("consequent") == F.array(F.lit(BLOCK))).select(F.array_sort("antecedent").alias("rule_tokens"), "confidence")
    often = model.freqItemsets.filter(F.size("items") == 1).select(F.col("items")[0].alias("token"), "freq")
    spread = rules.select("rule_tokens", "confidence", F.explode("rule_tokens").alias("token")).join(often, "token")
    index = spread.groupBy("rule_tokens", "confidence").agg(F.min_by("token", F.struct("freq", "token")).alias("key"))
    general = index.select(F.col("rule_tokens").alias("g"), F.col("confidence").alias("gc"), F.col("key").alias("gk"))
    inside = index.select("rule_tokens", "confidence", F.explode("rule_tokens").alias("gk"))
    covered = inside.join(general, "gk").filter(
        (F.size("g") < F.size("rule_tokens")) & (F.size(F.array_except("g", "rule_tokens")) == 0) & (F.col("gc") >= F.col("confidence")))
    return index.join(covered.select("rule_tokens").distinct(), "rule_tokens", "left_anti")


def judge(pages: DataFrame, labels: DataFrame, url: str = "url", key: str = "page_id", label_key: str = "doc_id", rules=LISTED, **limits) -> DataFrame:
    """``key, host, path, rule, verdict, confidence``; a label with ``toxic = 1`` or ``quality = 0`` asks for blocking."""
    host, path = address(F.col(url))
    base = pages.select(F.col(key), F.col(url).alias("url"), host.alias("host"), path.alias("path"))
    distinct = base.select("url", "host", "path").distinct().select("url", url_tokens(F.col("host"), F.col("path")).alias("tokens"))
    marks = labels.groupBy(F.col(label_key).alias("mark")).agg(F.max((F.coalesce("toxic", F.lit(0)) == 1) | (F.coalesce("quality", F.lit(1)) == 0)).alias("block"))
    labelled = base.join(marks, base[key] == marks.mark).select(url_tokens(F.col("host"), F.col("path")).alias("tokens"), "block")
    bounds = {k: v for k, v in limits.items() if k in ("support", "least")}
    # stored, so that the number of a row is the same whenever a task runs again
    labelled = written(labelled.withColumn("row", F.monotonically_increasing_id()))
    classes = written(same_rows(labelled, **bounds))
    # a row without frequent tokens counts, though no rule can hold for it
    some = labelled.select("row", "block", F.explode_outer("tokens").alias("token")).join(classes, "token", "left")
    mined = written(mine(some.groupBy("row", "block").agg(F.collect_set("item").alias("tokens")), **limits))
    met = as_items(distinct.select("url", "tokens"), classes)
    met = met.select("url", "tokens", F.explode("tokens").alias("key")).join(mined, "key")
    met = met.filter(F.size(F.array_except("rule_tokens", "tokens")) == 0).groupBy("url").agg(F.max("confidence").alias("confidence"))
    out = base.join(met, "url", "left").withColumn("listed", listed_rule(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce("listed.verdict", F.when(F.col("confidence").isNotNull(), "block").otherwise("allow"))
    return out.select(key, "host", "path", F.col("listed.rule").alias("rule"), verdict.alias("verdict"), "confidence")
