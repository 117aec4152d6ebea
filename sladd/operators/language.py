"""Language identification from character trigrams, and the gate built on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from sladd.functions.text import exploded, strip
from sladd.rules.languages import (
    MIN_PROBABILITY, MIN_SAMPLE_CHARS, NORWEGIAN_TRAINING_TEXT, SAMPLE_CHARS, SUPPORTED_LANGUAGES,
)

LANGUAGES = ("de", "en", "es", "fr", "no")
PROFILE_SIZE = 400
MAX_PROFILE_ROWS = 10_000


def sample(text: Column) -> Column:
    return F.substring(text, 1, SAMPLE_CHARS)


def sample_head(blocks: DataFrame, container: str, order: str, text: str, k: int) -> DataFrame:
    """Text of the first k blocks of each container, joined by spaces and cut to the sample size.

    The row-number limit is applied before and after the shuffle, so a huge container sends k rows per task.
    """
    window = Window.partitionBy(container).orderBy(order)
    head = blocks.select(container, order, text).withColumn("_n", F.row_number().over(window)).where(F.col("_n") <= k)
    ordered = F.array_sort(F.collect_list(F.struct(order, text)))
    joined = F.array_join(F.transform(ordered, lambda b: b[text]), " ")
    return head.groupBy(container).agg(sample(joined).alias("sample"))


def trigrams(text: Column) -> Column:
    """Overlapping trigrams of the lower-case letters; runs of other characters count as one space."""
    letters = F.regexp_replace(F.lower(text), r"[^\p{L}]+", " ")
    return F.regexp_extract_all(F.concat(F.lit(" "), letters, F.lit(" ")), F.lit(r"(?s)(?=(.{3}))"), 1)


def train_profiles(labelled: DataFrame, text: str = "text", lang: str = "lang", languages=LANGUAGES,
                   size: int = PROFILE_SIZE) -> DataFrame:
    """Log-probabilities of the most frequent trigrams: ``tri, lp`` with one entry per language.

    Whole texts are counted. At most ``size`` trigrams per language are kept, a parameter of the model, so the
    table is bounded whatever the corpus.
    """
    rows = labelled.select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    own = labelled.sparkSession.range(1).select(F.lit("no").alias("lang"), F.lit(NORWEGIAN_TRAINING_TEXT).alias("text"))
    labelled_text = rows.unionByName(own).where(F.col("lang").isin(*languages))
    counted = (
        exploded(labelled_text, ["lang"], trigrams(F.col("text")), "tri")
        .groupBy("lang", "tri")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "tri")
    share = F.col("n") / F.sum("n").over(Window.partitionBy("lang"))
    top = counted.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= size).withColumn("p", share)
    floor = 1e-5
    lp = [F.log(F.coalesce(F.max(F.when(F.col("lang") == x, F.col("p"))), F.lit(floor))) for x in languages]
    return top.groupBy("tri").agg(F.array(*lp).alias("lp"))


def checked(profiles: DataFrame) -> DataFrame:
    """The profiles as a local table of at most MAX_PROFILE_ROWS rows, which may be broadcast."""
    rows = profiles.limit(MAX_PROFILE_ROWS + 1).collect()
    if len(rows) > MAX_PROFILE_ROWS:
        raise ValueError(f"more than {MAX_PROFILE_ROWS} trigrams in the profiles")
    return profiles.sparkSession.createDataFrame(rows, profiles.schema)


def language_scores(docs: DataFrame, profiles: DataFrame, doc: str = "doc_id", text: str = "text",
                    languages=LANGUAGES) -> DataFrame:
    """``doc, scores``: an array of ``struct<p, lang>`` for every document, null where the sample is too short to tell.

    One scan and one shuffle: trigrams meet the broadcast profiles, and their sums are taken before the shuffle.
    """
    long = F.length(strip(F.col(text))) >= MIN_SAMPLE_CHARS
    cut = docs.select(doc, F.when(long, sample(F.col(text))).alias("text"))
    grams = cut.select(doc, F.explode_outer(trigrams(F.col("text"))).alias("tri"))
    sums = grams.join(F.broadcast(checked(profiles)), "tri", "left").groupBy(doc).agg(
        *[F.sum(F.col("lp")[i]).alias(f"s{i}") for i in range(len(languages))]
    )
    best = F.greatest(*[F.col(f"s{i}") for i in range(len(languages))])
    weights = [F.exp(F.col(f"s{i}") - best) for i in range(len(languages))]
    total = sum(weights[1:], weights[0])
    each = F.array(*[F.struct((w / total).alias("p"), F.lit(x).alias("lang")) for x, w in zip(languages, weights)])
    return sums.select(doc, F.when(best.isNotNull(), each).alias("scores"))


def top_language(scores: DataFrame, doc: str = "doc_id") -> DataFrame:
    """``doc, lang, p``: the best language of each document, null where there is none."""
    top = scores.select(doc, F.array_max("scores").alias("top"))
    return top.select(doc, F.col("top.lang").alias("lang"), F.col("top.p").alias("p"))


def detect_language(docs: DataFrame, profiles: DataFrame, doc: str = "doc_id", text: str = "text",
                    languages=LANGUAGES) -> DataFrame:
    """``doc, language``: null for short samples and for uncertain ones."""
    best = top_language(language_scores(docs, profiles, doc, text, languages), doc)
    return best.select(doc, F.when(F.col("p") >= MIN_PROBABILITY, F.col("lang")).alias("language"))


def is_supported(lang: Column) -> Column:
    return lang.isNull() | lang.isin(*SUPPORTED_LANGUAGES)


def language_gate(docs: DataFrame, lang: str = "lang") -> DataFrame:
    """Documents and warnings per language; nothing is dropped."""
    return docs.groupBy(F.coalesce(F.col(lang), F.lit("unknown")).alias("lang")).agg(
        F.count(F.lit(1)).alias("documents"), F.count_if(~is_supported(F.col(lang))).alias("warnings")
    )
