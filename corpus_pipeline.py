"""Corpus pipeline: language, repeated lines, near duplicates, benchmark passages, token ids.

Each stage reads what its predecessor wrote and returns the columns of ``documents``; the last returns token ids.
"""

from pyspark.sql import functions as F

from sladd.llm import bpe, decontaminate, jaccard_join, language_id, line_dedup
from sladd.llm.common import table, written


def language(spark, docs, sf_dir):
    """Documents stay whose text is near a centroid of some language; the model is learnt from the labelled documents."""
    model = language_id.train(docs)
    judged = language_id.identify(docs, model, docs.columns)
    return judged.filter(~F.col("rejected")).select("rest.*")


def lines(spark, docs, sf_dir):
    """Lines that three documents share stay in one of them; a document keeps its row even if no line is left."""
    kept = line_dedup.drop_lines(docs)
    return kept.select(*[F.col("text") if c == "text" else F.char_length("text").cast("long").alias(c) if c == "n_chars" else F.col(f"rest.`{c}`") for c in docs.columns])


def near_duplicates(spark, docs, sf_dir):
    """Of each class of near duplicates, the document with the smallest id stays; rows that repeat its id stay with it."""
    classes = jaccard_join.similarity_classes(docs)
    stay = classes.filter(F.col("doc_id").eqNullSafe(F.col("class_id"))).select(F.col("doc_id").alias("stays")).distinct()
    return docs.join(stay, docs.doc_id.eqNullSafe(stay.stays), "left_semi")


def benchmark_passages(spark, docs, sf_dir):
    """Benchmark passages are cut out; a document that is mostly such passages goes."""
    clean = decontaminate.remove_contamination(docs, table(spark, sf_dir, "benchmark"))
    return clean.withColumn("n_chars", F.char_length("text").cast("long"))


def token_ids(spark, docs, sf_dir):
    """Ids of every document as little-endian unsigned 32-bit integers, and a digest of the text that they decode to."""
    out = bpe.encode_decode(docs)
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_duplicates), ("benchmark_passages", benchmark_passages), ("token_ids", token_ids)]

#: Language centroids and tokenisation are beyond SQL; the stages are tested one by one.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
