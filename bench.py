"""Headline queries on ``$BENCH_SF_DIR`` with ``local[$BENCH_CPUS]``; prints one JSON line.

Every query is planned and run in full; its rows go to the no-op sink. The value is the sum of the seconds of the first
(cold) runs; ``build`` is the part of them that builds the plan, ``warm`` a second run. ``long_texts`` joins the documents of
each source into few very long texts.
"""

import json
import os
import sys
import time

from pyspark.sql import SparkSession, functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from sladd.operators import joins  # noqa: E402
from sladd.plans import queries as registered  # noqa: E402
from sladd.rules.words import DEFAULT_LEXICON  # noqa: E402

HEADLINE = (
    "anonymize_documents", "anonymize_minimum", "anonymize_conversations", "anonymize_page", "audit_records", "special_scan",
    "detect_language", "name_list_join", "overlap_resolve", "typed_table_redact", "cell_header_join", "label_counts_doc",
    "value_propagation", "header_rule", "sample_head", "strip_comments",
)


def long_texts(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").repartition(8, "source")
    long = docs.groupBy("source").agg(F.array_join(F.collect_list("text"), "\n").alias("text"))
    return joins.name_list_join(long, joins.word_table(spark, DEFAULT_LEXICON.names, "name"), unit="source")


def main():
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{folder}/region.parquet").count()
    all_queries, took, build, warm = registered.queries(), {}, {}, {}
    all_queries["long_texts"] = long_texts
    for name in (*HEADLINE, "long_texts"):
        for times in (took, warm):
            start = time.time()
            df = all_queries[name](spark, folder)
            if times is took:
                build[name] = round(time.time() - start, 3)
            df.write.format("noop").mode("overwrite").save()
            times[name] = round(time.time() - start, 3)
    print(json.dumps({
        "metric": "total seconds of headline queries", "value": round(sum(took[n] for n in HEADLINE), 3), "unit": "sec", "queries": took,
        "build": build, "warm": warm, "sf": os.path.basename(os.path.normpath(folder)),
    }))


if __name__ == "__main__":
    main()
