"""Exact duplicates with a heavy-hitter split.

Each row gets the SHA-256 of its text after lower-casing A-Z. Misra-Gries counters of every partition, added up, name the
digests that may be frequent; their true counts and winners are computed over all rows (partial sums first) and, being at
most ``4 * counters`` rows by construction, go to the rows by broadcast. All other digests take an ordinary shuffle, in
which no group can hold more than about ``2 / counters`` of the rows.

Cases: a null text counts as empty; of equal texts the largest id stays; rows that repeat the winning id all count as
staying; a null id never wins against another id; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from sladd.llm.common import short_batches, text_bytes, written

COUNTERS = 1024


def text_digests(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, digest`` (32 bytes) of the text with A-Z lower-cased."""

    def digest(batches):
        for batch in batches:
            found = [hashlib.sha256(t.lower()).digest() for t in text_bytes(batch.column(1))]
            yield pa.record_batch([batch.column(0), pa.array(found, pa.binary())], names=["key", "digest"])

    schema = f"key {docs.schema[key].dataType.simpleString()}, digest binary"
    return short_batches(docs).select(F.col(key), F.col(text)).mapInArrow(digest, schema)


def frequent(digests: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """Digests that may hold over ``2 / counters`` of the rows, as Misra-Gries lower bounds; at most ``4 * counters`` rows."""

    def count(batches):
        held: Counter = Counter()
        n = 0
        for batch in batches:
            n += batch.num_rows
            held.update(batch.column(0).to_pylist())
            if len(held) > counters:  # the merge of two summaries takes off the (counters + 1)-th largest
                cut = sorted(held.values(), reverse=True)[counters]
                held = Counter({k: v - cut for k, v in held.items() if v > cut})
        yield pa.record_batch([pa.array([*held, None], pa.binary()), pa.array([*held.values(), n], pa.int64())], names=["digest", "low"])

    lows = digests.select("digest").mapInArrow(count, "digest binary, low long").groupBy("digest").agg(F.sum("low").alias("low"))
    lows = written(lows)
    n = lows.filter(F.col("digest").isNull()).agg(F.max("low")).first()[0] or 0
    return lows.filter(F.col("digest").isNotNull() & (F.col("low") > 1) & (F.col("low") >= n / (4 * counters))).select("digest")


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", counters: int = COUNTERS) -> DataFrame:
    """``key, digest, keep_id, group_size, kept`` for every row."""
    digests = written(text_digests(docs, key, text))
    candidates = F.broadcast(frequent(digests, counters))
    winners = written(
        digests.join(candidates, "digest", "left_semi")
        .groupBy("digest").agg(F.max("key").alias("keep_id"), F.count("*").alias("group_size"))
    )
    hot = digests.join(F.broadcast(winners), "digest")
    same = Window.partitionBy("digest")
    rest = digests.join(F.broadcast(winners), "digest", "left_anti").select(
        "digest", "key", F.max("key").over(same).alias("keep_id"), F.count("*").over(same).alias("group_size")
    )
    out = hot.unionByName(rest)
    return out.select(F.col("key").alias(key), "digest", "keep_id", "group_size", F.col("key").eqNullSafe(F.col("keep_id")).alias("kept"))
