"""Lines that repeat across documents, found by a range-partitioned sort of their hashes.

Every document gives one row for each distinct key of its lines (key: stripped of ``[\\x20\\x09-\\x0D]`` at both ends, A-Z
lower-cased, at least ``min_chars`` code points). The rows are range-partitioned by hash and document, sorted by hash and
descending document, and streamed: the first document of a hash keeps its lines, the others lose them once the hash is seen
in ``min_docs`` documents. A hash may run over several partitions, so a hot line is split: of its rows at the edge of a
partition at most ``min_docs`` stay undecided, and these few are settled by a second, small grouping. The result is a
compressed bitmap of the lines to keep for each document that loses any; texts are never moved for the decision.

Cases: a null or empty text has one empty line; lines shorter than ``min_chars`` always stay; a line that repeats inside one
document counts once, and stays each time in the document that keeps it; rows that repeat an id and its text share the
decision; an empty table gives no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from sladd.llm.common import fingerprint, parts, short_batches, text_bytes, tidy, written

BLANK = b" \t\n\x0b\x0c\r"
MIN_CHARS, MIN_DOCS = 20, 3
ROW = "h binary, doc long, fp long, n int, places array<int>"


def line_key(line: bytes, min_chars: int) -> bytes | None:
    key = line.strip(BLANK)
    if len(key) < min_chars or (len(key) < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars):
        return None
    return key.lower()


def _lines(min_chars):
    def run(batches):
        for batch in batches:
            rows = []
            for doc, fp, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), text_bytes(batch.column(2))):
                lines, found = text.split(b"\n"), {}
                for i, line in enumerate(lines):
                    key = line_key(line, min_chars)
                    if key is not None:
                        found.setdefault(xxhash.xxh3_128_digest(key), []).append(i)
                rows += [(h, doc, fp, len(lines), places) for h, places in found.items()]
            yield pa.record_batch(
                [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int32())))],
                names=["h", "doc", "fp", "n", "places"])

    return run


def _stream(min_docs):
    """Decide each hash of a sorted partition; ``seen`` is 0 for decided rows and else the documents of the hash in this partition."""

    def run(batches):
        current, seen, top, opening, waiting = None, 0, None, True, []
        out = []

        def close(last):
            """Settle what waits: rows of the winner, and of too few documents to decide."""
            if (opening or last) and waiting:
                out.extend((*r, seen, i == 0) for i, r in enumerate(waiting))

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[0] != current:
                    if current is not None:
                        close(False)
                        opening = False
                    current, seen, top, waiting = row[0], 1, row[1], [row]
                    before = row[1]
                    continue
                if row[1] != before:
                    seen, before = seen + 1, row[1]
                if row[1] == top:
                    waiting.append(row)
                elif seen < min_docs:
                    waiting.append(row)
                else:
                    if len(waiting) and waiting[-1][1] != top:
                        out.extend((*r, 0, False) for r in waiting if r[1] != top)
                        waiting = [r for r in waiting if r[1] == top]
                    out.append((*row, 0, False))
            if len(out) > 20_000:
                yield _batch(out)
                out = []
        if current is not None:
            close(True)
        yield _batch(out)

    return run


def _batch(rows):
    kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.int64(), pa.bool_())
    names = ["h", "doc", "fp", "n", "places", "seen", "counts"]
    return pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)


def _bitmaps(batches):
    for batch in batches:
        bits = []
        for size, drop in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            keep = np.ones(size, bool)
            keep[drop] = False
            bits.append(zlib.compress(np.packbits(keep).tobytes()))
        counts = [len(x) for x in batch.column(3).to_pylist()]
        yield pa.record_batch([*batch.columns[:3], pa.array(counts, pa.int32()), pa.array(bits, pa.binary())],
                              names=["doc", "fp", "n_lines", "n_dropped", "keep"])


def keep_bitmaps(docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``key, fp, n_lines, n_dropped, keep`` for each document that loses lines; ``keep`` is a zlib-compressed bit for each line."""
    spark = docs.sparkSession
    lines = short_batches(docs).select(F.col(key).cast("long").alias("doc"), fingerprint(text).alias("fp"), F.col(text).alias("text"))
    rows = lines.mapInArrow(tidy(_lines(min_chars)), ROW)
    ordered = rows.repartitionByRange(parts(spark), "h", F.desc("doc")).sortWithinPartitions("h", F.desc("doc"), "fp")
    judged = written(ordered.mapInArrow(tidy(_stream(min_docs)), ROW + ", seen long, counts boolean"))
    edge = judged.filter("seen > 0")
    known = edge.groupBy("h").agg(F.sum(F.when(F.col("counts"), F.col("seen")).otherwise(0)).alias("total"), F.max("doc").alias("top"))
    late = edge.join(F.broadcast(known), "h").filter((F.col("total") >= min_docs) & ~F.col("doc").eqNullSafe(F.col("top")))
    dropped = judged.filter("seen = 0").select("doc", "fp", "n", "places").unionByName(late.select("doc", "fp", "n", "places"))
    per_doc = dropped.groupBy("doc", "fp").agg(F.first("n").alias("n_lines"), F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"))
    maps = per_doc.mapInArrow(_bitmaps, "doc long, fp long, n_lines int, n_dropped int, keep binary")
    return maps.withColumnRenamed("doc", key)


def _apply(batches):
    for batch in batches:
        texts, kept, n_lines, n_dropped = text_bytes(batch.column(1)), [], [], []
        for text, bits in zip(texts, batch.column(2).to_pylist()):
            if bits is None:
                n_lines.append(text.count(b"\n") + 1)
                n_dropped.append(0)
                kept.append(text)
                continue
            lines = text.split(b"\n")
            keep = np.unpackbits(np.frombuffer(zlib.decompress(bits), np.uint8), count=len(lines))
            left = [line for line, k in zip(lines, keep.tolist()) if k]
            n_lines.append(len(lines))
            n_dropped.append(len(lines) - len(left))
            kept.append(b"\n".join(left))
        yield pa.record_batch([batch.column(0), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())],
                              names=["rest", "text", "n_lines", "n_dropped"])


def drop_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """All columns of ``docs`` in ``row``, and ``kept_text, n_lines, n_dropped`` after applying the bitmaps."""
    maps = keep_bitmaps(docs, key, text, min_chars, min_docs).select(F.col(key).alias("doc"), "fp", "keep")
    others = [c for c in docs.columns if c != text]
    base = docs.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("rest"), F.col(text).alias("text"),
                       F.col(key).cast("long").alias("doc"), fingerprint(text).alias("fp"))
    joined = base.join(maps, [base.doc.eqNullSafe(maps.doc), base.fp == maps.fp], "left").select("rest", "text", "keep")
    kind = joined.schema["rest"].dataType.simpleString()
    return joined.mapInArrow(tidy(_apply), f"rest {kind}, text string, n_lines long, n_dropped long")
