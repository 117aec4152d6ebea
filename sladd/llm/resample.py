"""Importance resampling towards a target distribution, with hashed word n-grams.

A text becomes its words joined by one space, and its bytes are scanned once. The scan stores running CRCs: the CRC of every
prefix that ends at a word's edge, moved back to the start of the buffer. The CRC of any n-gram then comes from the two
prefixes at its ends alone: their xor cancels what stands before the n-gram, and one shift in GF(2) moves the rest to the
n-gram's end. No n-gram is ever built as a string, so longer n-grams cost no more than single words.

Each task adds its features up in one array of ``buckets`` counts, so at most that many rows a task are shuffled. The gains,
one number a bucket, travel to the tasks, which scan the texts a second time: that costs less than moving or storing the
buckets of all features. The draw adds a Gumbel number from a hash of the id to each weight and keeps the highest scores,
which is sampling without replacement in proportion to ``exp(weight / 1000)``. Ranks come from a range partitioning by score
and the sizes of the ranges; no task sees all rows.

Cases: a null or empty text and one without words have no features, weight 0, and are never drawn, though scored; a null id
scores as an empty id and loses ties; repeated rows count each; rows equal in score and id are ranked in the order in which
they were stored; an empty target gives every bucket the gain of its rarity alone; an empty table gives no rows; texts longer
than ``BLOCK`` bytes are scanned in pieces that overlap by ``size - 1`` words; other columns are not read.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from sladd.llm.common import LOWER, WORD_BYTE, groups, parts, short_batches, text_bytes, written

#: Bytes that are scanned at a time, and positions of the table of shifted bits; a longer word takes the table block by block.
BLOCK = 1 << 15
SPACE = 0x20


def _one_byte(values: np.ndarray) -> np.ndarray:
    """Shift CRCs over one zero byte."""
    table = np.array([zlib.crc32(bytes([k])) ^ zlib.crc32(b"\0") for k in range(256)], np.uint32)
    return table[values & np.uint32(255)] ^ (values >> np.uint32(8))


def _as_tables(columns: np.ndarray) -> np.ndarray:
    """A linear map on 32 bits, given by its images of single bits, as four tables of 256 by the byte that they read."""
    tables = np.zeros((4, 256), np.uint32)
    for bit in range(32):
        has = (np.arange(256) >> (bit % 8)) & 1 == 1
        tables[bit // 8, has] ^= columns[bit]
    return tables


def _apply(tables: np.ndarray, values: np.ndarray) -> np.ndarray:
    out = tables[0][values & np.uint32(255)]
    for k in range(1, 4):
        out ^= tables[k][(values >> np.uint32(8 * k)) & np.uint32(255)]
    return out


def _inverse(columns: np.ndarray) -> np.ndarray:
    """Gauss-Jordan elimination over GF(2)."""
    rows = [(int(c), 1 << k) for k, c in enumerate(columns)]
    for bit in range(32):
        at = next(i for i in range(bit, 32) if rows[i][0] >> bit & 1)
        rows[bit], rows[at] = rows[at], rows[bit]
        pivot = rows[bit]
        rows = [r if i == bit or not r[0] >> bit & 1 else (r[0] ^ pivot[0], r[1] ^ pivot[1]) for i, r in enumerate(rows)]
    # rows[bit] holds which single bits map to ``1 << bit`` together
    return np.array([r[1] for r in rows], np.uint32)


@dataclass
class Crcs:
    """Tables of shifts in GF(2); built on the driver, they travel to the tasks."""

    forth: list[np.ndarray]  # shifts over 2^k zero bytes
    back: list[np.ndarray]
    bits: np.ndarray  # [k, j]: bit k of a byte, moved back over j bytes, for j within a block

    @classmethod
    def tables(cls) -> "Crcs":
        single = np.uint32(1) << np.arange(32, dtype=np.uint32)
        forth, back = [_as_tables(_one_byte(single))], [_as_tables(_inverse(_one_byte(single)))]
        for _ in range(40):
            for t in (forth, back):
                t.append(_as_tables(_apply(t[-1], _apply(t[-1], single))))
        bits = np.zeros((8, BLOCK), np.uint32)
        bits[:, 0] = single[:8]
        for k in range(BLOCK.bit_length() - 1):
            bits[:, 1 << k : 2 << k] = _apply(back[k], bits[:, : 1 << k])
        return cls(forth, back, bits)

    def shift(self, values: np.ndarray, over: np.ndarray, back: bool = False) -> np.ndarray:
        """CRCs after so many zero bytes each, or before them."""
        out = values.copy()
        for k in range(int(over.max()).bit_length() if len(over) else 0):
            at = np.flatnonzero((over >> k) & 1)
            out[at] = _apply((self.back if back else self.forth)[k], out[at])
        return out

    def running(self, buffer: np.ndarray) -> np.ndarray:
        """CRCs of all prefixes (n + 1), without initial and final inversion, each moved back to the buffer's start."""
        out = np.zeros(len(buffer) + 1, np.uint32)
        for start in range(0, len(buffer), BLOCK):
            block = buffer[start : start + BLOCK]
            moved = np.zeros(len(block), np.uint32)
            for k in range(8):
                moved ^= self.bits[k, : len(block)] * ((block >> np.uint8(k)) & np.uint8(1))
            local = np.bitwise_xor.accumulate(moved)
            if start:
                local = self.shift(local, np.full(len(local), start), back=True) ^ out[start]
            out[start + 1 : start + 1 + len(block)] = local
        return out

    def ngrams(self, prefixes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """CRC-32 of the bytes from each start to its end, as zlib gives it."""
        full = np.uint32(0xFFFFFFFF)
        # the initial inversion is a prefix of ones that is shifted over the n-gram
        ones = self.shift(np.full(len(starts), full), ends - starts)
        return self.shift(prefixes[starts] ^ prefixes[ends], ends) ^ ones ^ full


def normalised(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of all texts joined by one space: buffer, length of each word, first word of each text (n + 1)."""
    low = LOWER[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
    inside = WORD_BYTE[low]
    edge = np.flatnonzero(np.diff(inside, prepend=False))
    kept = inside.copy()
    kept[edge[1::2]] = True
    buffer = np.where(inside, low, np.uint8(SPACE))[kept]
    first = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=first[1:])
    return buffer, edge[1::2] - edge[::2], np.searchsorted(edge[::2], first)


def features(texts: list[bytes], size: int, buckets: int, crcs: Crcs):
    """Buckets of all runs of 1 to ``size`` words: pairs of arrays, the number of the text and the bucket."""
    buffer, lengths, first = normalised(texts)
    bounds = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths + 1, out=bounds[1:])
    last_of = np.repeat(first[1:], np.diff(first))
    text_of = np.repeat(np.arange(len(texts)), np.diff(first))
    b = 0
    while b < len(lengths):
        a, b = b, max(b + 1, int(np.searchsorted(bounds, bounds[b] + BLOCK, "right")) - 1)
        reach = min(b + size - 1, len(lengths))
        prefixes = crcs.running(buffer[bounds[a] : bounds[reach]])
        for n in range(1, size + 1):
            at = np.arange(a, b)
            at = at[at + n <= last_of[a:b]]
            found = crcs.ngrams(prefixes, bounds[at] - bounds[a], bounds[at + n] - 1 - bounds[a])
            yield text_of[at], found % np.uint32(buckets)


def bucket_counts(docs: DataFrame, text: str = "text", size: int = 1, buckets: int = 10_000) -> DataFrame:
    """``bucket, n``: features of all texts by bucket."""
    crcs = Crcs.tables()

    def count(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            texts = text_bytes(batch.column(0))
            for a, b in groups(texts):
                for _, found in features(texts[a:b], size, buckets, crcs):
                    total += np.bincount(found, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    rows = short_batches(docs).select(text).mapInArrow(count, "bucket long, n long")
    return rows.groupBy("bucket").agg(F.sum("n").alias("n"))


def _dense(counts: DataFrame, buckets: int) -> np.ndarray:
    """At most ``buckets`` rows on the driver."""
    out = np.zeros(buckets, np.int64)
    for row in counts.collect():
        out[row.bucket] = row.n
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log ratio of the smoothed shares of each bucket in the target and in the raw corpus, in thousandths."""
    s, t, buckets = raw.astype(np.float64), target.astype(np.float64), float(len(raw))
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, key: str = "doc_id", text: str = "text", size: int = 1) -> DataFrame:
    """``key, n_words, n_features, weight``: the floored mean gain over a text's features."""
    buckets, kind, crcs = len(gain), docs.schema[key].dataType.simpleString(), Crcs.tables()

    def run(batches):
        for batch in batches:
            texts = text_bytes(batch.column(1))
            for a, b in groups(texts):
                _, _, first = normalised(texts[a:b])
                number, total = np.zeros(b - a, np.int64), np.zeros(b - a, np.int64)
                for text_of, found in features(texts[a:b], size, buckets, crcs):
                    number += np.bincount(text_of, minlength=b - a)
                    np.add.at(total, text_of, gain[found])
                weight = total // np.maximum(number, 1)
                yield pa.record_batch([batch.column(0).slice(a, b - a), pa.array(np.diff(first)), pa.array(number), pa.array(weight)],
                                      names=["key", "n_words", "n_features", "weight"])

    out = short_batches(docs).select(key, text).mapInArrow(run, f"key {kind}, n_words long, n_features long, weight long")
    return out.withColumnRenamed("key", key)


def draw(weighted: DataFrame, percent: int, key: str = "doc_id", least_words: int = 20, seed: int = 2024) -> DataFrame:
    """Add ``score`` and ``rank``; ranks go from 1 to ``percent`` of the rows with enough words, others are null."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = weighted.withColumn("score", F.col("weight") + noise).withColumn("enough", F.col("n_words") >= least_words)
    # stored first, so that the number of a row is the same whenever a task runs again
    scored = written(scored.withColumn("row", F.monotonically_increasing_id()))
    order = [F.col("enough").desc(), F.col("score").desc(), F.col(key).asc_nulls_last(), F.col("row")]
    spread = scored.repartitionByRange(parts(scored.sparkSession), *order).sortWithinPartitions(*order)
    ranged = written(spread.withColumn("at", F.monotonically_increasing_id()))
    # a row's number holds its range in the upper bits; one row a range is what the window sees
    sizes = ranged.groupBy(F.shiftright("at", 33).alias("range")).agg(F.count("*").alias("n"), F.count_if("enough").alias("able"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"), F.sum("able").over(Window.partitionBy()).alias("able"))
    placed = ranged.withColumn("range", F.shiftright("at", 33)).join(F.broadcast(offsets), "range")
    rank = F.col("offset") + F.col("at").bitwiseAND((1 << 33) - 1) + 1
    drawn = F.col("enough") & (rank <= F.floor(F.lit(percent) * F.col("able") / F.lit(100)))
    return placed.withColumn("rank", F.when(drawn, rank)).drop("range", "offset", "able", "at", "row", "enough")


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, key: str = "doc_id", text: str = "text", size: int = 1, buckets: int = 10_000,
             least_words: int = 20, seed: int = 2024) -> DataFrame:
    """``key, n_words, n_features, weight, score, rank`` of every row of ``docs``."""
    raw, wanted = (_dense(bucket_counts(df, text, size, buckets), buckets) for df in (docs, target))
    return draw(weigh(docs, gains(raw, wanted), key, text, size), percent, key, least_words, seed)
