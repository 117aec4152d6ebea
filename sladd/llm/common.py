"""Helpers of the operators: shared folder, Arrow access to texts, vectorised words and hashes."""

from __future__ import annotations

import gc
import sys
import uuid

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sladd.sources.writers import scratch_folder

#: Bytes that belong to words once A-Z are lower-cased: 0-9, a-z and everything beyond ASCII.
WORD_BYTE = np.zeros(256, dtype=bool)
WORD_BYTE[0x30:0x3A] = WORD_BYTE[0x61:0x7B] = WORD_BYTE[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
#: Texts are hashed in groups of about so many bytes, so that the arrays stay small.
GROUP_BYTES = 1 << 20
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def shared_folder(spark: SparkSession) -> str:
    """A fresh path in the folder that driver and executors share: ``spark.checkpoint.dir``, else the warehouse.

    On a cluster, a warehouse on a local disk raises an error, as executors would each write to their own.
    """
    return scratch_folder(spark)


def written(df: DataFrame) -> DataFrame:
    """The same rows, read back from a table in the shared folder: no lineage, and nothing to recompute if executors are lost."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, column: str) -> DataFrame:
    """The same rows from a table in the warehouse, bucketed so that a join on ``column`` need not move them."""
    name = f"sladd_{uuid.uuid4().hex}"
    df.write.bucketBy(parts(df.sparkSession), column).format("parquet").saveAsTable(name)
    return df.sparkSession.table(name)


def packed(values: np.ndarray) -> bytes:
    """Small non-negative integers, compressed by byte planes."""
    planes = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    body = b"".join(((values >> (8 * k)) & 255).astype(np.uint8).tobytes() for k in range(planes))
    return bytes([planes]) + zstandard.ZstdCompressor(level=3).compress(body)


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), np.uint8).reshape(data[0], -1)
    out = planes[0].astype(np.int64)
    for k in range(1, data[0]):
        out |= planes[k].astype(np.int64) << (8 * k)
    return out


def gather(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs ``values[start : start + size]`` one after another."""
    ends = np.cumsum(sizes)
    return values[np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]


def short_batches(df: DataFrame, rows: int = 1000) -> DataFrame:
    """Make Arrow batches of at most so many rows and 16 MB from now on, unless the session asks for less.

    Texts are long, and the defaults of 10,000 rows and 64 MB would let a few batches fill a Python worker's memory.
    """
    if df.sparkSession.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "67108864b":
        df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "16m")
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(name)) <= rows:
        df.sparkSession.conf.set(name, str(rows))
    return df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fingerprint(text: str | Column = "text") -> Column:
    """Tells rows with the same id and different texts apart; null counts as empty."""
    return F.xxhash64(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))


def parts(spark: SparkSession, times: int = 1) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) * times)


def text_bytes(column) -> list[bytes]:
    """The UTF-8 bytes of an Arrow string column, null as empty."""
    return [b or b"" for b in column.cast(pa.large_binary()).to_pylist()]


def groups(texts: list[bytes], limit: int = GROUP_BYTES, most: int = 1 << 20):
    """Index ranges of neighbouring texts of about ``limit`` bytes, and of ``most`` texts."""
    start = size = 0
    for i, text in enumerate(texts):
        if i > start and (size + len(text) > limit or i - start >= most):
            yield start, i
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)


def mix(a: np.ndarray) -> np.ndarray:
    a = a ^ (a >> np.uint64(33))
    a = a * np.uint64(0xFF51AFD7ED558CCD)
    a ^= a >> np.uint64(29)
    a *= np.uint64(0xC4CEB9FE1A85EC53)
    a ^= a >> np.uint64(32)
    return a


def kept(name: str, key, make):
    """``make()``, kept by the worker process under ``name`` until another ``key`` comes.

    Functions of this subpackage travel by value, so that what a task keeps in a global is new for each task and would wait
    for Python's collector; large tables would add up.
    """
    store = vars(sys).setdefault("sladd_kept", {})
    if name not in store or store[name][0] != key:
        store[name] = key, make()
    return store[name][1]


def tidy(run):
    """The same function on batches or a group, after what earlier tasks of the worker left behind is collected."""

    def tidied(batches):
        gc.collect()
        pa.default_memory_pool().release_unused()
        yield from run(batches)

    return tidied


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    def make():
        out = []
        for base in (BASE, INVERSE):
            factor = np.full(max(n, usual), base, np.uint64)
            factor[0] = 1
            out.append(np.cumprod(factor))
        return out

    usual = GROUP_BYTES + GROUP_BYTES // 4
    return kept("powers", usual, make) if n <= usual else make()


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words ``[0-9a-z\\x80-]+`` after lower-casing A-Z: lower-cased buffer, starts, ends, 64-bit hashes, first word of each text (n + 1)."""
    joined = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    low = LOWER[joined]
    inside = WORD_BYTE[low]
    edge = np.flatnonzero(np.diff(inside, prepend=False))
    starts, ends = edge[::2], edge[1::2]
    up, down = _powers(len(low) + 1)
    total = np.zeros(len(low) + 1, np.uint64)
    np.cumsum((low.astype(np.uint64) + np.uint64(1)) * up[: len(low)], out=total[1:])
    hashes = mix((total[ends] - total[starts]) * down[starts])
    first = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=first[1:])
    return low, starts, ends, hashes, np.searchsorted(starts, first)
