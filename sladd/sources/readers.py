"""Readers: text units, CSV as text, typed tables and the input manifest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sladd.rules.media import AUDIO_SUFFIXES, IMAGE_SUFFIXES, SUPPORTED_SUFFIXES, VIDEO_SUFFIXES
from sladd.sources.records import fields, unquoted

CORRUPT = "_corrupt_record"
#: Rows of a task where a table is dealt out.
DEALT_ROWS = 20_000


def decode(content: Column) -> Column:
    """UTF-8 without byte-order mark, else Latin-1; line ends become newlines."""
    utf8 = content.cast("string")
    text = F.when(F.is_valid_utf8(utf8), F.regexp_replace(utf8, "\\A\ufeff", "")).otherwise(
        F.decode(content, "ISO-8859-1")
    )
    return F.regexp_replace(text, "\r\n?", "\n")


def decode_units(df: DataFrame, unit: str, content: str = "content") -> DataFrame:
    return df.select(unit, decode(F.col(content)).alias("text"))


def read_text_units(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: ``path, text``. Spark gives no row for an empty file."""
    return decode_units(spark.read.format("binaryFile").load(path), "path")


def read_csv_text(spark: SparkSession, path: str, multi_line: bool = True, overflow: str | None = "overflow") -> DataFrame:
    """CSV with a header, every column as text. Short rows are padded with nulls.

    Cells beyond the header go to the array ``overflow`` (null for other rows); with ``overflow=None`` a longer row
    raises an error. ``multi_line`` allows line ends inside quotes but makes each file one task; turn it off for large
    files without them, or read large files with them by ``records.read_csv_records``.
    """
    options = {"header": True, "multiLine": multi_line, "escape": '"', "encoding": "UTF-8"}
    header = spark.read.options(**options, inferSchema=False).csv(path).schema
    names = [f.name for f in header.fields]
    read = spark.read.options(**options, columnNameOfCorruptRecord=CORRUPT).schema(header.add(CORRUPT, "string")).csv(path)
    raw = fields(F.regexp_replace(CORRUPT, r"[\r\n]+\z", ""))
    columns = [F.col(f"`{n}`") for n in names]
    longer = F.size(raw) > len(names)
    if overflow is None:
        fits = F.assert_true(~F.coalesce(longer, F.lit(False)), F.lit("a row has more cells than the header"))
        return read.where(fits.isNull()).select(*columns)
    extra = F.slice(raw, len(names) + 1, F.greatest(F.size(raw) - len(names), F.lit(0)))
    return read.select(*columns, F.when(longer, F.transform(extra, unquoted)).alias(overflow))


def read_typed_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def spread(df: DataFrame, partitions: int) -> DataFrame:
    """Deal a small input of few row groups out over more tasks. It shuffles, so the caller decides."""
    return df.repartition(partitions)


def dealt(df: DataFrame) -> DataFrame:
    """A read table, dealt out to tasks of about ``DEALT_ROWS`` rows if a split holds over four times that or twice a core's share.

    The number of splits says little: a Parquet row group goes to one split whole, and the splits beside it are empty. So the rows
    of each split are counted, which reads no column.
    """
    counts = df.groupBy(F.spark_partition_id().alias("split")).agg(F.count(F.lit(1)).alias("n"))
    rows, most = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    cores = df.sparkSession.sparkContext.defaultParallelism
    uneven = most * cores > 2 * rows or most > 4 * DEALT_ROWS
    return spread(df, max(cores, -(-rows // DEALT_ROWS))) if uneven else df


def manifest_triage(df: DataFrame, path: str) -> DataFrame:
    """Add ``suffix`` and ``kind``: supported, image, video, audio or unsupported."""
    suffix = F.lower(F.regexp_extract(F.col(path), r"(\.[^./]+)$", 1))
    kind = (
        F.when(suffix.isin(*SUPPORTED_SUFFIXES), "supported")
        .when(suffix.isin(*IMAGE_SUFFIXES), "image")
        .when(suffix.isin(*VIDEO_SUFFIXES), "video")
        .when(suffix.isin(*AUDIO_SUFFIXES), "audio")
        .otherwise("unsupported")
    )
    return df.withColumn("suffix", suffix).withColumn("kind", kind)
