"""CSV files as records over many tasks, also where quoted cells hold line ends.

A line starts a record where the quotes before it in the file are even. Spark's text reader cuts files into splits; each split counts
its quotes alone, and a prefix sum over the short table of splits says whether a split starts inside a quoted cell. Records
inside a split are put together where its lines lie; only the pieces of records that cross its end are gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

_QUOTED = r'"[^"]*+(?:""[^"]*+)*+"'
#: Records whose quotes all belong to quoted cells; elsewhere counting quotes could cut a file at the wrong places.
_SOUND = rf'(?s)\A(?:{_QUOTED}|[^",]*+)(?:,(?:{_QUOTED}|[^",]*+))*+\z'


def fields(record: Column) -> Column:
    """The raw cells of a record, quotes included."""
    found = F.regexp_extract_all(F.concat(F.lit(","), record), F.lit(rf"(?s),(?:{_QUOTED}|[^,]*+)"), 0)
    return F.transform(found, lambda c: F.substr(c, F.lit(2)))


def unquoted(cell: Column) -> Column:
    inner = F.replace(F.regexp_replace(cell, r'\A"|"\z', ""), F.lit('""'), F.lit('"'))
    return F.when(cell.startswith('"'), inner).otherwise(cell)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their split, and for both parities at its start: ``key0, key1``, the line that starts the record."""
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("pos"), "value", F.regexp_count("value", F.lit('"')).cast("long").alias("quotes"))
    split = Window.partitionBy("file", "block").orderBy("pos")
    before = F.sum("quotes").over(split) - F.col("quotes")
    lines = lines.withColumn("odd", before % 2)
    return lines.select("*", *[F.max(F.when(F.col("odd") == p, F.col("pos"))).over(split).alias(f"key{p}") for p in (0, 1)])


def _splits(lines: DataFrame) -> DataFrame:
    """A row for each split: parity at its start, the record open there, the file's first line and the parity of all its quotes."""
    own = lines.groupBy("file", "block").agg(F.sum("quotes").alias("n"), F.min("pos").alias("lowest"), F.max("key0").alias("last0"), F.max("key1").alias("last1"))
    file = Window.partitionBy("file").orderBy("block")
    before = file.rowsBetween(Window.unboundedPreceding, -1)
    own = own.withColumn("parity", F.coalesce(F.sum("n").over(before), F.lit(0)) % 2)
    last = F.when(F.col("parity") == 0, F.col("last0")).otherwise(F.col("last1"))
    return own.select("file", "block", "parity", F.last(last, ignorenulls=True).over(before).alias("open"),
                      F.first("lowest").over(file).alias("head"), (F.sum("n").over(Window.partitionBy("file")) % 2).alias("unclosed"))


def raw_records(spark: SparkSession, path: str) -> DataFrame:
    """``record``: each record but the header and empty lines, with the line ends inside its cells."""
    lines = _lines(spark, path)
    both = lines.join(_splits(lines), ["file", "block"])
    key = F.coalesce(F.when(F.col("parity") == 0, F.col("key0")).otherwise(F.col("key1")), F.col("open"))
    closed = F.assert_true(F.col("unclosed") == 0, F.concat(F.lit("a quoted cell is never closed in "), F.col("file")))
    both = both.where(closed.isNull()).withColumn("key", key).where(F.col("key") != F.col("head"))
    # A split's lines lie in one task, so its records are put together there; only those that cross a split's end move on.
    ordered = F.array_sort(F.collect_list(F.struct("pos", "value")))
    pieces = both.groupBy("file", "block", "key").agg(F.array_join(F.transform(ordered, lambda x: x["value"]), "\n").alias("value"),
                                                      F.min("pos").alias("pos"), (F.sum("quotes") % 2).alias("odd"))
    whole = (F.col("key") == F.col("pos")) & (F.col("odd") == 0)
    # The check names the columns that make a piece a record, else a filter of the caller could move it before this one.
    inside = pieces.where(whole & ~F.col("value").isin("", "\r")).select(_checked(F.col("value"), ~whole).alias("record"))
    ordered = F.array_sort(F.collect_list(F.struct("block", "value")))
    across = pieces.where(~whole).groupBy("file", "key").agg(F.array_join(F.transform(ordered, lambda x: x["value"]), "\n").alias("value"))
    return inside.unionByName(across.select(_checked(F.col("value"), F.lit(False)).alias("record")))


def _checked(value: Column, other: Column) -> Column:
    record = F.regexp_replace(value, r"\r\z", "")
    error = F.raise_error(F.concat(F.lit("a quote inside a plain cell, read it by read_csv_text: "), F.col("file")))
    return F.when(other | record.rlike(_SOUND), record).otherwise(error)


def read_csv_records(spark: SparkSession, path: str, overflow: str = "overflow") -> DataFrame:
    """The rows of ``readers.read_csv_text``, with as many tasks as the files have splits.

    The first line of each file is its header. Empty cells are null, short rows are padded with nulls, cells beyond the header go to the array
    ``overflow``. Records end with ``\\n`` or ``\\r\\n``; line ends inside quotes stay as they are. Quotes belong to quoted
    cells and are doubled inside them: a quote elsewhere, or one that is never closed, raises an error that names the file.
    An empty file, or one with a header only, gives no row.
    """
    names = spark.read.options(header=True, multiLine=True, escape='"', encoding="UTF-8").csv(path).columns
    rows = raw_records(spark, path).select(fields(F.col("record")).alias("cells"))

    def cell(i: int) -> Column:
        return F.nullif(unquoted(F.get("cells", F.lit(i))), F.lit(""))

    extra = F.slice("cells", len(names) + 1, F.greatest(F.size("cells") - len(names), F.lit(0)))
    return rows.select(*[cell(i).alias(n) for i, n in enumerate(names)],
                       F.when(F.size("cells") > len(names), F.transform(extra, unquoted)).alias(overflow))
