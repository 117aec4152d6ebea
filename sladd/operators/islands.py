"""Overlap resolution of span rows, for units with any number of spans.

Spans that overlap, directly or through others, are an island; what one island keeps doesn't depend on the rest of its unit. So a
unit needs no array of all its spans and no task of its own: rows are range-partitioned by unit and start, an island ends where
the running maximum of the ends before a row doesn't pass its start, and every island is resolved alone. Two tables with one row
a range carry the running values from range to range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from sladd.functions import spans as S
from sladd.sources.writers import scratch_folder

FIELDS = ("entity", "start", "end", "score", "src")


def _carried(edges: DataFrame, value: str) -> DataFrame:
    """``range, value``: the largest value of the ranges before, as far as the first unit of a range goes back."""
    before, here = edges.select("last", F.col("range").alias("earlier"), value), edges.select("range", "first")
    same = F.col("last").eqNullSafe(F.col("first")) & (F.col("earlier") < F.col("range"))
    return here.join(F.broadcast(before), same).groupBy("range").agg(F.max(value).alias(value))


def _edges(rows: DataFrame, unit: str, value: Column, name: str) -> DataFrame:
    """One row a range: its first and last unit, and the largest value of the last."""
    each = rows.groupBy("range", unit).agg(F.max(value).alias("v"))
    key = F.struct(F.col(unit).alias("u"))
    return each.groupBy("range").agg(F.min(key)["u"].alias("first"), F.max(key)["u"].alias("last"), F.max_by("v", key).alias(name))


def with_islands(rows: DataFrame, unit: str = "unit_id", ranges: int | None = None) -> DataFrame:
    """Add ``island``: the start of the first span of each span's island. Empty spans and spans without offsets are left out.

    The ranges are written to the folder that executors share, so that each step sees the same ones.
    """
    spark = rows.sparkSession
    n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    usable = rows.where(F.col("end") > F.col("start"))
    spread = usable.repartitionByRange(n, unit, "start", "end").withColumn("range", F.spark_partition_id())
    path = scratch_folder(spark)
    spread.write.parquet(path)
    placed = spark.read.schema(spread.schema).parquet(path)
    order = Window.partitionBy("range", unit).orderBy("start", "end")
    ends = _edges(placed, unit, F.col("end"), "reach")

    def joined(df, edges, name):
        """The carried value for rows of the range's first unit."""
        carried = _carried(edges, name).withColumnRenamed(name, "carried").join(edges.select("range", "first"), "range")
        out = df.join(F.broadcast(carried), "range", "left")
        own = F.col(unit).eqNullSafe(F.col("first"))
        return out.withColumn("carried", F.when(own, F.col("carried"))).drop("first")

    reach = F.greatest(F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.col("carried"))
    opened = joined(placed, ends, "reach").withColumn("reach", reach).drop("carried")
    opened = opened.withColumn("opens", F.when(F.col("reach").isNull() | (F.col("start") >= F.col("reach")), F.col("start")))
    starts = _edges(opened, unit, F.col("opens"), "opens")
    latest = F.greatest(F.max("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)), F.col("carried"))
    return joined(opened, starts, "opens").withColumn("island", latest).drop("carried", "reach", "opens", "range")


def resolve_rows(rows: DataFrame, unit: str = "unit_id", ranges: int | None = None) -> DataFrame:
    """The spans that greedy resolution by score keeps: ``unit, entity, start, end, score, src``.

    Same result as resolving each unit as one array. An island is one array; it grows with the spans over one stretch of text,
    not with the unit.
    """
    islands = with_islands(rows, unit, ranges)
    span = F.struct(*[F.col(f) for f in FIELDS]).cast(S.SPAN_TYPE)
    arrays = islands.groupBy(unit, "island").agg(F.collect_list(span).alias("spans"))
    kept = arrays.select(unit, F.explode(S.resolve(F.col("spans"))).alias("s"))
    return kept.select(unit, *[F.col(f"s.{f}").alias(f) for f in FIELDS])
