"""Span rows resolved by islands, against one array a unit and a plain version."""

import random

import pytest
from pyspark.sql import functions as F

from sladd.operators.islands import resolve_rows, with_islands

SCHEMA = "unit_id long, entity string, start int, end int, score double, src int"


def plain(rows):
    kept = {}
    for r in sorted(set(rows), key=lambda r: (r[0] is not None, r[0], -r[4], r[5], r[2], -r[3], r[1])):
        own = kept.setdefault(r[0], [])
        if r[3] > r[2] and not any(max(k[2], r[2]) < min(k[3], r[3]) for k in own):
            own.append(r)
    return sorted((r for own in kept.values() for r in own), key=repr)


def random_rows(seed):
    rng = random.Random(seed)
    rows = [(u, rng.choice("AB"), s := rng.randint(0, 400), s + rng.randint(0, 12), rng.choice((0.5, 0.6, 0.9)), rng.randint(0, 2))
            for u in [None, *range(6)] for _ in range(rng.choice((0, 1, 30, 80)))]
    # one unit with most of the rows, and one chain of overlaps over many ranges
    rows += [(99, "A", s := rng.randint(0, 9000), s + rng.randint(1, 9), rng.choice((0.5, 0.7)), 0) for _ in range(600)]
    return rows + [(100, "C", s, s + 2, 0.4 + s % 5 / 10, 0) for s in range(300)]


@pytest.mark.parametrize(("seed", "ranges"), [(1, 1), (2, 7), (3, 40)])
def test_against_plain(spark, seed, ranges):
    rows = random_rows(seed)
    got = resolve_rows(spark.createDataFrame(rows, SCHEMA).repartition(5), ranges=ranges).collect()
    assert sorted((tuple(r) for r in got), key=repr) == plain(rows)


def test_islands_of_a_large_unit_take_several_tasks(spark):
    rows = spark.range(20_000).select(F.lit(1).alias("unit_id"), F.lit("A").alias("entity"), (F.col("id") * 10).cast("int").alias("start"),
                                      (F.col("id") * 10 + 5 + F.col("id") % 7).cast("int").alias("end"), F.lit(0.5).alias("score"), F.lit(0).alias("src"))
    sizes = with_islands(rows, ranges=16).groupBy("unit_id", "island").count()
    assert sizes.agg(F.max("count")).first()[0] <= 8 and sizes.count() > 10_000


def test_empty_and_unusable(spark):
    assert resolve_rows(spark.createDataFrame([], SCHEMA)).count() == 0
    assert resolve_rows(spark.createDataFrame([(1, "A", 5, 5, 0.5, 0), (1, "A", None, 3, 0.5, 0), (1, "A", 7, 3, 0.5, 0)], SCHEMA)).count() == 0
