"""CSV records over many splits against the one-task reader and Python's own."""

import csv
import io
import random

import pytest

from sladd.sources import readers, records


@pytest.fixture
def small_splits(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "97")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield spark
    for k, v in old.items():
        spark.conf.set(k, v)


def rows_of(df):
    return sorted((tuple(tuple(c) if isinstance(c, list) else c for c in r) for r in df.collect()), key=repr)


def cell(rng):
    return "".join(rng.choice(['a', 'blå', ' ', ',', '"', '\n', '\r\n', '""', '7']) for _ in range(rng.randrange(7)))


def written(rows, quote_all, end):
    out = io.StringIO(newline="")
    csv.writer(out, lineterminator=end, quoting=csv.QUOTE_ALL if quote_all else csv.QUOTE_MINIMAL).writerows(rows)
    return out.getvalue().encode()


@pytest.mark.parametrize("seed, end", [(1, "\n"), (2, "\n"), (3, "\r\n")])
def test_equals_plain_reader(small_splits, tmp_path, seed, end):
    rng, want = random.Random(seed), []
    for name in range(4):
        rows = [["x" + cell(rng)] + [cell(rng) for _ in range(rng.choice((1, 2, 2, 2, 4)))] for _ in range(40 * name)]
        (tmp_path / f"{name}.csv").write_bytes("﻿".encode() * (name == 1) + written([["k", "navn", "tekst"]] + rows, name == 2, end))
        for r in rows:
            full = [c or None for c in r]
            want.append(tuple((full + [None] * 3)[:3]) + (tuple(r[3:]) or None,))
    df = records.read_csv_records(small_splits, str(tmp_path))
    assert df.columns == ["k", "navn", "tekst", "overflow"]
    assert rows_of(df) == sorted(want, key=repr)
    assert small_splits.read.option("lineSep", "\n").text(str(tmp_path)).rdd.getNumPartitions() > 30


def test_a_cell_over_many_splits(small_splits, tmp_path):
    long = "line, \"\" of\n" * 300 + "x" * 20_000
    (tmp_path / "a.csv").write_text(f'k,v\n1,"{long}"\n2,b\n,c\n"",d\n\n3,"{long}"')
    got = rows_of(records.read_csv_records(small_splits, str(tmp_path)))
    text = long.replace('""', '"')
    assert got == sorted([("1", text, None), ("2", "b", None), (None, "c", None), (None, "d", None), ("3", text, None)], key=repr)
    assert got == rows_of(readers.read_csv_text(small_splits, str(tmp_path)))


@pytest.mark.parametrize("body, message", [('1,"never closed\n2,b\n', "never closed"), ('1,a "b" c\n', "quote inside a plain cell")])
def test_unsound_files_raise(small_splits, tmp_path, body, message):
    (tmp_path / "a.csv").write_text("k,v\n" + body)
    with pytest.raises(Exception, match=message):
        records.read_csv_records(small_splits, str(tmp_path)).collect()


def test_only_a_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text("k,v\n")
    assert records.read_csv_records(spark, str(tmp_path)).collect() == []


def test_longer_rows_are_never_cut(spark, tmp_path):
    (tmp_path / "a.csv").write_text("k,v\n,b,91234567\n1,c\n")
    assert rows_of(readers.read_csv_text(spark, str(tmp_path))) == rows_of(records.read_csv_records(spark, str(tmp_path))) == [("1", "c", None), (None, "b", ("91234567",))]
    with pytest.raises(Exception, match="more cells than the header"):
        readers.read_csv_text(spark, str(tmp_path), overflow=None).collect()
    (tmp_path / "a.csv").write_text("k,v\n1,c\n2\n")
    assert rows_of(readers.read_csv_text(spark, str(tmp_path), overflow=None)) == [("1", "c"), ("2", None)]


def test_files_follow_the_tasks(spark, monkeypatch):
    """eight files whatever the input made the largest task grow with it."""
    from sladd.plans import queries

    lines = spark.range(0, 400, 1, 40).selectExpr("concat(id, ',\"a\nb\"') as line")
    path = queries._csv_files(spark, "k,v", lines)
    assert len({r.f for r in spark.read.text(path).selectExpr("_metadata.file_path as f").distinct().collect()}) == 40
    assert rows_of(records.read_csv_records(spark, path)) == sorted([(str(i), "a\nb", None) for i in range(400)], key=repr)
