"""Long units in blocks against the same units uncut."""

import random

import pytest
from pyspark.sql import functions as F

from sladd.operators.blocks import anonymize_blocks, block_spans, cut_units
from sladd.operators.lexicons import NameTable
from sladd.plans.analyze import anonymize
from sladd.rules.words import Lexicon

#: Values, context words and what stands between them, also where a cut could hurt.
PARTS = ("tlf 412 34 567", "41234567", "kari@firma.no", "Kari Nordmann", "ola", "Per-Arne Hansen Olsen Berg", "anne-lise bor her og der", "fnr 01019012345",
         "konto 1234.56.78903", "1234 56 78903", "12. mars 2020", "12.03.2020", "Storgata 12B", "0150 Oslo", "adresse 5003 bergen sentrum", "10.0.0.1", "fe80::1",
         "pasient", "DE89 3704 0044 0532 0130 00", "4111 1111 1111 1111", "12 34 56 78 90 12 34 56", "ordinary words stand here", "navn", "til", "x" * 40, "1" * 30)
GLUE = (" ", " ", "  ", "\n", "\n\n", ", ", ",", "; ", ". ", ".", "! ", "?", "\"", "-", ":", "\t", " ", " (", ") ")


def random_text(seed, n):
    rng = random.Random(seed)
    return "".join(rng.choice(PARTS) + rng.choice(GLUE) for _ in range(n))


def shown(df):
    return sorted((tuple(r) for r in df.select("unit_id", "redacted", "spans", "n").collect()), key=repr)


@pytest.mark.parametrize("size", [1, 40, 700])
def test_equal_to_the_uncut_units(spark, texts, size):
    items = [random_text(s, 120) for s in range(30)] + [None, "", "   ", ",,,;;", "no breaks at all " * 50, "word," * 300, "ola\U0001f600, tlf 41234567. " * 20]
    df = texts(*items, items[0])
    got, wanted = shown(anonymize_blocks(df, size=size)), shown(anonymize(df))
    assert got == wanted and sum(r[3] for r in got) > 1000


def test_pieces_are_the_unit(texts):
    text = random_text(7, 400)
    rows = sorted(cut_units(texts(text), size=100).collect(), key=lambda r: r["_at"])
    assert "".join(r["_body"] for r in rows) == text and len(rows) > 20
    for r in rows:
        assert text[:r["_at"]].endswith(r["_lead"]) and text[r["_at"]:].startswith(r["_body"])
        assert r["_lead"] == text[:r["_at"]] or len(r["_lead"].split()) == 6


def test_names_out_of_a_table(spark, texts):
    names = spark.createDataFrame([("Ruud Berg",), ("Tveit",)], "name string")
    df = texts("Ruud Berg møtte Tveit, og Ruud. Berg kom; Tveit gikk. " * 30)
    table = NameTable(names)
    assert shown(anonymize_blocks(df, names=table, size=50)) == shown(anonymize(df, names=table))
    with pytest.raises(ValueError, match="break"):
        anonymize_blocks(df, names=NameTable(spark.createDataFrame([("St. Hansen",)], "name string")), size=50)
    with pytest.raises(ValueError, match="break"):
        anonymize_blocks(df, lexicon=Lexicon(names=frozenset({"Berg, Ola"})), size=50)


def test_one_unit_takes_many_tasks(spark, texts):
    text = random_text(11, 400) * 100
    blocks = block_spans(texts(text), size=20_000)
    tasks = blocks.groupBy(F.spark_partition_id().alias("t")).agg(F.count("*").alias("n"), F.sum(F.size("spans")).alias("spans"))
    rows = tasks.collect()
    assert len(rows) >= 4 and all(r.spans > 0 for r in rows)


def test_other_columns_stay(spark):
    df = spark.createDataFrame([(None, "x", "ring 41234567, " * 20, "y"), (1, None, "kort", None)], "unit_id int, n_spans string, body string, `a b` string")
    got = anonymize_blocks(df, text="body", keep_spans=False, size=30)
    assert got.columns == ["unit_id", "n_spans", "a b", "redacted", "n"]
    assert {(r["a b"], r.n) for r in got.collect()} == {("y", 20), (None, 0)}
