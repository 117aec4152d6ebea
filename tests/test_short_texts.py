"""What the analysis costs a short text: word lists by hash, constants made once, long patterns not decoded anew."""

from pyspark.sql import functions as F

from sladd.functions.filters import has_suffix
from sladd.functions.text import holds, in_words
from sladd.operators.flags import special_categories
from sladd.plans.analyze import _name_alternatives


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def words_table(spark, *words):
    return spark.createDataFrame([(list(words),)], "w array<string>").repartition(1)


def test_words_are_looked_up_by_hash(spark):
    """a literal pattern inside a lambda is decoded for every word."""
    listed = [*"abcdefghijkl", "a.b", "tre", "skøyte"]
    df = words_table(spark, "a.b", "axb", "tre", "tre\n", "Tre", "skøyte", "", None)
    out = df.select(F.transform("w", lambda w: in_words(w, listed)).alias("x"))
    assert out.first().x == [True, False, True, False, False, True, False, None]
    assert "INSET" in optimized(out) and "RLIKE(lambda" not in optimized(out)
    assert df.select(F.transform("w", lambda w: in_words(w, ())).alias("x")).first().x == [False] * 8


def test_listed_names_are_split_once(spark):
    """the names of several words were split anew for every text."""
    names = ["Anne-Marie", "Da Silva", "Ola", "O'Neil.", "Per"]
    out = words_table(spark, "da", "silva", "anne", "ola", "neil", "o").select(_name_alternatives(F.col("w"), names).alias("x"))
    assert out.first().x == ["da silva", "o'neil\\.", "ola"]
    assert "split(" not in optimized(out)


def test_long_patterns_are_not_decoded_anew(spark):
    """F6 to F8: the category patterns; the endings of F9 and F10."""
    df = spark.createDataFrame([("Ny DIAGNOSE og streik",), ("ingenting",), ("  ",), (None,)], "text string").repartition(1)
    out = df.select("text", special_categories(F.col("text")).alias("x"))
    found = {r.text: r.x for r in out.collect()}
    assert found == {"Ny DIAGNOSE og streik": ["helseopplysninger", "fagforeningsmedlemskap"], "ingenting": [], "  ": [], None: []}
    assert "regexp_instr(" in optimized(out) and "RLIKE(lambda" not in optimized(out)
    ends = words_table(spark, "Bruksarealer", "arealet", None).select(F.transform("w", has_suffix).alias("x"))
    assert ends.first().x == [True, False, None] and "RLIKE(lambda" not in optimized(ends)


def test_holds_is_rlike(spark):
    df = spark.createDataFrame([(t,) for t in ("ab", "xaby", "b", "", "a\nb", None)], "t string").repartition(1)
    for pattern in ("ab", r"\Aab\z", "^$", r"(?s)a.b", r"\bb"):
        pairs = df.select(F.col("t").rlike(pattern).alias("a"), holds(F.col("t"), pattern).alias("b")).collect()
        assert all(r.a == r.b for r in pairs), (pattern, pairs)
