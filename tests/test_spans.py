import random
import re

from pyspark.sql import functions as F

from sladd.functions import spans as S

ROWS = "unit_id long, spans array<struct<entity:string,start:int,end:int,score:double,src:int>>"


def test_extract_offsets_count_characters(texts):
    df = texts("12 a 34", "a😀b 5é6", "", "none", "7")
    got = {
        r.unit_id: [(s.start, s.end) for s in r.s]
        for r in df.select("unit_id", S.extract_spans(F.col("text"), r"\d+", "N", 0.5).alias("s")).collect()
    }
    assert got == {0: [(0, 2), (5, 7)], 1: [(4, 5), (6, 7)], 2: [], 3: [], 4: [(0, 1)]}


def test_separators_in_the_text_do_no_harm(texts):
    df = texts("1￿2￾33", "￿￿4")
    rows = df.select("unit_id", S.extract_spans(F.col("text"), r"\d+", "N", 0.5).alias("s")).collect()
    assert [[(s.start, s.end) for s in r.s] for r in rows] == [[(0, 1), (2, 3), (4, 6)], [(2, 3)]]


def greedy(spans):
    kept = []
    for s in sorted(spans, key=lambda s: (-s[3], s[4], s[1], -s[2], s[0])):
        if not any(max(s[1], k[1]) < min(s[2], k[2]) for k in kept):
            kept.append(s)
    return sorted(kept, key=lambda s: s[1])


def test_resolve_matches_brute_force_in_short_and_long_arrays(spark):
    rng = random.Random(7)
    units = []
    for unit, size in enumerate([0, 1, 2, 5, 40, 64, 65, 300, 900]):
        spans = []
        for _ in range(size):
            start = rng.randrange(0, 3 * size + 2)
            spans.append((rng.choice("AB"), start, start + rng.randrange(1, 9), rng.randrange(10) / 10, rng.randrange(2)))
        units.append((unit, spans))
    df = spark.createDataFrame(units, ROWS).select("unit_id", S.resolve(F.col("spans")).alias("kept"))
    for row in df.collect():
        assert [tuple(s) for s in row.kept] == greedy(units[row.unit_id][1])


def test_touching_spans_both_stay(spark):
    df = spark.createDataFrame([(0, [("A", 0, 3, 0.5, 0), ("B", 3, 5, 0.9, 0)])], ROWS)
    assert len(df.select(S.resolve(F.col("spans")).alias("k")).first().k) == 2


def test_running_totals_over_long_arrays(spark):
    for size in (1, 2, 255, 256, 257, 1000):
        got = spark.range(1).select(
            S.running(F.sequence(F.lit(1), F.lit(size)), lambda a, b: a + b).alias("r")
        ).first().r
        want, total = [], 0
        for x in range(1, size + 1):
            want.append(total)
            total += x
        assert got == want


def test_redact_rebuilds_long_texts(spark):
    text = "".join(f"æ{i:05d}😀 " for i in range(4000))
    spans = [("EMAIL_ADDRESS", m.start(), m.end(), 1.0, 0) for m in re.finditer(r"\d{5}", text)]
    df = spark.createDataFrame([(text, spans), ("kort", [])], "text string, spans " + ROWS.split("spans ")[1])
    long, short = [r.x for r in df.select(S.redact(F.col("text"), F.col("spans")).alias("x")).collect()]
    assert long == re.sub(r"\d{5}", "[EMAIL]", text) and short == "kort"


def test_digit_view_gives_the_hits_of_the_full_text(spark):
    rng = random.Random(3)
    words = ["Kari", "bor", "gate", "42", "9020", "Tromsdalen", "x1y", "og", "lang" * 30, "\n", "3.", "mai", "+47"]
    rows = [(i, " ".join(rng.choice(words) if rng.random() < 0.3 else "ord" for _ in range(rng.randrange(0, 400))))
            for i in range(120)]
    rows.append((999, ("7 " + "ord " * 80) * 400))
    pattern = r"(?iU)\b(?:[a-zæøå]+ ){0,3}\d+[a-z]?(?:\s+[a-zæøå]+){0,2}\b"
    df = spark.createDataFrame(rows, "unit_id long, text string").withColumn("view", S.digit_view(F.col("text")))
    full = S.matches(F.col("text"), [pattern])
    short = F.transform(
        S.matches(F.col("view.text"), [pattern]),
        lambda h: S.hit(h["rule"], S.source_offset(h["start"], F.col("view.marks")), h["chunk"]),
    )
    for row in df.select(full.alias("a"), short.alias("b"), F.length("view.text").alias("n"), F.length("text").alias("m")).collect():
        assert row.a == row.b and row.n <= row.m + 500
