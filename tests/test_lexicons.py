"""Names out of tables of any length, against a literal lexicon and a plain search."""

import re
from dataclasses import replace

import pytest

from sladd.operators import joins, lexicons
from sladd.plans.analyze import anonymize
from sladd.rules.words import DEFAULT_LEXICON

TEXTS = (
    "Kari Olsen møtte Anne-Marie Hansen i Oslo 12.03.2020.", "KARI og kari, Da Silva; Jan-Erik Berg.", None, "", "   ", "uten treff her",
    "Ola Nordmann bor i Storgata 5, 0155 Oslo. Kontakt: kari@example.com", "Ringo Starr og Ada Lovelace kom. Ada!", "Kari " * 500,
    "Per og Pål￿ Hansen", "Anne Marie Anne-Marie", "Kari Olsen møtte Anne-Marie Hansen i Oslo 12.03.2020.",
)
EXTRA = ("Ada Lovelace", "Ringo", "Anne Marie", "Lovelace")


def name_rows(spark, names, fillers=0):
    own = spark.createDataFrame([(n,) for n in names], "name string")
    return own.unionByName(spark.range(fillers).selectExpr("concat('Fyll', id) as name"))


def plain_runs(text, names, longest):
    words, lower, out = list(re.finditer(r"\w+", text or "")), {n.lower() for n in names}, []
    for i, w in enumerate(words):
        for last in words[i : i + longest]:
            if (chunk := text[w.start() : last.end()]).lower() in lower:
                out.append((w.start(), last.end(), chunk))
    return out


@pytest.mark.parametrize("limit", [200_000, 3])
def test_hits(spark, texts, monkeypatch, limit):
    names = [*DEFAULT_LEXICON.names, *EXTRA]
    monkeypatch.setattr(joins, "BROADCAST_WORDS", limit)
    some = [t for t in TEXTS if "￿" not in (t or "")] + ["".join(f"{n}, " for n in names)]
    got = sorted((r.unit_id, r.start, r.end, r.chunk) for r in lexicons.name_hits(texts(*some), name_rows(spark, names)).collect())
    assert got == sorted((i, *r) for i, t in enumerate(some) for r in plain_runs(t, names, 2))


@pytest.mark.parametrize(("limit", "fillers"), [(200_000, 100_000), (3, 1000)])
def test_analysis_with_a_table(spark, texts, monkeypatch, limit, fillers):
    """A list of 100,000 names, and one that is joined, give what a literal lexicon gives."""
    lexicon = replace(DEFAULT_LEXICON, names=DEFAULT_LEXICON.names | set(EXTRA))
    want = sorted((r.unit_id, r.redacted, r.n, [tuple(s) for s in r.spans or []]) for r in anonymize(texts(*TEXTS), lexicon=lexicon).collect())
    monkeypatch.setattr(joins, "BROADCAST_WORDS", limit)
    table = lexicons.NameTable(name_rows(spark, lexicon.names, fillers))
    assert table.short == (limit > 3)
    out = anonymize(texts(*TEXTS), names=table)
    assert out.columns == ["unit_id", "redacted", "spans", "n"]
    assert sorted((r.unit_id, r.redacted, r.n, [tuple(s) for s in r.spans or []]) for r in out.collect()) == want
    assert any("[NAME]" in (w[1] or "") for w in want)


def test_long_list_leaves_texts_in_place(spark, texts, monkeypatch):
    """Without a possible name nothing is joined to a text; equal texts ask once."""
    monkeypatch.setattr(joins, "BROADCAST_WORDS", 1)
    table = lexicons.NameTable(name_rows(spark, ["Kari", "Ola"]))
    out = table.attach(texts(*["Kari Ola"] * 50, "ingen", None), "text").collect()
    assert len(out) == 52 and sum(len(r[table.LISTED]) for r in out) == 100


def test_filter_has_every_word(spark):
    words = spark.range(5000).selectExpr("concat('w', id * 7) as word")
    may = lexicons.word_filter(words)
    assert words.where(~may(words.word)).isEmpty()
    others = spark.range(5000).selectExpr("concat('x', id) as word")
    assert others.where(may(others.word)).count() < 1000


def test_empty_list(spark, texts):
    table = lexicons.NameTable(name_rows(spark, []))
    assert lexicons.name_hits(texts("Kari"), name_rows(spark, [])).count() == 0
    assert anonymize(texts("Kari og Ola"), names=table).first().redacted == "Kari og Ola"


def test_plan_of_a_long_list_holds_no_list(spark, texts, monkeypatch):
    """The driver's memory depends on the plan, so its text must not grow with the names."""
    monkeypatch.setattr(joins, "BROADCAST_WORDS", 3)
    table = lexicons.NameTable(name_rows(spark, ["Kari"], 5000))
    plan = table.attach(texts("Kari og Fyll7", "uten", None), "text")
    assert len(plan._jdf.queryExecution().optimizedPlan().toString()) < 100_000
    assert sorted(len(r[table.LISTED]) for r in plan.collect()) == [0, 0, 2]
