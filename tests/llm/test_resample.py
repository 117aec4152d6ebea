"""Importance resampling against a version that builds every n-gram and sorts all rows at once."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from sladd.llm import resample

LOWER = {c: c + 32 for c in range(65, 91)}


def grams(text, size):
    found = re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").translate(LOWER).encode())
    return found, [b" ".join(found[i : i + n]) for n in range(1, size + 1) for i in range(len(found) - n + 1)]


def plain(rows, target, percent, size, buckets, least):
    def counts(texts):
        out = [0] * buckets
        for t in texts:
            for g in grams(t, size)[1]:
                out[zlib.crc32(g) % buckets] += 1
        return out

    s, t = counts(x for _, x in rows), counts(target)
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * (sum(s) + buckets) / ((s[b] + 1.0) * (sum(t) + buckets)))) for b in range(buckets)]
    out = []
    for key, text in rows:
        found, g = grams(text, size)
        weight = sum(gain[zlib.crc32(x) % buckets] for x in g) // len(g) if g else 0
        h = int(hashlib.sha256(f"2024:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        out.append((key, len(found), len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0]))
    return out, able[: percent * len(able) // 100]


@pytest.mark.parametrize("size", [1, 3])
def test_crcs(size):
    rng = random.Random(size)
    texts = [b"", b"Hello  World", b"a,b;c " * 5, "été ÉTÉ x".encode(), bytes(rng.choice(b"abcdefg XYZ,.\xc3\xa9") for _ in range(120_000)),
             b"x" * (resample.BLOCK + 77) + b" tail"]
    got = [[] for _ in texts]
    for text_of, found in resample.features(texts, size, 10_007, resample.Crcs.tables()):
        for k, b in zip(text_of.tolist(), found.tolist()):
            got[k].append(b)
    for text, found in zip(texts, got):
        words = re.findall(rb"[0-9a-z\x80-\xff]+", text.lower())
        want = [zlib.crc32(b" ".join(words[i : i + n])) % 10_007 for n in range(1, size + 1) for i in range(len(words) - n + 1)]
        assert sorted(found) == sorted(want)


@pytest.mark.parametrize(("size", "partitions"), [(1, 1), (2, 7)])
def test_against_plain(spark, size, partitions):
    rng = random.Random(size)
    pool = ["alpha", "Beta", "gamma", "delta,", "é", "x1", "-", "question"]
    rows = [(i, " ".join(rng.choices(pool, k=rng.randint(0, 60)))) for i in range(300)]
    rows += [(1000, None), (1001, ""), (1002, "., -"), (1003, "gamma " * 70_000), (None, "beta " * 30)]
    target = ["question question delta", None, "", "beta x1"]
    docs = spark.createDataFrame([(k, t, 1, "a", 2) for k, t in rows], "doc_id long, text string, row int, at string, range int").repartition(partitions)
    out = resample.resample(docs, spark.createDataFrame([(t,) for t in target], "text string"), 20, size=size, buckets=500).collect()
    want, drawn = plain(rows, target, 20, size, 500, 20)
    assert sorted(((r.doc_id, r.n_words, r.n_features, r.weight, r.score) for r in out), key=repr) == sorted(want, key=repr)
    ranked = sorted((r["rank"], r.doc_id) for r in out if r["rank"] is not None)
    assert ranked == [(i + 1, r[0]) for i, r in enumerate(drawn)] and len(ranked) > 10


def test_ties_and_repeated_rows(spark):
    text = "one two three four five six seven eight nine ten " * 3
    docs = spark.createDataFrame([(7, text)] * 40, "doc_id long, text string")
    out = resample.resample(docs, docs, 25).collect()
    assert len(out) == 40 and sorted(r["rank"] for r in out if r["rank"]) == list(range(1, 11))
    assert len({(r.n_features, r.weight, r.score) for r in out}) == 1


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert resample.resample(docs.limit(0), docs).count() == 0
    (row,) = resample.resample(docs, docs.limit(0)).collect()
    assert (row.n_features, row["rank"]) == (3, None)


def test_gains_are_floored_down():
    assert resample.gains(np.array([3, 0]), np.array([0, 0])).tolist() == [math.floor(1000 * math.log(5 / 8)), math.floor(1000 * math.log(5 / 2))]
