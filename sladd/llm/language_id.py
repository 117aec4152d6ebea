"""Language identification by the nearest of several centroids a language.

Texts become hashed byte-trigram vectors (letters only, A-Z lower-cased, one space between words), weighted by TF-IDF with
document frequencies counted over all training rows, and scaled to length one. A bounded sample of ``SAMPLE`` rows a language
(expected size; rows are picked by a hash of the id) is clustered into ``CENTROIDS`` centroids by spherical k-means, one
Spark group a language. A text takes the language of the centroid with the largest cosine. It is rejected if its distance
``1 - cosine`` is beyond the radius of that language. The radius lies between the rows of the language and those of the others:
its cosine is the geometric mean of the lowest 2 % of the language's own sample and the highest 5 % of the other languages' rows.

Cases: null texts and texts without letters are ``und`` with score 0 and rejected; ties go to the first language in order;
rows without a language teach nothing; without any training row every text is ``und``; repeated rows are judged alike.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from sladd.llm.common import LOWER, groups, parts, short_batches, text_bytes, tidy, written

DIMENSIONS, SAMPLE, CENTROIDS, ROUNDS = 8192, 1500, 4, 10
#: Shares of a language's own rows below, and of the other languages' rows above, the two cosines between which its radius lies.
OWN, OTHER = 0.02, 0.95
#: The radius is at least so much of the own cosine, and this where no other language is known.
SLACK, ALONE = 0.25, 0.5
#: A centroid of fewer of its language's rows stays only if its cosine with the largest one is above ``FAR``.
SMALL, FAR = 0.1, 0.7
TEXTS = 256
LETTER = LOWER.copy()
LETTER[:0x41] = LETTER[0x5B:0x61] = LETTER[0x7B:0x80] = 32


def counts(texts: list[bytes]) -> np.ndarray:
    """Trigram counts, a row for each text. Trigrams never cross texts."""
    buf = LETTER[np.frombuffer(b"  ".join(texts) + b"  ", np.uint8)]
    blank = buf == 32
    two = blank[:-1] & blank[1:]
    keep = ~(two[:-1] | two[1:])
    wide = buf.astype(np.uint32)
    code = (wide[:-2] * np.uint32(0x9E3779B1) ^ wide[1:-1] * np.uint32(0x85EBCA6B) ^ wide[2:] * np.uint32(0xC2B2AE35)) * np.uint32(0x27D4EB2F)
    code >>= np.uint32(32 - 13)
    row = np.repeat(np.arange(len(texts)), [len(t) + 2 for t in texts])[:-2]
    cells = row[keep] * DIMENSIONS + code[keep]
    return np.bincount(cells, minlength=len(texts) * DIMENSIONS).reshape(len(texts), DIMENSIONS)


def weighted(found: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(found.astype(np.float32)) * idf
    norm = np.sqrt((v * v).sum(1, keepdims=True))
    return v / np.maximum(norm, 1e-9)


def _learn(batches):
    """Kind 0: document frequencies of the partition; kind 1: the trigrams of a sampled row."""
    df, n = np.zeros(DIMENSIONS, np.int64), 0
    for batch in batches:
        texts, langs, picks = text_bytes(batch.column(0)), batch.column(1).to_pylist(), batch.column(2).to_pylist()
        out = []
        for a, b in groups(texts, most=TEXTS):
            found = counts(texts[a:b])
            df += (found > 0).sum(0)
            n += int(found.any(1).sum())
            for i in range(a, b):
                codes = np.flatnonzero(found[i - a])
                if picks[i] and len(codes):
                    out.append((langs[i], codes.astype(np.uint16).tobytes(), found[i - a][codes].astype(np.int32).tobytes()))
        yield pa.record_batch([pa.array([1] * len(out), pa.int32()), pa.array([r[0] for r in out], pa.string()),
                               pa.array([r[1] for r in out], pa.binary()), pa.array([r[2] for r in out], pa.binary())], names=["kind", "lang", "a", "b"])
    yield pa.record_batch([pa.array([0], pa.int32()), pa.array([None], pa.string()), pa.array([df.tobytes()], pa.binary()),
                           pa.array([np.int64(n).tobytes()], pa.binary())], names=["kind", "lang", "a", "b"])


def _add(batches):
    df, n = np.zeros(DIMENSIONS, np.int64), 0
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            df += np.frombuffer(a, np.int64)
            n += int(np.frombuffer(b, np.int64)[0])
    yield pa.record_batch([pa.array([df.tobytes()], pa.binary()), pa.array([n], pa.int64())], names=["df", "n"])


def _cluster(idf):
    def run(rows: pa.Table) -> pa.Table:
        sample = sorted(zip(rows.column("a").to_pylist(), rows.column("b").to_pylist()))
        found = np.zeros((len(sample), DIMENSIONS), np.int32)
        for i, (codes, times) in enumerate(sample):
            found[i, np.frombuffer(codes, np.uint16)] = np.frombuffer(times, np.int32)
        v = weighted(found, idf)
        centre = v.mean(0)
        centres = [centre / max(np.linalg.norm(centre), 1e-9)]
        order = np.argsort(v @ centre, kind="stable")  # start from rows spread over the distances to the mean
        c = v[order[((np.arange(CENTROIDS) + 0.5) * len(v) / CENTROIDS).astype(int)]] if len(v) >= 20 * CENTROIDS else np.stack(centres)
        for _ in range(ROUNDS):
            own = (v @ c.T).argmax(1)
            for k in range(len(c)):
                if (own == k).any():
                    m = v[own == k].mean(0)
                    c[k] = m / max(np.linalg.norm(m), 1e-9)
        if len(c) > 1:  # a small centroid far from the largest is made of rows with a wrong label
            n = np.bincount((v @ c.T).argmax(1), minlength=len(c))
            c = c[(n > 0) & ((n >= SMALL * len(v)) | (c @ c[n.argmax()] > FAR))]
        lang = rows.column("lang")[0].as_py()
        return pa.table({"lang": pa.array([lang] * len(c), pa.string()), "k": pa.array(range(len(c)), pa.int32()),
                         "centre": pa.array([x.astype(np.float32).tobytes() for x in c], pa.binary())})

    return run


def _cosines(langs, centres, idf):
    """The largest cosine of every sampled row with the centroids of each language."""
    names = sorted(set(langs))

    def run(batches):
        for batch in batches:
            found = np.zeros((batch.num_rows, DIMENSIONS), np.int32)
            for i, (codes, times) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                found[i, np.frombuffer(codes, np.uint16)] = np.frombuffer(times, np.int32)
            near = weighted(found, idf) @ centres.T
            own = batch.column(0).to_pylist()
            rows = [(name, own[i] == name, float(x)) for name in names for i, x in enumerate(near[:, [k for k, at in enumerate(langs) if at == name]].max(1))]
            yield pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.bool_(), pa.float64()))], names=["lang", "own", "cosine"])

    return run


def radii(sample: DataFrame, langs: list[str], centres: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """The least cosine of each centroid's language."""
    each = sample.select("lang", "a", "b").mapInArrow(tidy(_cosines(langs, centres, idf)), "lang string, own boolean, cosine double")
    at = each.groupBy("lang").agg(F.percentile(F.when(F.col("own"), F.col("cosine")), OWN).alias("own"),
                                  F.percentile(F.when(~F.col("own"), F.col("cosine")), OTHER).alias("other"))
    low = {}
    for lang, own, other in at.collect():
        low[lang] = own * ALONE if other is None else min(own, max(own * SLACK, float(np.sqrt(own * max(other, 0.0)))))
    return np.array([low[k] for k in langs])


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE):
    """``(langs, centres, lows, idf)`` from the rows given; at most a few vectors a language reach the driver."""
    spark = docs.sparkSession
    rows = short_batches(docs).filter(F.col(lang).isNotNull() & F.col(text).isNotNull())
    shares = {r[0]: min(1.0, sample / r[1]) for r in rows.groupBy(lang).count().collect()}  # a row a language
    if not shares:
        return [], np.zeros((0, DIMENSIONS), np.float32), np.zeros(0), np.ones(DIMENSIONS, np.float32)
    share = F.coalesce(*[F.when(F.col(lang) == k, F.lit(v)) for k, v in shares.items()])
    pick = F.pmod(F.xxhash64(F.col(key)), F.lit(1 << 20)) < share * float(1 << 20)
    learnt = written(rows.select(F.col(text), F.col(lang), pick.alias("pick")).mapInArrow(tidy(_learn), "kind int, lang string, a binary, b binary"))
    sums = learnt.filter("kind = 0").select("a", "b").repartition(min(64, parts(spark))).mapInArrow(_add, "df binary, n long").collect()
    df, n = sum(np.frombuffer(r.df, np.int64) for r in sums), sum(r.n for r in sums)
    idf = np.log((1 + n) / (1 + df)).astype(np.float32) + np.float32(1e-3)
    model = learnt.filter("kind = 1").groupBy("lang").applyInArrow(_cluster(idf), "lang string, k int, centre binary")
    rows = sorted(model.collect(), key=lambda r: (r.lang, r.k))
    centres = np.stack([np.frombuffer(r.centre, np.float32) for r in rows]) if rows else np.zeros((0, DIMENSIONS), np.float32)
    langs = [r.lang for r in rows]
    return langs, centres, radii(learnt.filter("kind = 1"), langs, centres, idf) if langs else np.zeros(0), idf


def has_letter(text: bytes) -> bool:
    if any(c.isalpha() for c in text[:64].decode("utf-8", "ignore")):
        return True
    return any(c.isalpha() for c in text.decode("utf-8", "replace"))


def _predict(model):
    langs, centres, lows, idf = model

    def run(batches):
        for batch in batches:
            texts, names, scores, bad = text_bytes(batch.column(1)), [], [], []
            for a, b in groups(texts, most=TEXTS):
                if len(langs):
                    near = weighted(counts(texts[a:b]), idf) @ centres.T
                    at = near.argmax(1)
                for i in range(a, b):
                    if not len(langs) or not has_letter(texts[i]):
                        names.append("und")
                        scores.append(0.0)
                        bad.append(True)
                        continue
                    k = int(at[i - a])
                    score = float(min(1.0, max(0.0, near[i - a, k])))
                    names.append(langs[k])
                    scores.append(score)
                    bad.append(score < lows[k])
            yield pa.record_batch([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(bad, pa.bool_())],
                                  names=["rest", "lang_pred", "score", "rejected"])

    return run


def held_out(key: str | Column = "doc_id") -> Column:
    """Rows that are kept for testing: a third, by the CRC-32 of the id."""
    return F.pmod(F.crc32((F.col(key) if isinstance(key, str) else key).cast("string").cast("binary")), F.lit(3)) == 1


def identify(docs: DataFrame, model, keys: list[str], text: str = "text") -> DataFrame:
    """``rest`` (struct of ``keys``), ``lang_pred, score, rejected`` for each row."""
    base = short_batches(docs).select(F.struct(*[F.col(f"`{k}`") for k in keys]).alias("rest"), F.col(text))
    kind = base.schema["rest"].dataType.simpleString()
    return base.mapInArrow(tidy(_predict(model)), f"rest {kind}, lang_pred string, score double, rejected boolean")
