"""Similarity join on word n-grams with Bayesian pruning of candidates.

Texts become sets of hashed shingles of five words (a text of fewer words is one shingle). Texts with equal sets form a copy
class, of which one representative goes on. Representatives that agree on a band of MinHash values are candidates. Within a
band's members, MinHash values are compared 16 at a time: after each step a pair is dropped if, given the agreements so far
and a uniform prior, the probability that its similarity reaches the threshold is below ``TOLERANCE``. The pairs that stay
link members into groups, of which only a spanning forest is emitted. Each group's shingle sets meet once, and there every
pair is verified exactly; its similar pairs are counted in place, so no pair rows exist anywhere.

A band or group of more than ``BLOCK`` members is cut into blocks, and each pair of blocks is a task of its own: none holds
more than two blocks. With 24 bands of 4 values a pair at the threshold shares no band with probability 3e-6.

Cases: null texts and texts without words are classes of their own without links; copies link to each other and to all that
their class links to; ties in similarity at the threshold are links; rows that repeat an id count as copies; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from sladd.llm.common import groups, mix, parts, short_batches, text_bytes, tidy, words, written
from sladd.llm.components import components

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS, STEP, TOLERANCE = 24, 4, 16, 1e-6
HASHES = BANDS * ROWS
BLOCK = 1024
_random = np.random.Generator(np.random.PCG64(20240607))
FACTORS = _random.integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
OFFSETS = _random.integers(0, 1 << 63, HASHES, dtype=np.uint64)


def shingle_sets(texts: list[bytes], size: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    _, _, _, hashes, first = words(texts)
    rolled = hashes.copy()
    for k in range(1, min(size, len(hashes))):
        rolled[: len(hashes) - k] = mix(rolled[: len(hashes) - k] * np.uint64(0x9E3779B97F4A7C15) + hashes[k:])
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= size:
            out.append(np.unique(rolled[a : b - size + 1]))
        elif b > a:
            short = np.uint64(b - a)
            for h in hashes[a:b]:
                short = mix(np.array([short]) * np.uint64(0xD6E8FEB86659FD93) + h)[0]
            out.append(np.array([short], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash values, a row for each set; empty sets get the largest values."""
    out = np.full((len(sets), HASHES), 0xFFFFFFFF, np.uint32)
    full = [i for i, s in enumerate(sets) if len(s)]
    if full:
        values = np.concatenate([sets[i] for i in full])
        starts = np.concatenate([[0], np.cumsum([len(sets[i]) for i in full])[:-1]])
        for k in range(HASHES):
            out[full, k] = np.minimum.reduceat((values * FACTORS[k] + OFFSETS[k]) >> np.uint64(32), starts)
    return out


def _sketch(size):
    def run(batches):
        for batch in batches:
            texts, digests, counts, sigs = text_bytes(batch.column(1)), [], [], []
            for a, b in groups(texts):
                sets = shingle_sets(texts[a:b], size)
                digests += [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
                counts += [len(s) for s in sets]
                sigs += [s.tobytes() for s in signatures(sets)]
            yield pa.record_batch([batch.column(0), pa.array(digests, pa.binary()), pa.array(counts, pa.int32()), pa.array(sigs, pa.binary())],
                                  names=["doc", "digest", "n", "sig"])

    return run


def _bands(batches):
    for batch in batches:
        sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(-1, BANDS, ROWS).astype(np.uint64)
        key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), sig.shape[:2]).copy()
        for k in range(ROWS):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + sig[:, :, k])
        yield pa.record_batch([pa.array(key.astype(np.int64).ravel()), pa.array(np.repeat(batch.column(0).to_numpy(), BANDS))], names=["key", "node"])


def least_agreements(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> list[tuple[int, int]]:
    """After so many values compared, the fewest agreements with which a pair stays.

    With a uniform prior, similarity after m agreements of n follows Beta(m + 1, n - m + 1), whose upper tail at the threshold
    is the chance of at most m successes in n + 1 trials.
    """
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        tail, m = 0.0, 0
        while m <= n:
            tail += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if tail >= tolerance:
                break
            m += 1
        out.append((n, m))
    return out


def likely_pairs(sig: np.ndarray, i: np.ndarray, j: np.ndarray, limits) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that the incremental comparison doesn't drop."""
    agree, before = np.zeros(len(i), np.int32), 0
    for n, least in limits:
        agree += (sig[i, before:n] == sig[j, before:n]).sum(1, dtype=np.int32)
        stay = agree >= least
        i, j, agree, before = i[stay], j[stay], agree[stay], n
        if not len(i):
            break
    return i, j


def local_roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest member that each of ``n`` members is connected to."""
    root = np.arange(n)
    while True:
        after = root.copy()
        np.minimum.at(after, i, root[j])
        np.minimum.at(after, j, root[i])
        after = after[after]
        if (after == root).all():
            return root
        root = after


def _pairs(side: np.ndarray):
    """Pairs of a cell: all of one block, or those across its two blocks; in slices of bounded size."""
    if side.min() == side.max():
        for a in range(0, len(side), 256):
            i, j = np.meshgrid(np.arange(a, min(a + 256, len(side))), np.arange(len(side)), indexing="ij")
            keep = j > i
            yield i[keep], j[keep]
        return
    left, right = np.flatnonzero(side == side.min()), np.flatnonzero(side == side.max())
    for a in range(0, len(left), 256):
        i, j = np.meshgrid(left[a : a + 256], right, indexing="ij")
        yield i.ravel(), j.ravel()


def _cells(batches, n_keys):
    """Rows of one cell after another, as lists of columns; batches are sorted by the first ``n_keys`` columns."""
    current, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = list(zip(*(batch.column(k).to_pylist() for k in range(n_keys))))
        start = 0
        for at in range(1, len(keys) + 1):
            if at == len(keys) or keys[at] != keys[start]:
                if keys[start] != current and held:
                    yield current, pa.Table.from_batches(held)
                    held = []
                current = keys[start]
                held.append(batch.slice(start, at - start))
                start = at
    if held:
        yield current, pa.Table.from_batches(held)


def _link(limits):
    """Edges of a spanning forest of the likely pairs of each cell."""

    def run(batches):
        known: set = set()
        for _, cell in _cells(batches, 3):
            node, side = cell.column("node").to_numpy(), cell.column("side").to_numpy()
            if len(node) < 2:
                continue
            sig = np.frombuffer(b"".join(cell.column("sig").to_pylist()), np.uint32).reshape(-1, HASHES)
            found = [likely_pairs(sig, i, j, limits) for i, j in _pairs(side)]
            i, j = (np.concatenate([f[k] for f in found]) for k in (0, 1))
            if len(i):
                root = local_roots(len(node), i, j)
                known.update((a, b) for a, b in zip(node.tolist(), node[root].tolist()) if a != b)
            if len(known) > 50_000:
                yield _edges(known)
                known = set()
        yield _edges(known)

    return run


def _edges(pairs):
    return pa.record_batch([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], names=["a", "b"])


def _sets(size):
    """Shingle sets of representatives; rows whose text isn't that of the class are left out."""

    def run(batches):
        for batch in batches:
            texts, keep, out = text_bytes(batch.column(4)), [], []
            digests = batch.column(3).to_pylist()
            for a, b in groups(texts):
                for k, s in enumerate(shingle_sets(texts[a:b], size), a):
                    if xxhash.xxh3_128_digest(s.tobytes()) == digests[k]:
                        keep.append(k)
                        out.append(s.tobytes())
            some = batch.take(pa.array(keep, pa.int64()))
            yield pa.record_batch([some.column(0), some.column(1), some.column(2), pa.array(out, pa.binary())], names=["comp", "node", "copies", "shingles"])

    return run


def overlaps(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of ``left`` with ``right`` sets."""
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times[column] > 1  # a shingle of one set only is in no intersection
    row, column = row[shared], np.unique(column[shared], return_inverse=True)[1]
    out = np.zeros((len(left), len(right)), np.float32)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    width = int(column[-1]) + 1 if len(column) else 0
    for a in range(0, width, 4096):
        x, y = np.searchsorted(column, [a, a + 4096])
        part = np.zeros((len(sets), min(4096, width - a)), np.float32)
        part[row[x:y], column[x:y] - a] = 1
        out += part[left] @ part[right].T
    return out


def _verify(threshold):
    """Exact links of each cell: node, the smallest node it is connected to here, and the documents it is linked to."""

    def run(batches):
        for (_, x, y), cell in _cells(batches, 3):
            node, side, copies = (cell.column(c).to_numpy() for c in ("node", "side", "copies"))
            sets = [np.frombuffer(s, np.uint64) for s in cell.column("shingles").to_pylist()]
            order = np.argsort(node, kind="stable")
            node, side, copies, sets = node[order], side[order], copies[order], [sets[k] for k in order]
            size = np.array([len(s) for s in sets], np.float64)
            left, right = (np.arange(len(node)),) * 2 if x == y else (np.flatnonzero(side == x), np.flatnonzero(side == y))
            if not len(left) or not len(right):
                continue
            both = overlaps(sets, left, right).astype(np.float64)
            linked = both >= threshold * (size[left][:, None] + size[right][None, :] - both) - 1e-9
            if x == y:
                np.fill_diagonal(linked, False)
            links = np.zeros(len(node), np.int64)
            links[left] += linked @ copies[right]
            if x != y:
                links[right] += linked.T @ copies[left]
            i, j = np.nonzero(linked)
            root = local_roots(len(node), left[i], right[j])
            yield pa.record_batch([pa.array(node), pa.array(node[root]), pa.array(links)], names=["node", "near", "links"])

    return run


def _celled(members: DataFrame, key: str, size: str, block: int) -> DataFrame:
    """Each member in the cells of its block with every block: ``x <= y`` name the cell, ``side`` the member's block."""
    n = F.ceil(F.col(size) / F.lit(block)).cast("int")
    own = members.withColumn("side", F.pmod(F.xxhash64("node"), n).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), n - 1)))
    return own.withColumn("x", F.least("side", "other")).withColumn("y", F.greatest("side", "other")).drop("other", size)


def similarity_classes(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, size: int = SHINGLE, block: int = BLOCK) -> DataFrame:
    """``key, class_id, n_links, n_shingles`` for each row.

    ``class_id`` is the smallest id that a chain of links leads to; ``n_links`` counts the other rows of similarity ``threshold`` or more.
    """
    spark = docs.sparkSession
    base = short_batches(docs).select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text"))
    sketches = written(base.mapInArrow(tidy(_sketch(size)), "doc long, digest binary, n int, sig binary"))
    reps = sketches.filter("n > 0").groupBy("digest").agg(F.min("doc").alias("rep"), F.count("*").alias("copies"), F.first("sig").alias("sig"))
    reps = written(reps.withColumn("node", F.monotonically_increasing_id()))

    keys = reps.select("node", "sig").mapInArrow(_bands, "key long, node long")
    often = keys.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1")
    members = _celled(keys.join(often, "key"), "key", "m", block).join(reps.select("node", "sig"), "node")
    cells = members.select("key", "x", "y", "side", "node", "sig").repartition(parts(spark), "key", "x", "y").sortWithinPartitions("key", "x", "y")
    edges = cells.mapInArrow(_link(least_agreements(threshold)), "a long, b long")
    grouped = written(components(edges))

    counts = grouped.groupBy("root").agg(F.count("*").alias("m"))
    chosen = grouped.join(reps.select("node", "rep", "copies", "digest"), "node").select(F.col("root").alias("comp"), "node", "copies", "digest", "rep")
    held = chosen.join(base, F.col("rep").eqNullSafe(F.col("doc"))).select("comp", "node", "copies", "digest", "text")
    sets = held.mapInArrow(tidy(_sets(size)), "comp long, node long, copies long, shingles binary").dropDuplicates(["node"])
    sets = _celled(sets.join(counts.withColumnRenamed("root", "comp"), "comp"), "comp", "m", block)
    sets = sets.select("comp", "x", "y", "side", "node", "copies", "shingles").repartition(parts(spark), "comp", "x", "y").sortWithinPartitions("comp", "x", "y")
    verified = written(sets.mapInArrow(tidy(_verify(threshold)), "node long, near long, links long"))

    roots = components(verified.select(F.col("node").alias("a"), F.col("near").alias("b")))
    links = verified.groupBy("node").agg(F.sum("links").alias("links"))
    known = reps.select("digest", "node", "rep", "copies").join(roots, "node", "left").join(links, "node", "left")
    known = known.withColumn("root", F.coalesce("root", "node"))
    smallest = known.filter("links > 0").groupBy("root").agg(F.min("rep").alias("class_id"))
    known = known.join(smallest, "root", "left").select("digest", F.coalesce("class_id", "rep").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = sketches.select("doc", "digest", "n").join(known, "digest", "left")
    alone = F.col("n") == 0
    return out.select(F.col("doc").alias(key), F.when(alone, F.col("doc")).otherwise(F.col("class_id")).alias("class_id"),
                      F.when(alone, F.lit(0)).otherwise(F.col("n_links")).cast("long").alias("n_links"), F.col("n").alias("n_shingles"))
