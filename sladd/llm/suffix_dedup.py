"""Byte ranges that occur earlier in the corpus, by a sorted array of sampled suffixes.

A byte goes if a string of ``WINDOW`` bytes that covers it also starts earlier (smaller document id, or the same document at an
earlier place). Suffixes are taken at anchors only: the starts of ``ANCHOR``-byte strings whose hash is smallest among all
that lie in some window. Equal windows have their anchors at the same places, so no repeat is missed, and about one start in
thirty remains.

1. Anchors with their hash, and a digest of the whole neighbourhood that any window around them can reach, meet by hash. A
   neighbourhood that was met before is a repeat as a whole. Anchors that are alone, or have one neighbourhood only, are done.
2. For the first anchor of each other neighbourhood, the suffix and the reversed text before it are cut from the text. Spark
   samples splitters and range-partitions the suffixes by their leading bytes.
3. Each range sorts its suffixes by multikey quicksort, eight bytes at a time, and likewise the texts before them. Common
   prefixes of neighbours give classes of equal bytes to the right and left, and two members of a window's pair of classes
   hold the same window: all but the earliest are repeats. A frequent anchor is spread over several ranges by its whole key;
   windows that reach a boundary of their range are compared across it by a small grouping of window digests.

Memory: a task holds one range, one hash bucket or one chunk of texts; an anchor with more than ``GROUP`` neighbourhoods is
spread. Repeats inside a task are settled there, so of a hot group at most one entry a task and neighbourhood is shuffled.

Cases: null or empty texts and texts under ``WINDOW`` bytes lose nothing; matches never cross texts; rows that repeat an id
are judged alike, as one document; a null id counts as the smallest; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F

from sladd.llm.common import GROUP_BYTES, mix, parts, short_batches, text_bytes, written

WINDOW, ANCHOR = 100, 40
REACH = WINDOW - ANCHOR
#: More neighbourhoods of one anchor than this never meet in one task.
GROUP = 20_000
NO_ID = -(1 << 63)
FULL = (1 << (REACH + 1)) - 1
PAD = b"\xff" * REACH
RECORD = "bucket long, kind int, h binary, ctx binary, doc binary, pos binary"
MARKS = "chunk long, kind int, doc binary, pos binary, mask binary"
#: Kinds of records: candidates, repeats known already, frequent anchors of other buckets, candidates spread over the buckets.
ALONE, REPEAT, NAMED, SPREAD = range(4)


def chunk_count(n: int) -> int:
    """The next prime, so that regular ids are dealt evenly."""
    while any(n % k == 0 for k in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def _hash_pairs(a, b, factor):
    return mix(a * np.uint64(factor) + b)


def anchor_hashes(data: np.ndarray) -> np.ndarray:
    """Hashes of all ``ANCHOR``-byte strings."""
    h1 = data.astype(np.uint64) + np.uint64(1)
    h2 = (h1[:-1] << np.uint64(9)) + h1[1:]
    h4 = (h2[:-2] << np.uint64(18)) + h2[2:]
    h8 = _hash_pairs(h4[:-4], h4[4:], 0x9E3779B97F4A7C15)
    h16 = _hash_pairs(h8[:-8], h8[8:], 0xD6E8FEB86659FD93)
    h32 = _hash_pairs(h16[:-16], h16[16:], 0xA0761D6478BD642F)
    return _hash_pairs(h32[:-8], h8[32:], 0xE7037ED1A0B428DB)


def _extreme(values, width, best):
    """Running minimum or maximum of ``width`` values."""
    reach = 1
    while reach * 2 <= width:
        values = best(values[:-reach], values[reach:])
        reach *= 2
    return best(values[: len(values) - (width - reach)], values[width - reach :]) if width > reach else values


def anchors(pieces: list[tuple[bytes, int, int, int]]):
    """For pieces ``(text, first window, last window + 1, row)``: rows, places, hashes and neighbourhood digests of the anchors."""
    buffers, starts, size = [], [], 0
    for text, first, last, _ in pieces:
        lead = min(first, REACH)
        end = min(len(text), last + WINDOW + 2 * REACH)
        body = PAD[lead:] + text[first - lead : end] + PAD
        buffers.append(body)
        starts.append(size + REACH)
        size += len(body)
    data = np.frombuffer(b"".join(buffers) + PAD + PAD, np.uint8)
    raw = anchor_hashes(data)
    n = len(raw)
    starts, counts = np.array(starts), np.array([last - first for _, first, last, _ in pieces])
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + counts, -1)
    window = np.cumsum(edge[:-1]) > 0  # places where a window of the piece starts
    least = _extreme(raw, REACH + 1, np.minimum)
    least = np.where(window[: len(least)], least, 0)
    most = _extreme(np.concatenate([np.zeros(REACH, np.uint64), least]), REACH + 1, np.maximum)
    at = np.flatnonzero((raw[: len(most)] == most) & (most > 0))
    piece = np.searchsorted(starts, at, "right") - 1
    context = raw[at - REACH]
    for step in (ANCHOR - REACH, 2 * ANCHOR - REACH, REACH):
        context = _hash_pairs(context, raw[at + step], 0x8EBC6AF09C88C6E3)
    firsts, rows = np.array([p[1] for p in pieces]), np.array([p[3] for p in pieces])
    return rows[piece], at - starts[piece] + firsts[piece], raw[at], context


def _find(buckets, chunks, spread_from):
    """Records of a task by bucket of the hash; repeats inside the task are settled."""

    def flush(docs, found):
        row, pos, h, ctx = (np.concatenate(c) for c in zip(*found))
        doc = np.array(docs, np.int64)[row]
        order = np.lexsort((pos, doc, ctx, h))
        doc, pos, h, ctx = doc[order], pos[order], h[order], ctx[order]
        same = np.zeros(len(h), bool)
        same[1:] = (h[1:] == h[:-1]) & (ctx[1:] == ctx[:-1])
        twice = same.copy()
        twice[1:] &= (doc[1:] == doc[:-1]) & (pos[1:] == pos[:-1])  # met in two pieces of one text, or in rows that repeat
        same &= ~twice
        new = ~same & ~twice
        starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        sizes = np.add.reduceat(new.astype(np.int64), starts)
        hot = np.repeat(sizes > spread_from, np.diff(np.append(starts, len(h))))
        yield from _deal(ALONE, (h % np.uint64(buckets)).astype(np.int64), new & ~hot, h, ctx, doc, pos)
        yield from _deal(SPREAD, (mix(h ^ ctx) % np.uint64(buckets)).astype(np.int64), new & hot, h, ctx, doc, pos)
        yield from _deal(REPEAT, doc % chunks % buckets, same, h[:0], ctx[:0], doc, pos)
        first = np.zeros(len(h), bool)
        first[starts[sizes > spread_from]] = True
        yield from _deal(NAMED, (h % np.uint64(buckets)).astype(np.int64), first, h, ctx[:0], doc[:0], pos[:0])

    def _deal(kind, bucket, mask, h, ctx, doc, pos):
        at = np.flatnonzero(mask)
        if not len(at):
            return
        at = at[np.argsort(bucket[at], kind="stable")]
        names, cuts = np.unique(bucket[at], return_index=True)
        rows = []
        for b, own in zip(names.tolist(), np.split(at, cuts[1:])):
            own = own[np.lexsort((pos[own], doc[own]))] if len(doc) else own
            rows.append((b, kind, *(c[own].tobytes() if len(c) else b"" for c in (h, ctx, doc, pos.astype(np.int32)))))
        kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
        yield pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["bucket", "kind", "h", "ctx", "doc", "pos"])

    def run(batches):
        docs, found, pieces, size, held = [], [], [], 0, 0
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1))):
                for first in range(0, len(text) - WINDOW + 1, 2 * GROUP_BYTES):
                    last = min(first + 2 * GROUP_BYTES, len(text) - WINDOW + 1)
                    pieces.append((text, first, last, len(docs)))
                    size += last - first + WINDOW
                    if size > GROUP_BYTES:
                        found.append(anchors(pieces))
                        held += len(found[-1][0])
                        pieces, size = [], 0
                docs.append(NO_ID if key is None else key)
                if held > 1_500_000 and not pieces:
                    yield from flush(docs, found)
                    docs, found, held = [], [], 0
        if pieces:
            found.append(anchors(pieces))
        if found:
            yield from flush(docs, found)

    return run


def _joined(rows: pa.Table, column: str, kind) -> np.ndarray:
    return np.frombuffer(b"".join(rows.column(column).to_pylist()), kind)


def _marks(chunk, kind, doc, pos, mask=None):
    """Rows of marks by chunk."""
    at = np.argsort(chunk, kind="stable")
    names, cuts = np.unique(chunk[at], return_index=True)
    rows = []
    for c, own in zip(names.tolist(), np.split(at, cuts[1:]) if len(at) else []):
        rows.append((c, kind, doc[own].tobytes(), pos[own].astype(np.int32).tobytes(), b"" if mask is None else mask[own].tobytes()))
    return rows


def _mark_batch(rows):
    kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
    return pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["chunk", "kind", "doc", "pos", "mask"])


def _meet(chunks):
    """Anchors of a hash bucket: repeats, and the candidates whose anchor has several neighbourhoods."""

    def run(rows: pa.Table) -> pa.Table:
        kind = rows.column("kind").to_numpy()
        passed = rows.filter(pa.array(kind == REPEAT))
        doc, pos = _joined(passed, "doc", np.int64), _joined(passed, "pos", np.int32)
        out = _marks(doc % chunks, REPEAT, doc, pos)
        named = np.unique(_joined(rows.filter(pa.array(kind == NAMED)), "h", np.uint64))
        for sort in (ALONE, SPREAD):
            some = rows.filter(pa.array(kind == sort))
            h, ctx, doc, pos = (_joined(some, c, t) for c, t in (("h", np.uint64), ("ctx", np.uint64), ("doc", np.int64), ("pos", np.int32)))
            if sort == ALONE:
                ordered = np.sort(h)
                often = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
                keep = np.isin(h, np.union1d(often, named))
                h, ctx, doc, pos = h[keep], ctx[keep], doc[keep], pos[keep]
            order = np.lexsort((pos, doc, ctx, h))
            h, ctx, doc, pos = h[order], ctx[order], doc[order], pos[order]
            if not len(h):
                continue
            new_h = np.concatenate([[True], h[1:] != h[:-1]])
            new = np.concatenate([[True], (ctx[1:] != ctx[:-1])]) | new_h
            out += _marks(doc[~new] % chunks, REPEAT, doc[~new], pos[~new])
            sizes = np.add.reduceat(new.astype(np.int64), np.flatnonzero(new_h))
            several = np.repeat(sizes > 1, np.diff(np.append(np.flatnonzero(new_h), len(h)))) | np.isin(h, named) | (sort == SPREAD)
            # what is spread in any task is spread everywhere
            hot = np.isin(h, named) | (sort == SPREAD)
            for flag, pick in ((ALONE, new & several & ~hot), (SPREAD, new & several & hot)):
                out += _marks(doc[pick] % chunks, flag, doc[pick], pos[pick])
        return pa.Table.from_batches([_mark_batch(out)])

    return run


def _pack(chunks):
    """Texts by chunk, compressed: chunk, ids, lengths, body."""

    squeeze = zstandard.ZstdCompressor

    def flush(held):
        rows = [(c, np.array(ids, np.int64).tobytes(), np.array([len(t) for t in texts], np.int64).tobytes(), squeeze(level=3).compress(b"".join(texts)))
                for c, (ids, texts) in held.items()]
        kinds = (pa.int64(), pa.binary(), pa.binary(), pa.binary())
        return pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["chunk", "ids", "sizes", "body"])

    def run(batches):
        held: dict[int, tuple[list, list]] = {}
        size = 0
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1))):
                key = NO_ID if key is None else key
                ids, texts = held.setdefault(key % chunks, ([], []))
                ids.append(key)
                texts.append(text)
                size += len(text)
            if size > PACK_BYTES:
                yield flush(held)
                held, size = {}, 0
        yield flush(held)

    return run


#: Bytes of text that a task packs at a time.
PACK_BYTES = 24 << 20
PACK = "chunk long, ids binary, sizes binary, body binary"


def _texts(packs: pa.Table):
    expand = zstandard.ZstdDecompressor().decompress
    for ids, sizes, body in zip(*(packs.column(c).to_pylist() for c in ("ids", "sizes", "body"))):
        body, at = expand(body), 0
        for key, n in zip(np.frombuffer(ids, np.int64).tolist(), np.frombuffer(sizes, np.int64).tolist()):
            yield key, body[at : at + n]
            at += n


def _by_doc(marks: pa.Table):
    """Marks of a chunk: ids in order, where each one's marks begin, places, and what else is given."""
    doc, pos = _joined(marks, "doc", np.int64), _joined(marks, "pos", np.int32)
    order = np.lexsort((pos, doc))
    ids, starts = np.unique(doc[order], return_index=True)
    return dict(zip(ids.tolist(), zip(starts.tolist(), [*starts[1:].tolist(), len(doc)]))), pos[order], order


def _cut(packs: pa.Table, marks: pa.Table) -> pa.Table:
    """Suffixes of candidates: leading bytes, whole suffix, reversed text before it, id, place. ``tail`` spreads frequent anchors."""
    kinds = np.repeat(marks.column("kind").to_numpy(), [len(p) // 4 for p in marks.column("pos").to_pylist()]) if marks.num_rows else np.zeros(0, np.int32)
    where, places, order = _by_doc(marks)
    kinds, done, out = kinds[order], set(), []
    for key, text in _texts(packs):
        if key not in where or key in done:
            continue
        done.add(key)
        a, b = where[key]
        for pos, kind in zip(places[a:b].tolist(), kinds[a:b].tolist()):
            suffix, before = text[pos : pos + WINDOW], text[max(0, pos - REACH) : pos][::-1]
            out.append((suffix[:ANCHOR], suffix + b"\xff" + before if kind == SPREAD else b"", suffix, before, key, pos))
    types = (pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int32())
    return pa.table([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names=["head", "tail", "suffix", "before", "doc", "pos"])


SUFFIX = "head binary, tail binary, suffix binary, before binary, doc long, pos int"


def multikey_quicksort(strings: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the strings, and the bytes that each shares with its predecessor in it.

    Eight bytes are one key: the strings are parted by it, and only runs of equal keys go on to the next one.
    """
    n = len(strings)
    words = -(-width // 8)
    padded = np.frombuffer(b"".join(s.ljust(8 * words, b"\x00") for s in strings), ">u8").reshape(n, words).astype(np.uint64)
    order, run, active = np.arange(n), np.zeros(n, np.int64), np.arange(n)
    lengths = np.array([len(s) for s in strings], np.int64)
    for k in range(words + 1):
        if len(active) < 2:
            break
        key = padded[order[active], k] if k < words else lengths[order[active]]
        inner = np.lexsort((key, run[active]))
        order[active] = order[active][inner]
        key = key[inner]
        fresh = np.concatenate([[True], (key[1:] != key[:-1]) | (run[active][1:] != run[active][:-1])])
        run[active] = active[np.maximum.accumulate(np.where(fresh, np.arange(len(active)), 0))]
        sizes = np.bincount(run[active], minlength=n)
        active = active[sizes[run[active]] > 1]
    common = np.zeros(n, np.int64)
    if n > 1:
        data = padded.byteswap().view(np.uint8).reshape(n, 8 * words)[order]
        for a in range(1, n, 1 << 16):
            b = min(n, a + (1 << 16))
            differ = data[a:b] != data[a - 1 : b - 1]
            common[a:b] = np.where(differ.any(1), differ.argmax(1), 8 * words)
        lengths = lengths[order]
        common[1:] = np.minimum(common[1:], np.minimum(lengths[1:], lengths[:-1]))
    return order, common


def _classes(order, common, length):
    """For each string, the number of its class of equal first ``length`` bytes."""
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(common < length)
    return out


def repeats(suffix: list[bytes], before: list[bytes], doc: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bit ``o`` of each member's masks: the window that starts ``o`` bytes before it exists; it stands earlier with another member."""
    n = len(suffix)
    right_order, right = multikey_quicksort(suffix, WINDOW)
    left_order, left = multikey_quicksort(before, REACH)
    right_size, left_size = np.array([len(s) for s in suffix]), np.array([len(s) for s in before])
    earlier = np.lexsort((pos, doc))
    exists, found = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    for o in range(REACH + 1):
        have = (left_size >= o) & (right_size >= WINDOW - o)
        exists[have] |= np.uint64(1 << o)
        r = _classes(right_order, right, WINDOW - o)
        own = earlier[have[earlier]]
        # a window repeats only where its right part does
        own = own[np.bincount(r, weights=have, minlength=n + 1)[r[own]] > 1]
        if len(own) < 2:
            continue
        key = r[own] * np.int64(n + 1) + _classes(left_order, left, o)[own]
        _, firsts = np.unique(key, return_index=True)
        again = np.ones(len(own), bool)
        again[firsts] = False
        found[own[again]] |= np.uint64(1 << o)
    return exists, found


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return next(i for i in range(n) if a[i] != b[i])


def _compare(chunks):
    """Sort one range of suffixes and mark what repeats.

    A spread anchor may go on in the ranges before and after. Of its windows that come first here, those that the first or last
    suffix of the range has in part are asked for by digest.
    """

    def run(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        suffix, before = table.column("suffix").to_pylist(), table.column("before").to_pylist()
        doc, pos = table.column("doc").to_numpy(), table.column("pos").to_numpy().astype(np.int64)
        spread = np.array([len(t) > 0 for t in table.column("tail").to_pylist()])
        exists, found = repeats(suffix, before, doc, pos)
        hit = found > 0
        rows = [(c, d, p, m, None) for c, _, d, p, m in _marks(doc[hit] % chunks, REPEAT, doc[hit], pos[hit], found[hit])]
        yield _asked(rows)
        rows = []
        # ranges follow the suffixes, so only windows whose right part is that of the first or last suffix can go on beyond
        keys = list(zip(table.column("head").to_pylist(), table.column("tail").to_pylist()))
        edges = [suffix[keys.index(edge)] for edge in (min(keys), max(keys))]
        for i in np.flatnonzero(spread).tolist():
            reach = max(common_prefix(suffix[i], edge) for edge in edges)
            if reach < ANCHOR:
                continue
            beyond = FULL ^ ((1 << (WINDOW - reach)) - 1)
            around, mask = before[i][::-1] + suffix[i], int(exists[i] & ~found[i]) & beyond
            for o in range(REACH + 1):
                if mask >> o & 1:
                    start = len(before[i]) - o
                    rows.append((int(doc[i]), None, None, None, (xxhash.xxh3_128_digest(around[start : start + WINDOW]), int(pos[i]) - o)))
            if len(rows) > 20_000:
                yield _asked(rows)
                rows = []
        yield _asked(rows)

    return run


ASKED = "chunk long, doc binary, pos binary, mask binary, digest binary, start long"


def _asked(rows):
    columns = [[r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows], [r[3] for r in rows],
               [r[4] and r[4][0] for r in rows], [r[4] and r[4][1] for r in rows]]
    types = (pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.int64())
    return pa.record_batch([pa.array(c, t) for c, t in zip(columns, types)], names=["chunk", "doc", "pos", "mask", "digest", "start"])


def covered(size: int, places: np.ndarray, masks: np.ndarray) -> list[int]:
    """Start and end of each maximal covered run of a text."""
    edge = np.zeros(size + 1, np.int32)
    whole = masks == FULL
    np.add.at(edge, np.maximum(places[whole] - REACH, 0), 1)
    np.add.at(edge, np.minimum(places[whole] + WINDOW, size), -1)
    for pos, mask in zip(places[~whole].tolist(), masks[~whole].tolist()):
        while mask:
            low = (mask & -mask).bit_length() - 1
            high = low
            while mask >> (high + 1) & 1:
                high += 1
            edge[max(0, pos - high)] += 1
            edge[min(size, pos - low + WINDOW)] -= 1
            mask &= ~((1 << (high + 1)) - 1)
    on = np.cumsum(edge[:size]) > 0
    return np.flatnonzero(np.diff(on, prepend=False, append=False)).tolist()


def _remove(packs: pa.Table, marks: pa.Table) -> pa.Table:
    where, places, order = _by_doc(marks)
    masks = np.zeros(0, np.int64)
    if marks.num_rows:
        masks = np.concatenate([np.frombuffer(m, np.int64) if m else np.full(len(p) // 4, FULL) for p, m in zip(marks.column("pos").to_pylist(), marks.column("mask").to_pylist())])[order]
    out, batches = [], []

    def batch():
        types = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary())
        batches.append(pa.record_batch([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names=["doc", "n_bytes", "spans", "kept"]))
        out.clear()

    for key, text in _texts(packs):
        spans, kept = [], text
        if key in where:
            a, b = where[key]
            inside = places[a:b] < len(text)
            spans = covered(len(text), places[a:b][inside].astype(np.int64), masks[a:b][inside])
            cuts = [0, *spans, len(text)]
            kept = b"".join([text[s:e] for s, e in zip(cuts[::2], cuts[1::2])])
        out.append((None if key == NO_ID else key, len(text), spans, kept))
        if len(out) >= 1000:
            batch()
    batch()
    return pa.Table.from_batches(batches)


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", group: int = GROUP) -> DataFrame:
    """``key, n_bytes, spans, kept`` for each row: removed ranges as starts and ends in bytes, and the bytes that stay."""
    spark = docs.sparkSession
    buckets, chunks = parts(spark, 2), chunk_count(parts(spark, 4))
    base = short_batches(docs).select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text"))
    spread_from = max(2, group // max(1, base.rdd.getNumPartitions()))
    records = base.mapInArrow(_find(buckets, chunks, spread_from), RECORD)
    marks = written(records.groupBy("bucket").applyInArrow(_meet(chunks), MARKS))
    packs = base.mapInArrow(_pack(chunks), PACK)
    candidates = marks.filter(F.col("kind") != REPEAT)
    suffixes = packs.groupBy("chunk").cogroup(candidates.groupBy("chunk")).applyInArrow(_cut, SUFFIX)
    ranges = suffixes.repartitionByRange(parts(spark), "head", "tail")
    judged = written(ranges.mapInArrow(_compare(chunks), ASKED))
    asked = judged.filter(F.col("digest").isNotNull()).select("digest", F.struct(F.col("chunk").alias("doc"), "start").alias("at"))
    firsts = asked.groupBy("digest").agg(F.min("at").alias("first"))
    later = asked.join(firsts, "digest").filter(F.col("at") > F.col("first")).select("at.doc", "at.start")
    late = _late(later, chunks)
    found = marks.filter(F.col("kind") == REPEAT).select("chunk", "doc", "pos", "mask")
    found = found.unionByName(judged.filter(F.col("digest").isNull()).select("chunk", "doc", "pos", "mask")).unionByName(late)
    out = packs.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(_remove, "doc long, n_bytes long, spans array<long>, kept binary")
    return out.withColumnRenamed("doc", key)


def _late(later: DataFrame, chunks: int) -> DataFrame:
    """Marks of windows that another range has earlier."""

    def run(batches):
        for batch in batches:
            doc, start = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            rows = _marks(doc % chunks, REPEAT, doc, start, np.ones(len(doc), np.int64))
            yield pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in ((0, pa.int64()), (2, pa.binary()), (3, pa.binary()), (4, pa.binary()))],
                                  names=["chunk", "doc", "pos", "mask"])

    return later.mapInArrow(run, "chunk long, doc binary, pos binary, mask binary")
