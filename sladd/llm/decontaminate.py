"""Benchmark passages in documents, found by streaming the words through a generalised suffix automaton.

The automaton is built over the words of all benchmark items of a block; blocks have a bounded size, so what goes to the
tasks is bounded, and a larger benchmark takes several blocks whose spans are merged for each document. Words are hashed by
whole arrays first, and only runs of words that all occur in the block go through the automaton, word by word: no window
can lie outside such a run. The automaton gives the longest match that ends at each word; a match of ``window`` words or more
covers them, and the state that holds the last ``window`` words names the items. Items with fewer words are one window each.

Cases: words are ``[0-9a-z\\x80-]+`` after lower-casing A-Z; null or empty texts have no words and no hits; items without
words have no window; items with the same words are all named; an item without an id counts like any other, its name
in ``items`` is null; repeated rows are judged each; an empty benchmark hits nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sladd.llm.common import LOWER, WORD_BYTE, fingerprint, groups, kept, short_batches, text_bytes, tidy, words

WINDOW = 10
#: Bytes of benchmark text in a block.
BLOCK_BYTES = 8 << 20
SPLIT = bytes(b if WORD_BYTE[b] else 32 for b in LOWER.tolist())


def tokens(text: bytes) -> list[bytes]:
    return text.translate(SPLIT).split()


class Automaton:
    """Suffix automaton of several word sequences, with the items of each window; items of equal words are one group."""

    def __init__(self, items: list[tuple[object, bytes]], window: int):
        self.window, self.next, self.link, self.size = window, [{}], [-1], [0]
        by_words: dict[tuple, set] = {}
        for item, text in items:
            by_words.setdefault(tuple(tokens(text)), set()).add(item)
        self.names = list(by_words.values())
        sequences = list(enumerate(by_words))
        for _, seq in sequences:
            last = 0
            for word in seq:
                last = self._extend(last, word)
        self.items: dict[int, set] = {}
        self.short: dict[int, list[tuple[int, int]]] = {}
        self.shortest = window
        for item, seq in sequences:
            if not seq:
                continue
            if len(seq) < window:
                self.shortest = min(self.shortest, len(seq))
                self.short.setdefault(self._state(seq), []).append((len(seq), item))
                continue
            state, length = 0, 0
            for word in seq:
                state, length = self.next[state][word], length + 1
                if length >= window:
                    self.items.setdefault(self.holder(state), set()).add(item)
        #: The nearest state up the suffix links, itself included, at which a short item ends.
        self.near = [-1] * len(self.next)
        for state in sorted(range(len(self.next)), key=self.size.__getitem__):
            self.near[state] = state if state in self.short else self.near[self.link[state]] if state else -1
        #: Hashes of all words.
        self.hashes = np.sort(words([b"\n".join(sorted({w for _, seq in sequences for w in seq}))])[3])

    def _extend(self, last: int, word: bytes) -> int:
        nxt, link, size = self.next, self.link, self.size

        def clone(source, target):
            copy = len(nxt)
            nxt.append(dict(nxt[target]))
            link.append(link[target])
            size.append(size[source] + 1)
            while source >= 0 and nxt[source].get(word) == target:
                nxt[source][word] = copy
                source = link[source]
            return copy

        if word in nxt[last]:
            known = nxt[last][word]
            if size[known] == size[last] + 1:
                return known
            copy = clone(last, known)
            link[known] = copy
            return copy
        made = len(nxt)
        nxt.append({})
        link.append(0)
        size.append(size[last] + 1)
        at = last
        while at >= 0 and word not in nxt[at]:
            nxt[at][word] = made
            at = link[at]
        if at >= 0:
            known = nxt[at][word]
            if size[known] == size[at] + 1:
                link[made] = known
            else:
                link[made] = link[known] = clone(at, known)
        return made

    def _state(self, seq):
        state = 0
        for word in seq:
            state = self.next[state][word]
        return state

    def holder(self, state: int) -> int:
        """Up the suffix links, the state that holds the last ``window`` words."""
        while self.size[self.link[state]] >= self.window:
            state = self.link[state]
        return state

    def match(self, run: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Covered ranges of the run, and the groups of items whose windows occur."""
        spans, found, done = [], set(), set()
        state = length = 0
        nxt, link, size, near, window = self.next, self.link, self.size, self.near, self.window
        for i, word in enumerate(run):
            to = nxt[state].get(word)
            while to is None and state:
                state = link[state]
                length = size[state]
                to = nxt[state].get(word)
            if to is None:
                continue
            state, length = to, length + 1
            if length >= window:
                spans.append((i + 1 - length, i + 1))
                if state not in done:
                    done.add(state)
                    found |= self.items.get(self.holder(state), set())
            at = near[state]
            while at > 0:
                for n, item in self.short[at]:
                    if n <= length:
                        spans.append((i + 1 - n, i + 1))
                        found.add(item)
                at = near[link[at]]
        return spans, found


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def _scan(block, window):
    """``spans`` counts words; ``cuts`` has the same spans as byte ranges of the text."""

    def run(batches):
        items = block.value
        auto = kept("automaton", (hash(tuple(items)), window), lambda: Automaton(items, window))
        for batch in batches:
            texts, rows = text_bytes(batch.column(2)), []
            for a, b in groups(texts):
                low, starts, ends, hashes, first = words(texts[a:b])
                at = np.searchsorted(auto.hashes, hashes)
                known = np.zeros(len(hashes), bool)
                if len(auto.hashes):
                    known = auto.hashes[np.minimum(at, len(auto.hashes) - 1)] == hashes
                raw = low.tobytes()
                edges = np.diff(np.concatenate([[False], known, [False]]).astype(np.int8))
                runs = np.stack([np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)], 1)
                runs = runs[runs[:, 1] - runs[:, 0] >= auto.shortest]
                found: dict[int, tuple[list, set]] = {}
                for begin, end in runs.tolist():
                    doc = int(np.searchsorted(first, begin, "right")) - 1
                    while begin < end:  # a run may go on into the next text
                        stop = min(end, int(first[doc + 1]))
                        if stop - begin >= auto.shortest:
                            seq = [raw[s:e] for s, e in zip(starts[begin:stop].tolist(), ends[begin:stop].tolist())]
                            spans, names = auto.match(seq)
                            if spans:
                                have = found.setdefault(doc, ([], set()))
                                have[0].extend((begin + s, begin + e) for s, e in spans)
                                have[1].update(names)
                        begin, doc = stop, doc + 1
                offset = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts[a:b]])])
                for doc in range(b - a):
                    n = int(first[doc + 1] - first[doc])
                    spans, names = found.get(doc, ([], set()))
                    spans = merge(spans)
                    flat = [int(x - first[doc]) for s in spans for x in s]
                    cuts = [int(x - offset[doc]) for s, e in spans for x in (starts[s], ends[e - 1])]
                    rows.append((n, flat, cuts, sorted({x for k in names for x in auto.names[k]}, key=lambda x: (x is not None, x))))
            yield pa.record_batch(
                [batch.column(0), batch.column(1), pa.array([r[0] for r in rows], pa.int64()),
                 *(pa.array([r[k] for r in rows], pa.list_(t)) for k, t in ((1, pa.int64()), (2, pa.int64()), (3, pa.string())))],
                names=["rest", "fp", "n_words", "spans", "cuts", "items"])

    return run


def _merge_blocks(batches):
    for batch in batches:
        out = []
        for k in (1, 2):
            out.append([[x for s in merge([p for flat in lists for p in zip(flat[::2], flat[1::2])]) for x in s] for lists in batch.column(k).to_pylist()])
        yield pa.record_batch([batch.column(0), *(pa.array(o, pa.list_(pa.int64())) for o in out)], names=["rest", "spans", "cuts"])


def find_contamination(docs: DataFrame, benchmark: DataFrame, keys: list[str], text: str = "text", item: str = "item_id", item_text: str = "text",
                       window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``rest`` (struct of ``keys``), ``n_words, spans, cuts, items`` for each row.

    ``spans`` lists start and end of each covered range in words, ``cuts`` the same ranges in bytes, ``items`` the item ids as strings, with one null for all items without an id.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(item).cast("string").alias("item"), F.coalesce(F.col(item_text).cast("string"), F.lit("")).alias("t"))
    total = items.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    n_blocks = max(1, -(-total * 2 // block_bytes)) if total > block_bytes else 1
    base = short_batches(docs).select(F.struct(*[F.col(f"`{k}`") for k in keys]).alias("rest"), fingerprint(text).alias("fp"), F.col(text))
    kind = base.schema["rest"].dataType.simpleString()
    schema = f"rest {kind}, fp long, n_words long, spans array<long>, cuts array<long>, items array<string>"
    found = None
    for number in range(n_blocks):
        part = items.filter(F.pmod(F.xxhash64("t"), F.lit(n_blocks)) == number) if n_blocks > 1 else items
        block = sorted(((r.item, r.t.encode()) for r in part.collect()), key=lambda i: (i[0] is not None, i))  # at most about block_bytes
        one = base.mapInArrow(tidy(_scan(spark.sparkContext.broadcast(block), window)), schema)
        found = one if found is None else found.unionByName(one)
    if n_blocks == 1:
        return found.drop("fp")
    joined = found.groupBy("rest", "fp").agg(
        F.first("n_words").alias("n_words"), F.collect_list("spans").alias("spans"), F.collect_list("cuts").alias("cuts"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), (F.count("*") / n_blocks).cast("int").alias("copies"))
    merged = joined.select(F.struct("rest", "n_words", "items", "copies").alias("rest"), "spans", "cuts")
    merged = merged.mapInArrow(_merge_blocks, f"rest {merged.schema['rest'].dataType.simpleString()}, spans array<long>, cuts array<long>")
    return merged.select("rest.rest", "rest.n_words", "spans", "cuts", "rest.items", F.explode(F.sequence(F.lit(1), "rest.copies")).alias("copy")).drop("copy")


def _cut(batches):
    for batch in batches:
        texts = []
        for text, cuts in zip(text_bytes(batch.column(1)), batch.column(2).to_pylist()):
            edges = [0, *cuts, len(text)]
            texts.append(b"".join([text[a:b] for a, b in zip(edges[::2], edges[1::2])]))
        yield pa.record_batch([batch.column(0), pa.array(texts, pa.binary()).cast(pa.string())], names=["rest", "text"])


def remove_contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", most: float = 0.5, **limits) -> DataFrame:
    """All columns of ``docs``: covered ranges are cut out; rows of which more than ``most`` of the words are covered go."""
    found = find_contamination(docs, benchmark, docs.columns, text, **limits)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: x - a)
    low = found.filter(hit <= most * F.col("n_words")).select("rest", F.col(f"rest.`{text}`").alias("text"), "cuts")
    kind = low.schema["rest"].dataType.simpleString()
    both = low.mapInArrow(tidy(_cut), f"rest {kind}, text string")
    return both.select(*[F.col("text").alias(c) if c == text else F.col(f"rest.`{c}`").alias(c) for c in docs.columns])
