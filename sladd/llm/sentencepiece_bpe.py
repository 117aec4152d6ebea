"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

A text is cut where no piece of the vocabulary can cross: between two characters that never stand side by side inside a
piece. What lies between two cuts is a word here, such as a run of spaces with the letters after it, and words don't influence
each other. The distinct words of some megabytes of text become flat numpy arrays of symbols. In each round every word looks
for the smallest rank among its neighbouring pairs (a segmented minimum), merges all leftmost occurrences of that rank that
don't overlap, and the arrays are compacted; words without a pair leave. Merging all occurrences of a rank at once equals one
merge at a time unless the new piece can take part in a pair of a better or equal rank; the vocabulary tells which pieces can,
and for these only the leftmost occurrence of a word is merged in a round. A word of more than ``LONG`` symbols would need
as many rounds as it holds ranks, so it takes its pairs from a priority queue, in the same order.

Decoding looks the bytes of each id up in the table of pieces. All of it is done within the task that reads the text: nothing
is shuffled, and what a task holds is one batch of texts and the tables of the vocabulary. Long texts are encoded in stretches
that end before a space.

Cases: a null or empty text has the begin and end ids only, and decodes to an empty text; characters outside the vocabulary
become ids of bytes; a literal U+2581 counts as a space, as in the library; repeated rows are encoded each; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

import heapq
import re
from dataclasses import dataclass
from functools import cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sladd.llm.common import gather, short_batches

#: Bytes of text whose distinct words are merged together.
GROUP_BYTES = 4 << 20
#: Symbols of a word beyond which it is merged by a priority queue.
LONG = 2048
NO_PAIR = np.int64(1) << 62
#: How the library writes a space inside pieces.
SPACE = "▁"
CODE_POINTS = 0x110000
#: Kinds of pieces in a model file (fixed values).
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@dataclass
class Vocabulary:
    """Pieces by id as arrays that travel to the tasks.

    A symbol is an id, or ``size`` plus the code point of a character that isn't a piece.
    """

    size: int
    keys: np.ndarray  # left * width + right of every pair that makes a piece, sorted
    ranks: np.ndarray  # its rank; the best score has rank 0, equal scores share a rank
    merged: np.ndarray  # the piece
    alone: np.ndarray  # by id: pieces that are merged one at a time
    chars: np.ndarray  # code points that are pieces
    char_ids: np.ndarray
    near: np.ndarray  # neighbouring code points inside pieces, sorted
    byte_ids: np.ndarray
    raw: list[bytes]  # what an id decodes to
    opens: np.ndarray  # by id: pieces that start with a space
    begin: int
    end: int
    prefix: bool

    @property
    def width(self) -> int:
        return self.size + CODE_POINTS

    @classmethod
    def load(cls, path: str) -> "Vocabulary":
        """Read a model file of the library; raises for what the merge rounds don't cover."""
        from sentencepiece import sentencepiece_model_pb2 as schema

        model = schema.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        trainer, normal = model.trainer_spec, model.normalizer_spec
        if trainer.model_type != trainer.BPE or not trainer.byte_fallback or trainer.treat_whitespace_as_suffix:
            raise ValueError("only BPE models with byte fallback and spaces as prefixes are supported")
        if normal.precompiled_charsmap or normal.remove_extra_whitespaces or not normal.escape_whitespaces or model.denormalizer_spec.precompiled_charsmap:
            raise ValueError("only models that leave the text as it is are supported")
        pieces = [(p.piece, p.score, p.type) for p in model.pieces]
        return cls.of(pieces, trainer.bos_id, trainer.eos_id, normal.add_dummy_prefix, trainer.unk_surface)

    @classmethod
    def of(cls, pieces, begin: int, end: int, prefix: bool = True, unknown: str = " \u2047 ") -> "Vocabulary":
        """From ``(piece, score, kind)`` by id."""
        if {kind for *_, kind in pieces} - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("user-defined and unused pieces are not supported")
        size = len(pieces)
        normal = {piece.replace(SPACE, " "): i for i, (piece, _, kind) in enumerate(pieces) if kind == NORMAL}
        rank = {s: r for r, s in enumerate(sorted({s for _, s, _ in pieces}, reverse=True))}
        rank_of = [rank[s] for _, s, _ in pieces]

        def symbol(part):
            return normal.get(part, size + ord(part) if len(part) == 1 else None)

        width, alone, pairs = size + CODE_POINTS, np.zeros(size, bool), []
        for piece, i in normal.items():
            for cut in range(1, len(piece)):
                left, right = symbol(piece[:cut]), symbol(piece[cut:])
                if left is not None and right is not None:
                    pairs.append((left * width + right, rank_of[i], i))
                    for part in (left, right):
                        if part < size and rank_of[i] <= rank_of[part]:
                            alone[part] = True
        pairs.sort()
        keys, ranks, merged = (np.array([p[k] for p in pairs], np.int64) for k in range(3))
        chars = sorted(p for p in normal if len(p) == 1)
        near = sorted({(ord(a) << 21) | ord(b) for p in normal for a, b in zip(p, p[1:])})
        raw, byte_ids = [], np.zeros(256, np.int64)
        for i, (piece, _, kind) in enumerate(pieces):
            raw.append({NORMAL: piece.replace(SPACE, " ").encode(), UNKNOWN: unknown.encode(), CONTROL: b"", BYTE: bytes([int(piece[3:5], 16)]) if kind == BYTE else b""}[kind])
            if kind == BYTE:
                byte_ids[raw[i][0]] = i
        opens = np.array([kind == NORMAL and piece.startswith(SPACE) for piece, _, kind in pieces])
        return cls(size, keys, ranks, merged, alone, np.array([ord(c) for c in chars], np.int64), np.array([normal[c] for c in chars], np.int64),
                   np.array(near, np.int64), byte_ids, raw, opens, begin, end, prefix)

    @cached_property
    def symbol_of(self) -> np.ndarray:
        """Symbol of each code point."""
        out = np.arange(self.size, self.width, dtype=np.int64)
        out[self.chars] = self.char_ids
        return out

    @cached_property
    def pair_of(self) -> dict[int, tuple[int, int]]:
        return dict(zip(self.keys.tolist(), zip(self.ranks.tolist(), self.merged.tolist())))

    @cached_property
    def words(self) -> re.Pattern:
        """Stretches that no piece crosses: before a space after something else, and around some ASCII characters."""
        inner = set((self.near >> 21).tolist()) | set((self.near & (1 << 21) - 1).tolist())
        lone = re.escape("".join(chr(c) for c in range(128) if c != 32 and c not in inner))
        by_space = not ((self.near & (1 << 21) - 1 == 32) & (self.near >> 21 != 32)).any()
        return re.compile((f"[{lone}]|" if lone else "") + (f" *[^ {lone}]+| +" if by_space else f"[^{lone}]+" if lone else "(?s:.+)"))

    @cached_property
    def blob(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bytes of all ids, and start and length of each id's."""
        sizes = np.array([len(r) for r in self.raw], np.int64)
        return np.frombuffer(b"".join(self.raw), np.uint8), np.cumsum(sizes) - sizes, sizes


def look_up(keys: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each value stands among the sorted keys, and whether it does."""
    if not len(keys):
        return np.zeros(len(asked), np.int64), np.zeros(len(asked), bool)
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return at, keys[at] == asked


def merge_rounds(symbols: np.ndarray, word: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Merge until no pair remains. ``word`` numbers the words in order; returns the symbols left and their words."""
    left, owner = [symbols[:0]], [word[:0]]
    while len(symbols):
        rank, at = np.full(len(symbols), NO_PAIR), np.zeros(len(symbols), np.int64)
        same = np.flatnonzero(word[:-1] == word[1:])
        place, hit = look_up(v.keys, symbols[same] * v.width + symbols[same + 1])
        at[same[hit]] = place[hit]
        rank[same[hit]] = v.ranks[place[hit]]
        starts = np.flatnonzero(np.diff(word, prepend=-1))
        least = np.repeat(np.minimum.reduceat(rank, starts), np.diff(starts, append=len(word)))
        done = least == NO_PAIR
        left.append(symbols[done])
        owner.append(word[done])
        found = np.flatnonzero((rank == least) & ~done)
        # occurrences that overlap stand side by side: every second one of such a run counts, from its left end
        order = np.arange(len(found))
        run = np.maximum.accumulate(np.where(np.diff(found, prepend=-2) > 1, order, 0))
        take = (order - run) % 2 == 0
        single = v.alone[v.merged[at[found]]]
        if single.any():
            take &= (np.diff(word[found], prepend=-1) > 0) | ~np.isin(word[found], word[found[single]])
        into = found[take]
        symbols = symbols.copy()
        symbols[into] = v.merged[at[into]]
        keep = ~done
        keep[into + 1] = False
        symbols, word = symbols[keep], word[keep]
    symbols, word = np.concatenate(left), np.concatenate(owner)
    order = np.argsort(word, kind="stable")
    return symbols[order], word[order]


def merge_queue(symbols: list[int], v: Vocabulary) -> list[int]:
    """The same merges for one long word, one at a time."""
    n = len(symbols)
    after, before, queue = [*range(1, n), -1], [-1, *range(n - 1)], []

    def offer(i, j):
        pair = v.pair_of.get(symbols[i] * v.width + symbols[j]) if i >= 0 and j >= 0 else None
        if pair:
            heapq.heappush(queue, (pair[0], i, j, symbols[i], symbols[j], pair[1]))

    for i in range(n - 1):
        offer(i, i + 1)
    while queue:
        _, i, j, a, b, merged = heapq.heappop(queue)
        if symbols[i] != a or symbols[j] != b or after[i] != j:
            continue
        symbols[i], symbols[j], after[i] = merged, -1, after[j]
        if after[i] >= 0:
            before[after[i]] = i
        offer(before[i], i)
        offer(i, after[i])
    return [s for s in symbols if s >= 0]


def encode_words(words: list[str], v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of some words, and where each word's begin (n + 1)."""
    code = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.int64)
    owner = np.repeat(np.arange(len(words)), np.fromiter(map(len, words), np.int64, len(words)))
    # a word is cut further where no piece crosses
    joined = np.zeros(len(code), bool)
    joined[1:] = look_up(v.near, (code[:-1] << 21) | code[1:])[1] & (owner[1:] == owner[:-1])
    part = np.cumsum(~joined) - 1
    word_of = owner[~joined]
    symbols, long = v.symbol_of[code], (np.bincount(part) > LONG)[part]
    out, own = merge_rounds(symbols[~long], part[~long], v)
    if long.any():
        cuts = np.flatnonzero(np.diff(part[long], prepend=-1))
        more = [merge_queue(s.tolist(), v) for s in np.split(symbols[long], cuts[1:])]
        out = np.concatenate([out, np.fromiter(chain.from_iterable(more), np.int64)])
        own = np.concatenate([own, np.repeat(part[long][cuts], [len(m) for m in more])])
        order = np.argsort(own, kind="stable")
        out, own = out[order], own[order]
    # characters that are no pieces become their bytes
    spelled = np.flatnonzero(out >= v.size)
    code = out[spelled] - v.size
    width = np.ones(len(out), np.int64)
    width[spelled] = 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000)
    own, spelled = np.repeat(own, width), np.repeat(out >= v.size, width)
    out = np.repeat(out, width)
    out[spelled] = v.byte_ids[np.frombuffer("".join(map(chr, code.tolist())).encode(), np.uint8)]
    first = np.zeros(len(words) + 1, np.int64)
    np.cumsum(np.bincount(word_of[own], minlength=len(words)), out=first[1:])
    return out, first


def encode_stretches(texts: list[str], v: Vocabulary) -> list[np.ndarray]:
    """Ids of each text, without begin and end; each distinct word is merged once."""
    split = [v.words.findall(t) for t in texts]
    words = list(dict.fromkeys(chain.from_iterable(split)))
    number = dict(zip(words, range(len(words))))
    places = np.fromiter(map(number.__getitem__, chain.from_iterable(split)), np.int64, sum(map(len, split)))
    ids, first = encode_words(words, v)
    sizes = first[places + 1] - first[places]
    bounds = np.cumsum([0, *map(len, split)])
    total = np.concatenate([[0], np.cumsum(sizes)])
    return np.split(gather(ids, first[places], sizes), total[bounds[1:-1]])


def stretches(text: str, v: Vocabulary, limit: int):
    """The text as the merges see it, in stretches of at least ``limit`` characters that end before a space after something else."""
    text = text.replace(SPACE, " ")
    text = " " + text if v.prefix and text else text
    start, cut = 0, re.compile("(?<=[^ ]) ")
    while text and v.words.pattern.find(" *[^ ") >= 0 and len(text) - start > 2 * limit and (found := cut.search(text, start + limit)):
        yield text[start : found.start()]
        start = found.start()
    yield text[start:]


def encode_texts(texts: list[str], v: Vocabulary, limit: int = GROUP_BYTES) -> list[np.ndarray]:
    """Ids of each text with begin and end."""
    out, some, owner, size = [[np.array([v.begin])] for _ in texts], [], [], 0
    for k, text in enumerate(texts):
        for stretch in stretches(text or "", v, limit):
            some.append(stretch)
            owner.append(k)
            size += len(stretch)
            if size >= limit:
                for i, ids in zip(owner, encode_stretches(some, v)):
                    out[i].append(ids)
                some, owner, size = [], [], 0
    for i, ids in zip(owner, encode_stretches(some, v) if some else []):
        out[i].append(ids)
    return [np.concatenate([*ids, [v.end]]).astype("<u4") for ids in out]


def utf8(data: bytes) -> str:
    """Decoded, with one U+FFFD for each byte that isn't UTF-8."""
    out = []
    while True:
        try:
            return "".join(out) + data.decode()
        except UnicodeDecodeError as e:
            out += [data[: e.start].decode(), "\ufffd" * (e.end - e.start)]
            data = data[e.end :]


def decode_ids(ids: np.ndarray, v: Vocabulary) -> str:
    """The text of some ids: the space that encoding put before a text goes, bytes that aren't UTF-8 become U+FFFD."""
    blob, starts, sizes = v.blob
    # bytes on both sides of a control piece never make one character
    runs = [r[sizes[r] > 0] for r in np.split(ids, np.flatnonzero(sizes[ids] == 0))]
    runs = [r for r in runs if len(r)]
    text = "".join(utf8(gather(blob, starts[r], sizes[r]).tobytes()) for r in runs)
    return text[1:] if v.prefix and runs and v.opens[runs[0][0]] else text


def encode(docs: DataFrame, vocabulary: str | None = None, key: str = "doc_id", text: str = "text", decoded: bool = False) -> DataFrame:
    """``key, ids``: ids as little-endian unsigned 32-bit integers; with ``decoded`` also the text that they decode to."""
    v = Vocabulary.load(vocabulary or default_vocabulary())
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            ids = encode_texts(batch.column(1).to_pylist(), v)
            for a in range(0, len(ids), 256):
                some = ids[a : a + 256]
                columns = [batch.column(0).slice(a, len(some)), pa.array([i.tobytes() for i in some], pa.binary())]
                columns += [pa.array([decode_ids(i, v) for i in some], pa.string())] * decoded
                yield pa.record_batch(columns, names=["key", "ids", "decoded"][: len(columns)])

    out = short_batches(docs).select(key, text).mapInArrow(run, f"key {kind}, ids binary" + ", decoded string" * decoded)
    return out.withColumnRenamed("key", key)


def decode(encoded: DataFrame, vocabulary: str | None = None, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``key, text`` from ids as :func:`encode` gives them; null or no ids give an empty text."""
    v = Vocabulary.load(vocabulary or default_vocabulary())
    kind = encoded.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            texts = [decode_ids(np.frombuffer(i or b"", "<u4"), v) for i in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.string())], names=["key", "text"])

    return short_batches(encoded).select(key, ids).mapInArrow(run, f"key {kind}, text string").withColumnRenamed("key", key)
