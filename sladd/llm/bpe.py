"""BPE encoding and decoding through a table of distinct words.

A word is a run without ASCII white space; the tokenizer drops white space and never merges across it, so the ids of a text
are those of its words in order. Documents are packed into chunks of bounded size. A chunk becomes the list of its distinct
words and, for each document, the positions of its words in that list. The lists of all chunks meet by word hash, where each
distinct word is encoded once; the ids go back to the chunks that asked, and are put in place by position. Chunks are a table bucketed by
their name, so their positions stay where they are. Decoding looks the
pieces up by id in the id-to-piece table, once for each distinct word. What is shuffled are distinct words of chunks and
compressed positions, never one row for each word of the corpus, so a frequent word costs one entry a chunk.

Cases: a null or empty text, or one of white space only, has no ids and decodes to an empty text; special tokens inside a text
are matched as the library does; repeated rows are encoded each; an empty table gives no rows.
"""

from __future__ import annotations

import json
import os
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from sladd.llm.common import bucketed, gather, kept, packed, parts, short_batches, tidy, unpacked

#: Bytes of text in a chunk; a longer document is a chunk of its own.
CHUNK_BYTES = 8 << 20
#: Words whose ids and texts are put in place at a time.
PLACED_WORDS = 1 << 17
#: Stands for a null id inside a chunk.
NO_ID = -(1 << 63)
CHUNK = "chunk string, bucket int, docs binary, counts binary, places binary, body binary"
IDS = "chunk string, bucket int, sizes binary, ids binary"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _record(rows, schema):
    names = [field.split()[0] for field in schema.split(", ")]
    kinds = [pa.string(), pa.int32(), *[pa.binary()] * (len(names) - 2)]
    return pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)


def _chunks(n_buckets, limit):
    """Chunk rows: bucket -1 holds documents, positions and the bucket of each distinct word; the others the words of one bucket."""

    def flush(keys, counts, places, number, index):
        words = list(index)
        places = np.concatenate(places) if places else np.zeros(0, np.int64)
        # frequent words get small numbers, equally frequent ones by name
        often = np.bincount(places, minlength=len(words))
        order = sorted(range(len(words)), key=words.__getitem__)
        order = np.array(order, np.int64)[np.argsort(-often[order], kind="stable")] if words else np.zeros(0, np.int64)
        rank = np.empty(len(words), np.int64)
        rank[order] = np.arange(len(words))
        bucket = np.fromiter((xxhash.xxh3_64_intdigest(words[i]) % n_buckets for i in order.tolist()), np.int64, len(words))
        by_bucket = np.argsort(bucket, kind="stable")
        name = f"{TaskContext.get().partitionId()}-{number}"
        doc_ids = np.array([NO_ID if k is None else k for k in keys], np.int64)
        yield _record([(name, -1, doc_ids.tobytes(), np.array(counts, np.int64).tobytes(), packed(rank[places]), packed(bucket))], CHUNK)
        cuts = np.searchsorted(bucket[by_bucket], np.arange(n_buckets + 1))
        squeeze = zstandard.ZstdCompressor(level=3).compress
        rows = []
        for k in np.flatnonzero(np.diff(cuts)).tolist():
            rows.append((name, k, None, None, None, squeeze(b"\n".join([words[i] for i in order[by_bucket[cuts[k] : cuts[k + 1]]].tolist()]))))
        yield _record(rows, CHUNK)

    def run(batches):
        keys, counts, places, index, size, number = [], [], [], {}, 0, 0
        for batch in batches:
            column = batch.column(1).cast(pa.large_binary())
            for k, key in enumerate(batch.column(0).to_pylist()):
                text = column[k].as_py() or b""
                if size and size + len(text) > limit:
                    yield from flush(keys, counts, places, number, index)
                    keys, counts, places, index, size, number = [], [], [], {}, 0, number + 1
                # only distinct words outlive their document
                found = text.split()
                for word in found:
                    if word not in index:
                        index[word] = len(index)
                places.append(np.fromiter(map(index.__getitem__, found), np.int32, len(found)))
                counts.append(len(found))
                keys.append(key)
                size += len(text) + 8
        if keys:
            yield from flush(keys, counts, places, number, index)

    return run


def _encode_bucket(model):
    """Encode the distinct words of a bucket once; each chunk gets the ids of its own words, in their order."""

    def load():
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(model)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        return tokenizer

    def run(rows: pa.Table) -> pa.Table:
        tokenizer = kept("tokenizer", model, load)
        expand, body = zstandard.ZstdDecompressor().decompress, rows.column("body")
        index: dict[bytes, int] = {}
        for asked in body:
            for word in expand(asked.as_py()).split(b"\n"):
                index.setdefault(word, len(index))
        distinct, flat, sizes = list(index), [], []
        for i in range(0, len(distinct), 4096):
            found = [e.ids for e in tokenizer.encode_batch_fast([w.decode() for w in distinct[i : i + 4096]], add_special_tokens=False)]
            flat.append(np.fromiter(chain.from_iterable(found), np.uint32))
            sizes.append(np.fromiter(map(len, found), np.int64, len(found)))
        del distinct
        ids, size = np.concatenate(flat), np.concatenate(sizes)
        first = np.cumsum(size) - size
        out = []
        for chunk, bucket, asked in zip(rows.column("chunk"), rows.column("bucket"), body):
            own = np.fromiter(map(index.__getitem__, expand(asked.as_py()).split(b"\n")), np.int64)
            out.append((chunk.as_py(), bucket.as_py(), packed(size[own]), packed(gather(ids, first[own], size[own]).astype(np.int64))))
        return pa.Table.from_batches([_record(out, IDS)])

    return run


def _place(pieces):
    """Put ids and pieces of a chunk's words in the places of its documents, by arrays of ids and offsets."""
    spelled = [p.encode() + b" " for p in pieces]
    blob = np.frombuffer(b"".join(spelled), np.uint8)
    width = np.array([len(p) for p in spelled], np.int64)
    begin = np.cumsum(width) - width
    del spelled, pieces

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                get = {name: batch.column(name)[row] for name in batch.schema.names}
                bucket = unpacked(get["body"].as_py())
                parts = sorted((p["bucket"].as_py(), k) for k, p in enumerate(get["parts"] if get["parts"].is_valid else []))
                parts = [get["parts"][k] for _, k in parts]
                sizes = [unpacked(p["sizes"].as_py()) for p in parts]
                # words are numbered by how frequent they are, and answered bucket by bucket
                of_word = np.argsort(bucket, kind="stable")
                if sum(map(len, sizes)) != len(of_word):
                    raise RuntimeError("a chunk has words without ids")
                size, first = np.zeros(len(of_word), np.int64), np.zeros(len(of_word), np.int64)
                if parts:
                    ids = np.concatenate([unpacked(p["ids"].as_py()).astype(np.uint32) for p in parts])
                    answered = np.concatenate(sizes)
                    size[of_word], first[of_word] = answered, np.cumsum(answered) - answered
                else:
                    ids = np.zeros(0, np.uint32)
                keys, places = np.frombuffer(get["docs"].as_py(), np.int64), unpacked(get["places"].as_py()).astype(np.int32)
                ends = np.cumsum(np.frombuffer(get["counts"].as_py(), np.int64))
                start = done = 0
                while start < len(keys):
                    # documents of at most so many words together, or one
                    stop = max(start + 1, int(np.searchsorted(ends, done + PLACED_WORDS, "right")))
                    own = places[done : ends[stop - 1]]
                    flat = gather(ids, first[own], size[own])
                    after = np.concatenate([[0], np.cumsum(size[own])])[ends[start:stop] - done]
                    text = gather(blob, begin[flat], width[flat])
                    reach = np.concatenate([[0], np.cumsum(width[flat])])[after]
                    some = keys[start:stop]
                    id_bounds, text_bounds = (np.concatenate([[0], x]).tolist() for x in (after, reach))
                    raw, text = flat.astype("<u4").tobytes(), text.tobytes()
                    encoded = [raw[4 * a : 4 * b] for a, b in zip(id_bounds, id_bounds[1:])]
                    decoded = [text[a : max(a, b - 1)] for a, b in zip(text_bounds, text_bounds[1:])]
                    yield pa.record_batch([pa.array(some, mask=some == NO_ID), pa.array(encoded, pa.binary()), pa.array(decoded, pa.binary()).cast(pa.string())],
                                          names=["key", "ids", "decoded"])
                    start, done = stop, int(ends[stop - 1])

    return run


def pieces_of(model: str) -> list[str]:
    """The id-to-piece table; its length is that of the vocabulary."""
    config = json.loads(model)
    table = dict(config["model"]["vocab"]) | {t["content"]: t["id"] for t in config["added_tokens"]}
    out = [""] * (max(table.values()) + 1)
    for piece, i in table.items():
        out[i] = piece
    return out


def encode_decode(docs: DataFrame, vocabulary: str | None = None, key: str = "doc_id", text: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``key, ids, decoded``: ids as little-endian unsigned 32-bit integers, and the text that they decode to."""
    with open(vocabulary or default_vocabulary(), encoding="utf-8") as file:
        model = file.read()
    if json.loads(model).get("decoder"):
        raise ValueError("pieces are joined by one space; a vocabulary with a decoder of its own isn't supported")
    spark = docs.sparkSession
    source = short_batches(docs).select(F.col(key).cast("long"), F.col(text))
    chunks = bucketed(source.mapInArrow(tidy(_chunks(parts(spark, 2), chunk_bytes)), CHUNK), "chunk")
    asked = chunks.filter("bucket >= 0").select("chunk", "bucket", "body")
    encoded = asked.groupBy("bucket").applyInArrow(_encode_bucket(model), IDS)
    answers = encoded.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "sizes", "ids")).alias("parts"))
    heads = chunks.filter("bucket < 0").select("chunk", "docs", "counts", "places", "body")
    out = heads.join(answers, "chunk", "left").mapInArrow(tidy(_place(pieces_of(model))), "key long, ids binary, decoded string")
    return out.withColumnRenamed("key", key)
