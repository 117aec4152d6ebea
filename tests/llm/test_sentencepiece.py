"""SentencePiece encoding against the library, and merge rounds against one merge at a time."""

import random

import numpy as np
import pytest
import sentencepiece

from sladd.llm import sentencepiece_bpe as S


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=S.default_vocabulary())


@pytest.fixture(scope="module")
def vocabulary():
    return S.Vocabulary.load(S.default_vocabulary())


def texts():
    rng = random.Random(0)
    parts = ["a", "b", "e", "r", "t", " ", "  ", "\n", "é", "漢", "🙂", "▁", "the", "ing", "ation", "0", "1", ".", ",", "<s>", "\t", "=", "ß", "π", "\x00"]
    yield from ["", " ", "▁", "  a", "Hello  world\n x ▁ é漢", " " * 37, "a" * 5001, "<s>x</s><unk><0x0A>", "　\xa0 ", " " * 5000 + "x" + " " * 3001]
    yield from ("".join(rng.choices(parts, k=rng.randint(0, 150))) for _ in range(400))
    yield "".join(rng.choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJ0123456789+/", k=50_000))
    yield " ".join(rng.choices(["foo", "Bar", "baz,"], k=20_000))


def test_equal_to_library(library, vocabulary):
    some = list(texts())
    for limit in (S.GROUP_BYTES, 500):
        for text, ids, want in zip(some, S.encode_texts(some, vocabulary, limit), library.encode(some, add_bos=True, add_eos=True)):
            assert ids.tolist() == want, text[:80]
            assert S.decode_ids(ids, vocabulary) == library.decode(want), text[:80]


def test_decoding_any_ids(library, vocabulary):
    rng = random.Random(1)
    for _ in range(1000):
        ids = [rng.choice([0, 1, 2, 35, 230, 191, 259, 300, 500, 13, 3 + 0xE6, 3 + 0xBC, 3 + 0x41]) for _ in range(rng.randint(0, 12))]
        assert S.decode_ids(np.array(ids, int), vocabulary) == library.decode(ids)


def one_at_a_time(word, vocabulary):
    symbols = [int(vocabulary.symbol_of[ord(c)]) for c in word]
    while True:
        pairs = [(vocabulary.pair_of[a * vocabulary.width + b], i) for i, (a, b) in enumerate(zip(symbols, symbols[1:])) if a * vocabulary.width + b in vocabulary.pair_of]
        if not pairs:
            return symbols
        (_, merged), i = min(pairs, key=lambda p: (p[0][0], p[1]))
        symbols[i : i + 2] = [merged]


@pytest.mark.parametrize("seed", range(6))
def test_random_vocabularies(seed):
    """Scores in any order, also equal ones, so that a new piece may take part in a better pair."""
    rng = random.Random(seed)
    pieces = [("<unk>", 0.0, S.UNKNOWN), ("<s>", 0.0, S.CONTROL), ("</s>", 0.0, S.CONTROL), *[(f"<0x{b:02X}>", 0.0, S.BYTE) for b in range(256)]]
    made = {"".join(rng.choices("abc", k=rng.randint(2, 6))) for _ in range(40)} | {"aa", "aaa", "ab", "abab"}
    pieces += [(p, -float(rng.randint(1, 12)), S.NORMAL) for p in sorted(made)] + [(c, -100.0, S.NORMAL) for c in "ab"]
    v = S.Vocabulary.of(pieces, 1, 2)
    words = list({"".join(rng.choices("abcd", k=rng.randint(1, 30))) for _ in range(300)} | {"a" * 25, "ab" * 12})
    want = [[x for s in one_at_a_time(w, v) for x in ([s] if s < v.size else v.byte_ids[list(chr(s - v.size).encode())].tolist())] for w in words]
    ids, first = S.encode_words(words, v)
    assert [ids[a:b].tolist() for a, b in zip(first, first[1:])] == want
    assert [S.merge_queue(v.symbol_of[[ord(c) for c in w]].tolist(), v) for w in words] == [one_at_a_time(w, v) for w in words]


def test_rows(spark, library):
    rows = [(1, None), (2, ""), (None, "Hello"), (3, "Hello"), (3, "Hello"), (4, "long text " * 30_000)]
    docs = spark.createDataFrame([(k, t, "x", b"y") for k, t in rows], "doc_id long, text string, key string, ids binary")
    out = S.encode(docs, decoded=True)
    want = [(k, np.array(library.encode(t or "", add_bos=True, add_eos=True), "<u4").tobytes(), t or "") for k, t in rows]
    assert sorted(((r.doc_id, bytes(r.ids), r.decoded) for r in out.collect()), key=repr) == sorted(want, key=repr)
    assert sorted((r.text for r in S.decode(out).collect())) == sorted(t or "" for _, t in rows)
    assert S.encode(docs.limit(0)).count() == 0
    assert S.decode(spark.createDataFrame([(1, None)], "doc_id long, ids binary")).first().text == ""
