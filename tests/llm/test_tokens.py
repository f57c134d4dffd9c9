import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kelpie.llm import spans, token_files, tokens, tree_bpe

BYTE, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = ["", " ", "  \n\n x", "don't'll  we'RE", "Straße ÀÉ ŉ Ǆ İstanbul", "éä", "日本語 text 😀", "<|endoftext|> x", "a\x1cb\x85c\xa0d\xade", "x" * 3000, "½²ª 12 345"]


@given(st.lists(st.text(max_size=60) | st.text("abcde 'sST\n\t12éÀß.,", max_size=80), max_size=8))
@settings(max_examples=150, deadline=None)
def test_memo_is_the_library(texts):
    texts += ODD
    for path, spaced in ((BYTE, True), (WORDS, False)):
        enc = tokens.encoder(path, spaced)
        want = [e.ids for e in enc.tok.encode_batch(texts, add_special_tokens=False)]
        assert [x.tolist() for x in enc.ids(texts)] == want


def test_unlike_words_of_one_hash(monkeypatch):
    """Their ids are their own: the memo compares bytes."""
    a, b = "ab", "ba"
    for _ in range(9):
        a, b = a + b, b + a  # of one value under any polynomial modulo 2^64 with an odd base
    texts = [f"x {a} y", f"{b} z", a, b, "plain words"]
    for weak in (False, True):
        if weak:
            monkeypatch.setattr(spans, "block_hashes", lambda values, first, sizes: np.asarray(sizes % 3, np.uint64))
        for path, spaced in ((BYTE, True), (WORDS, False)):
            enc = tokens.Encoder(path, spaced)
            want = [e.ids for e in enc.tok.encode_batch(texts, add_special_tokens=False)]
            for part in (texts, texts[::-1]):
                got = [x.tolist() for x in enc.ids(part)]
                assert got == (want if part is texts else want[::-1])


@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=50))
def test_pack_round_trip(ranks):
    r = np.asarray(ranks, "<u4")
    assert token_files.unpack(*token_files.pack(r), len(r)).tolist() == ranks


def _long_texts():
    rng = random.Random(3)
    syllables = ["th", "er", "in", "xq", "é", "ß", "1", "'s", ".", "😀", "é", "A", "İ"]
    yield "a" * 997
    yield "".join(rng.choice(syllables) for _ in range(3000))
    yield " ".join("".join(rng.choice(syllables) for _ in range(rng.randrange(1, 40))) for _ in range(300))
    yield "ab" * 700 + " " * 500 + "c'll'" * 90


@pytest.mark.parametrize("leaf", [7, 64, 301])
@pytest.mark.parametrize("edge", [5, 40, 1024])
def test_tree_is_the_library(leaf, edge):
    tok = tokens.load(WORDS)
    for text in _long_texts():
        k = tree_bpe.cuts(len(text), leaf)
        at = [i * len(text) // k for i in range(k + 1)]
        pieces = [text[a:z] for a, z in zip(at, at[1:])]
        ids = tokens.encoder(WORDS, False).ids(pieces)
        got = tree_bpe.join_tree(tok, pieces, [(i, *tree_bpe.edges(tok, p, i, edge)) for p, i in zip(pieces, ids)])
        assert got.tolist() == tok.encode(text, add_special_tokens=False).ids


ROWS = [((1 << 60) + 1, "a large id"), (3, "Hello there friend " * 30), (None, "null id"), (1, None), (1, ""), (2, "dup"), (2, "dup"), (9, "z" * 5000 + " tail"), (4, "don't <|endoftext|> stop")]


def test_tree_query(spark):
    docs = spark.createDataFrame([(*r, "x") for r in ROWS], "doc_id long, text string, ids string")
    tok = tokens.load(WORDS)
    want = []
    for i, t in ROWS:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want.append((i, len(ids), sha(" ".join(map(str, ids))), sha(tok.decode(ids, skip_special_tokens=False))))
    for leaf in (50, 10_000):
        got = [tuple(r) for r in tree_bpe.encode_and_decode(docs, WORDS, leaf=leaf).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
    assert tree_bpe.encode_and_decode(docs.limit(0), WORDS).count() == 0


def test_token_files(spark):
    docs = spark.createDataFrame([(*r, 1) for r in ROWS], "doc_id long, text string, start int")
    folder, manifest = token_files.write(docs, BYTE, block_tokens=100)
    got = sorted(map(tuple, token_files.read(spark, folder, manifest).collect()), key=lambda r: r[1])
    tok = tokens.load(BYTE)
    assert [r[0] for r in got] == [None, 1, 1, 2, 2, 3, 4, 9, (1 << 60) + 1]
    ids = {(i, t): [*tok.encode(t or "", add_special_tokens=False).ids, 0] for i, t in ROWS}
    crc = lambda x: zlib.crc32(np.asarray(x, "<u4").tobytes())
    assert sorted((str(i), len(ids[i, t]), crc(ids[i, t])) for i, t in ROWS) == sorted((str(r[0]), r[2], r[3]) for r in got)
    assert [r[1] for r in got] == np.cumsum([0, *[r[2] for r in got]])[:-1].tolist()
    folder, manifest = token_files.write(docs.limit(0), BYTE)
    assert manifest.count() == token_files.read(spark, folder, manifest).count() == 0
