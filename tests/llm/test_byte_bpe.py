"""Encoding against the tiktoken library, decoding as an exact round trip."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest

from tallyweave.llm import byte_bpe

tiktoken = pytest.importorskip("tiktoken")
PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
ALPHABET = "ab Zé\n\t   'st1 9,.\x1c\x85　漢🙂"


@pytest.fixture(scope="module")
def vocabulary():
    return byte_bpe.Vocabulary.read(PATH, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library(vocabulary):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})


def texts():
    draw = random.Random(1)
    fixed = ["", " ", "  ", "a  b", "a\n b", "  x", "don't  we'll\t\tgo \n\n x ", "z" * 700, "ab" * 900, " " * 90, "<|endoftext|>"]
    return fixed + ["".join(draw.choices(ALPHABET, k=draw.randint(1, 60))) for _ in range(1500)]


@pytest.mark.parametrize("remembered", [byte_bpe.REMEMBERED, 40])
def test_ids_are_the_librarys(vocabulary, library, remembered):
    encoder, decoder = byte_bpe.Encoder(vocabulary, remembered), byte_bpe.Decoder(vocabulary)
    for text, raw in zip(texts(), encoder.batch(texts()), strict=True):
        ids = np.frombuffer(raw, "<u4")
        assert ids.tolist() == library.encode_ordinary(text), repr(text)
        assert decoder(ids) == text.encode()


def test_both_trees_agree(vocabulary):
    draw = random.Random(2)
    pieces = ["".join(draw.choices("abcdeé ", k=draw.randint(2, 200))).encode() for _ in range(200)]
    pieces = [p for p in pieces if 1 < len(p) <= byte_bpe.SIDE_BY_SIDE]
    ids, counts = byte_bpe.merge_side_by_side(pieces, vocabulary)
    at = 0
    for piece, n in zip(pieces, counts, strict=True):
        assert ids[at : at + n].tolist() == byte_bpe.merge_alone(piece, vocabulary)
        at += n


def test_tables(spark, rows, library):
    data = [(1, "The cat's  hat"), (1, "The cat's  hat"), (None, "x"), (3, None), (4, ""), (5, "y" * 100_000)]
    frame = spark.createDataFrame([(*r, 7) for r in data], "doc_id long, text string, n_tokens int")

    def expected(doc, text):
        ids = library.encode_ordinary(text or "")
        raw = np.array(ids, "<u4").tobytes()
        return doc, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()

    order = lambda r: tuple((v is not None, v) for v in r)
    assert rows(byte_bpe.round_trip(frame, PATH, public_tokenizers.PATTERN)) == sorted((expected(*r) for r in data), key=order)
    encoded = byte_bpe.encode(frame, PATH, public_tokenizers.PATTERN)
    decoded = byte_bpe.decode(encoded, PATH, public_tokenizers.PATTERN)
    assert sorted(bytes(r["bytes"]).decode() for r in decoded.collect()) == sorted(t or "" for _, t in data)
    assert byte_bpe.round_trip(frame.limit(0), PATH, public_tokenizers.PATTERN).count() == 0
    with pytest.raises(Exception, match="no token"):
        byte_bpe.decode(spark.createDataFrame([(1, [10**6 + 1])], "doc_id long, ids array<int>"), PATH, public_tokenizers.PATTERN).collect()
