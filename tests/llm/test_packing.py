"""Packing: ids against the tokenizers library, and every limit and place by hand."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from tallyweave.llm import packing
from tallyweave.llm.queries import word_bpe

tokenizers = pytest.importorskip("tokenizers")
ALPHABET = "abZÉ\n\t   'st1 9,.\x1c\x85　漢🙂́ΣİKſßÀĂẞ"


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def test_ids_are_the_librarys(library):
    draw = random.Random(1)
    texts = ["", " ", "  ", "A, b. C", "Ünï. É, ẞ. İ. ΑΣ. Ok,", ", . ,. a,, ..", "ǅ ŉ ſ ß ª º µ"]
    texts += [" ".join("x" + chr(c) + "," for c in range(0x80, 0x260))]
    texts += ["".join(draw.choices(ALPHABET, k=draw.randint(1, 60))) for _ in range(2000)]
    for text, ids in zip(texts, packing.WordIds(word_bpe()).batch(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_place_respects_every_limit():
    draw = np.random.default_rng(1)
    shares = np.column_stack([draw.random(300), np.full(300, 1 / 7), draw.random(300) * 0.9])
    bins = packing.place(shares)
    assert sorted(i for b in bins for i in b) == list(range(300))
    assert all((shares[b].sum(axis=0) <= 1 + 1e-9).all() for b in bins)
    assert packing.place(np.zeros((0, 3))) == []


def check(found, limits):
    by_sequence = {}
    for row in found:
        by_sequence.setdefault(row["sequence_id"], []).append(row)
    for pieces in by_sequence.values():
        pieces.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in pieces] == [sum(p["length"] for p in pieces[:i]) for i in range(len(pieces))]
        assert sum(r["length"] for r in pieces) <= limits.tokens
        assert len(pieces) <= limits.segments
        assert sum(r["loss_tokens"] for r in pieces) <= limits.loss
    return by_sequence


@pytest.mark.parametrize("shard", [7, 4096])
def test_documents(spark, library, shard):
    limits = packing.Limits(tokens=64, segments=5, loss=63)
    draw = random.Random(3)
    data = [(i, " ".join(draw.choices(["alpha", "Beta,", "x1", "émile."], k=draw.randint(0, 90))), None) for i in range(60)]
    data += [(None, "same words", 1), (None, "same words", 2), (7, None, 3), (8, "", 4), (9, "long " * 3000, 5)]
    frame = spark.createDataFrame(data, "doc_id long, text string, sequence_id int")
    cut = packing.pieces(frame, word_bpe(), ["doc_id"], 2, limits)
    found = packing.pack(cut, limits, shard).collect()
    check(found, limits)
    wanted = []
    for doc, text, _ in data:
        ids = library.encode(text or "", add_special_tokens=False).ids + [2]
        for at in range(0, len(ids), 64):
            piece = ids[at : at + 64]
            wanted.append((doc is not None, doc or 0, at, len(piece), zlib.crc32(np.array(piece, "<u4").tobytes()), len(ids)))
    got = [(r["doc_id"] is not None, r["doc_id"] or 0, r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in found]
    assert sorted(got) == sorted(wanted)
    empty = packing.pack(packing.pieces(frame.limit(0), word_bpe(), ["doc_id"], 2, limits), limits)
    assert empty.count() == 0 and empty.columns == packing.pack(cut, limits).columns


def test_instruction_turns_bear_loss_by_role(spark):
    from pyspark.sql import functions as F

    limits = packing.Limits(tokens=50, segments=4, loss=10)
    turns = [(c, t, "assistant" if t % 2 else None if t % 3 else "user", "word " * (t + 2)) for c in range(20) for t in range(6)]
    frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    cut = packing.pieces(frame, word_bpe(), ["conv_id", "turn", "role"], 2, limits, F.col("role") == "assistant")
    found = packing.pack(cut, limits).collect()
    check(found, limits)
    assert len(found) == len(turns)
    assert all(r["loss_tokens"] == (r["length"] - 1 if r["role"] == "assistant" else 0) for r in found)
    with pytest.raises(Exception, match="larger than a sequence"):
        packing.pack(cut, packing.Limits(tokens=50, segments=4, loss=3)).collect()


def test_words_with_signs_and_line_ends_are_remembered_by_word(library):
    encoder = packing.WordIds(word_bpe())
    whole = []
    encode, encoder.encode = encoder.encode, lambda group, **more: whole.extend(group) or encode(group, **more)
    text = "Alpha*** alpha\nbeta%%% (beta) ément;\n\nalpha!? gamma_ don't a1"
    (ids,) = encoder.batch([text])
    assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    assert sorted(whole) == ["", "(beta)", "a1", "don't"]
