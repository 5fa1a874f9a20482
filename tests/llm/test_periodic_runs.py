"""Runs, their digests and the collapsed text against plain loops."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyweave.llm import periodic_runs as pr

COLUMNS = ("doc_id", "n_runs", "start", "length", "period", "runs_sha256", "collapsed_sha256")


def plain_runs(words):
    n, found = len(words), {}
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            if words[i] != words[i + p]:
                i += 1
                continue
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j + p - i >= max(12, 2 * p):
                found.setdefault((i, j + p), p)
            i = j + 1
    return sorted(((s, e - s, p) for (s, e), p in found.items()), key=lambda r: (r[0], r[2]))


def plain(doc_id, text, loop):
    words = []
    for line in (text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" "):
        if line:
            words.append(line)
    n = len(words)
    if loop and n and doc_id is not None and zlib.crc32(str(doc_id).encode()) % 10 == 0:
        g = zlib.crc32(str(doc_id).encode()) // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words)
    stay = [not any(s + q <= i < s + length for s, length, q in runs) for i in range(n)]
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    listed = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    return doc_id, len(runs), *best, sha(listed), sha(" ".join(w for w, k in zip(words, stay, strict=True) if k))


def made(draw):
    out = []
    for _ in range(draw.randint(1, 12)):
        n, k = draw.choice([0, 1, 11, 12, 13, 30, 90, 250]), draw.choice([1, 2, 3, 60])
        words = [draw.randrange(k) for _ in range(n)]
        if n and draw.random() < 0.6:
            a = draw.randrange(n)
            p = 1 + (n - a) // draw.randint(2, 9)
            words = words[:a] + [words[a + i % p] for i in range(n - a)]
            if draw.random() < 0.4:
                words[draw.randrange(n)] = 99
        out.append(words)
    return out


@pytest.mark.parametrize("seed", range(60))
def test_runs_equal_plain_loops(seed):
    texts = made(random.Random(seed))
    found = pr.runs_of([np.array(t, np.int64) for t in texts])
    assert [[tuple(r) for r in f.tolist()] for f in found] == [plain_runs(t) for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=70), max_size=4))
def test_runs_of_small_alphabets(texts):
    found = pr.runs_of([np.array(t, np.int64) for t in texts])
    assert [[tuple(r) for r in f.tolist()] for f in found] == [plain_runs(t) for t in texts]


def test_extensions_equal_comparing():
    draw = random.Random(3)
    words = [draw.randrange(2) for _ in range(40)] * 9 + [5] * 60
    array = np.array(words + list(range(100, 100 + pr.COVER_PERIOD)), np.int64)
    ext = pr.Extensions(array)
    i = np.array([draw.randrange(len(words)) for _ in range(400)])
    j = np.array([draw.randrange(len(words)) for _ in range(400)])
    i, j = i[i != j], j[i != j]
    got, more = ext.few(i, j)
    shift = pr.SHIFTS[i % pr.COVER_PERIOD, j % pr.COVER_PERIOD]
    got[more] += ext.rest(i[more] + shift[more], j[more] + shift[more])
    for a, b, n in zip(i.tolist(), j.tolist(), got.tolist(), strict=True):
        want = 0
        while max(a, b) + want < len(array) and array[a + want] == array[b + want]:
            want += 1
        assert n == want


def test_the_cover_holds_every_difference():
    v = pr.COVER_PERIOD
    assert {(a - b) % v for a in pr.COVER for b in pr.COVER} == set(range(v))


TEXTS = [
    None, "", " \n\t ", "one", "ab " * 6, "ab " * 12, "a b " * 40, "x y " * 13, "　 " * 12, "a\tb\nc\x0bd\x0ce\rf " * 5,
    "w " + "to be or not " * 9 + "end " + "na " * 20, "a b c d e f g h i j k l " * 2, "東京 大阪 " * 8,
]


@pytest.mark.parametrize("loop", [False, True])
def test_odd_rows(spark, rows, loop):
    data = [(i if i != 3 else None, t, "x", 7) for i, t in enumerate(TEXTS + TEXTS)] + [(1, "a b " * 9, "x", 7)] * 2
    data += [(1000 + i, " ".join(f"w{(i * k) % 17}" for k in range(60)), "x", 7) for i in range(60)]
    frame = spark.createDataFrame(data, "doc_id long, text string, runs string, start int")
    found = pr.scanned(frame, pr.looped if loop else pr.as_they_are)
    want = sorted((plain(d, t, loop) for d, t, *_ in data), key=lambda r: tuple((v is not None, v) for v in r))
    assert rows(found, *COLUMNS) == want
    assert pr.scanned(frame.limit(0)).count() == 0


def test_a_very_long_text(spark, rows):
    words = [f"w{i % 997}" for i in range(60_000)]
    text = " ".join(words + ["stop"] + words[:5000] + ["la"] * 3000)
    found = pr.scanned(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    assert [(r["start"], r["length"], r["period"]) for r in found.collect()[0]["runs"]] == [(0, 60_000, 997), (60_001, 5000, 997), (65_001, 3000, 1)]


def test_the_query_on_its_table(spark, folder, rows):
    from tallyweave.llm import queries
    from tallyweave.llm.common import table

    data = [tuple(r) for r in table(spark, folder, "documents").select("doc_id", "text").collect()]
    found = queries.op12_periodic_runs(spark, folder)
    assert rows(found, *COLUMNS) == sorted((plain(d, t, True) for d, t in data), key=lambda r: tuple((v is not None, v) for v in r))
    assert found.where("n_runs > 0").count() > 0
    assert found.where("exponent_milli is distinct from floor(1000 * length / period)").count() == 0
