"""SimHash near-duplicates against all pairs."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tallyweave.llm import simhash
from tallyweave.llm.components import components


def plain_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    for white in "\t\n\v\f\r":
        words = words.replace(white, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def plain_components(points, linked):
    root = {p: p for p in points}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for i, a in enumerate(points):
        for b in points[i + 1 :]:
            if linked(a, b):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {p: find(p) for p in points}


def signed(value):
    return value - (1 << 64) if value >> 63 else value


@pytest.mark.parametrize("text", ["", " \n ", "a", "A b", "A b C d É É", "x y z " * 500, "ÀB c d\x1ce f"])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 4])
def test_every_pair_within_the_radius_shares_a_table(radius):
    draw = random.Random(radius)
    tables = simhash.masks(radius)
    for _ in range(500):
        bits = draw.sample(range(64), radius)
        assert any(all(not (m >> b) & 1 for b in bits) for m in tables)


@pytest.mark.parametrize("radius,bucket,crowd", [(1, 4, 4), (2, 32, 64), (2, 2, 2), (2, 2, 99), (3, 2, 2), (4, 3, 99)])
def test_links_connect_what_all_pairs_connect(spark, rows, radius, bucket, crowd):
    draw = random.Random(7)
    centres = [draw.getrandbits(64) for _ in range(6)]
    points = {0}
    for centre in centres:
        for _ in range(12):
            point = centre
            for bit in draw.sample([63, *range(23)], draw.randint(0, 4)):
                point ^= 1 << bit
            points.add(point)
    points |= {draw.getrandbits(64) for _ in range(40)}
    points = sorted(signed(p) for p in points)
    far = lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() <= radius
    expected = plain_components(points, far)
    found = simhash.links(spark.createDataFrame([(p,) for p in points], "fp long"), radius, bucket, crowd)
    pairs = [tuple(r) for r in found.collect()]
    assert all(a < b and (far(a, b) or crowd > bucket) for a, b in pairs)
    got = dict(rows(components(found)))
    assert {p: got.get(p, p) for p in points} == expected


def test_components_of_a_long_path_and_a_star(spark, rows):
    path = [(i, i + 1) for i in range(100, 160)]
    star = [(5, i) for i in range(1000, 1300)] + [(5, 5), (1000, 5)]
    got = dict(rows(components(spark.createDataFrame(path + star, "u long, v long"))))
    assert got == {i: 100 for i in range(100, 161)} | {i: 5 for i in [5, *range(1000, 1300)]}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_documents(spark, rows):
    base = " ".join(f"word{i}" for i in range(400))
    data = [
        (9, base), (4, base.upper()), (4, base), (7, None), (8, " \n"), (None, ""), (2, "quite another text here"),
        (None, "alone without an id"), (11, base.replace("word7 ", "wort7 ", 1)),
    ]
    frame = spark.createDataFrame(data, "doc_id long, text string").withColumn("fp", F.lit("clash"))
    result = rows(simhash.near_duplicates(frame), "doc_id", simhash.as_hex("fp").alias("f"), "component_id")
    texts = [plain_fingerprint(t or "") for _, t in data]
    groups = plain_components(list(range(len(data))), lambda a, b: (texts[a] ^ texts[b]).bit_count() <= 2)
    least = {}
    for i, (doc, _) in enumerate(data):
        known = [d for j, (d, _) in enumerate(data) if groups[j] == groups[i] and d is not None]
        least[i] = min(known) if known else None
    expected = [(d, f"{texts[i]:016x}", least[i]) for i, (d, _) in enumerate(data)]
    assert result == sorted(expected, key=lambda r: tuple((v is not None, v) for v in r))
    assert simhash.near_duplicates(frame.limit(0)).count() == 0
    kept = rows(simhash.one_of_each(frame), "doc_id", "text")
    assert {d for d, _ in kept} == {e[2] for e in expected} and len(kept) == len({e[2] for e in expected})
    assert simhash.one_of_each(frame.limit(0)).count() == 0


# ---- groups of similar texts


def edited(draw, words, edits):
    out = list(words)
    for _ in range(edits):
        at = draw.randrange(len(out))
        kind = draw.randrange(3)
        if kind == 0:
            out[at] = f"new{draw.randrange(10**6)}"
        elif kind == 1:
            out.insert(at, f"more{draw.randrange(10**6)}")
        elif len(out) > 1:
            del out[at]
    return out


def plain_groups(texts, similarity=0.8, width=5):
    """Least index of each text's group over all pairs, and the similar pairs."""
    sets = [simhash.shingles(t or "", width) for t in texts]
    root, pairs = list(range(len(texts))), set()

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if simhash.jaccard(sets[i], sets[j]) >= similarity:
                pairs.add((j, i))
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(texts))], pairs


def test_similar_texts_are_found_and_others_stay(spark):
    import random

    draw = random.Random(4)
    vocabulary = [f"w{i}" for i in range(900)]
    texts = []
    for _ in range(60):
        base = [draw.choice(vocabulary) for _ in range(draw.choice([90, 200, 400]))]
        texts.append(" ".join(base))
        for _ in range(draw.randint(0, 5)):
            texts.append(" ".join(edited(draw, base, max(1, int(len(base) * draw.choice([0.005, 0.015, 0.02, 0.06]))))))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r["doc_id"] for r in simhash.one_of_similar(frame).collect()}
    groups, pairs = plain_groups(texts)
    want = set(groups)
    assert want <= kept  # nothing goes that is not similar to another text
    assert len(pairs) > 60 and len(kept - want) <= 0.05 * (len(texts) - len(want))


def test_similar_texts_with_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(3000))
    data = [
        (5, None), (3, ""), (None, " \n"), (9, "one two"), (2, "One two"), (7, "two one"), (8, long), (1, long + " end"), (1, long + " end"),
        (None, "only here and without id"), (None, "only here and without id"), (4, "、 東京"),
    ]
    frame = spark.createDataFrame([(*r, "x", 1) for r in data], "doc_id long, text string, fp string, h1 int")
    kept = simhash.one_of_similar(frame).collect()
    assert sorted((r["doc_id"], r["text"]) for r in kept if r["doc_id"] is not None) == [(1, long + " end"), (2, "One two"), (3, ""), (4, "、 東京"), (7, "two one")]
    assert [r["text"] for r in kept if r["doc_id"] is None] == ["only here and without id"]
    assert all(r["fp"] == "x" and r["h1"] == 1 for r in kept)
    assert simhash.one_of_similar(frame.limit(0)).count() == 0


def test_links_of_crowds_are_pairs_within_the_radius(spark):
    draw = np.random.default_rng(3)
    base = int(draw.integers(1 << 62))
    fps = {base ^ sum(1 << int(b) for b in draw.choice(63, draw.integers(0, 7), replace=False)) for _ in range(400)}
    frame = spark.createDataFrame([(f,) for f in fps], "fp long")
    pairs = {(r["u"], r["v"]) for r in simhash.links(frame, 4, bucket=8, near_only=True).collect()}
    assert pairs and all((u ^ v).bit_count() <= 4 for u, v in pairs)
    near = {f for f in fps if any((f ^ g).bit_count() <= 4 for g in fps if g != f)}
    assert {x for p in pairs for x in p} == near


def test_crowds_link_what_all_pairs_within_the_radius_link(spark):
    """Texts of one bucket, similar to neither the least nor the nearest of it but to a third one."""
    base = [f"w{i}" for i in range(400)]
    texts = [" ".join(base[k:] + base[:k]) for k in (0, 57, 114, 171, 228, 285)]  # one set of words, so one fingerprint
    shuffled = [" ".join(base[(i * step) % 400] for i in range(400)) for step in (3, 7, 9, 11, 13, 17)]
    late = [s + " tail end" for s in shuffled]
    frame = spark.createDataFrame(list(enumerate(texts[:2] + shuffled + late)), "doc_id long, text string")
    groups, _ = plain_groups(texts[:2] + shuffled + late)
    assert len(set(groups)) == 7
    assert {r["doc_id"] for r in simhash.one_of_similar(frame).collect()} == set(groups)


def test_pairs_apart_are_all_pairs_of_different_groups(spark):
    draw = np.random.default_rng(5)
    base = int(draw.integers(1 << 62))
    fps = sorted({base ^ sum(1 << int(b) for b in draw.choice(63, draw.integers(0, 5), replace=False)) for _ in range(40)})
    data = [(f, int(i % 3), int(i % 3 + (i % 7 == 0))) for i, f in enumerate(fps)]
    frame = spark.createDataFrame(data, "fp long, low long, high long")
    want = {
        (a[0], b[0])
        for i, a in enumerate(data)
        for b in data[i + 1 :]
        if (a[0] ^ b[0]).bit_count() <= 4 and min(a[1], b[1]) < max(a[2], b[2])
    }
    for bucket, crowd in ((200, 300), (2, 300), (2, 2)):
        found = [(r["u"], r["v"]) for r in simhash.links_apart(frame, 4, bucket, crowd).collect()]
        assert want and len(found) == len(set(found)) and set(found) == want


def test_links_of_several_seeds_are_those_of_each(spark):
    """One pass serves all seeds, in buckets of every size, and no link joins fingerprints of two seeds."""
    draw = np.random.default_rng(6)
    base = int(draw.integers(1 << 62))
    by_seed = [sorted({base ^ sum(1 << int(b) for b in draw.choice(63, draw.integers(0, 5), replace=False)) for _ in range(40)}) for _ in range(2)]
    data = [(seed, f, i % 3, i % 3 + (i % 7 == 0)) for seed, fps in enumerate(by_seed) for i, f in enumerate(fps)]
    frame = spark.createDataFrame(data, "seed int, fp long, low long, high long")
    for bucket, crowd in ((200, 300), (2, 300), (2, 2)):
        for find, chosen in ((lambda d: simhash.links(d, 4, bucket, crowd), ["fp"]), (lambda d: simhash.links_apart(d, 4, bucket, crowd), ["fp", "low", "high"])):  # noqa: B023
            found = {tuple(r) for r in find(frame.select("seed", *chosen)).select("seed", "u", "v").collect()}
            alone = [find(frame.where(f"seed = {n}").select(*chosen)).collect() for n in (0, 1)]
            assert found and found == {(n, r["u"], r["v"]) for n in (0, 1) for r in alone[n]}


def test_crowds_that_stay_apart_are_not_compared_in_all_pairs(spark, monkeypatch):
    """Orders of one set of words have one fingerprint; their pairs were all compared, 9,870 here, to link what 21 link."""
    draw, base = random.Random(8), [f"w{i}" for i in range(120)]
    texts = [" ".join(draw.sample(base, len(base))) for _ in range(120)]
    texts += [" ".join(t.split()[1:] + t.split()[:1]) for t in texts[60:80]]  # similar to neither the least nor the nearest
    texts.append(" ".join(texts[3].split()[k % 120] for k in range(2, 122)))
    counts, plain = {}, simhash.stage

    def counted(df, label, *more):
        out = plain(df, label, *more)
        counts[label] = counts.get(label, 0) + out.count()
        return out

    monkeypatch.setattr(simhash, "stage", counted)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    groups, pairs = plain_groups(texts)
    assert {r["doc_id"] for r in simhash.one_of_similar(frame).collect()} == set(groups)
    assert len(pairs) == 21 and counts["similar-remaining"] <= 2 * len(pairs)


@pytest.mark.parametrize("similarity,width", [(0.8, 5), (0.5, 1), (1.0, 2)])
def test_prefixes_leave_out_no_similar_pair(spark, similarity, width):
    draw, texts = random.Random(9), ["", "a", "b"]
    for _ in range(12):
        base = [draw.choice("abcdefghijklmnop") + str(draw.randrange(8)) for _ in range(draw.choice([3, 9, 40, 60]))]
        texts += [" ".join(edited(draw, base, k)) for k in (0, 1, 1, 2, 4, 8)] + [" ".join(base[: -len(base) // 6])]
    texts += texts[::3]
    fps = [int(np.int64(draw.getrandbits(1))) for _ in texts]
    data = [(i, i % 5, [fps[i], 7 * i], t) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(data, "tid long, of long, fps array<long>, text string")
    found = {(r["u"], r["v"]) for r in simhash.prefix_pairs(frame, similarity, width, 1, 0).collect()}
    sets = [simhash.shingles(t, width) or {b""} for t in texts]
    apart = {(i, j) for j in range(len(texts)) for i in range(j) if i % 5 != j % 5 and fps[i] == fps[j]}
    similar = {p for p in apart if simhash.jaccard(sets[p[0]], sets[p[1]]) >= similarity}
    assert similar and similar <= found <= apart and len(found) < len(apart) / 2
