"""The trie of conversations against plain dictionaries."""

import hashlib
import random
import zlib

import pytest

from tallyweave.llm import prefix_trie as pt

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def rebuilt(data, share=True):
    own = {}
    for conv, turn, role, text in data:
        if conv is not None:
            own.setdefault(conv, []).append(((turn is not None, turn), role or "", text or ""))
    plain = {c: [t[1:] for t in sorted(rows, key=lambda t: (t[0][0], t[0][1] or 0, t[1], t[2]))] for c, rows in own.items()}
    if not share:
        return plain
    out = {}
    for c, rows in plain.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = plain.get(c - c % 100, [])[:h] + rows[h:]
    return out


def plain_trie(conversations):
    members, ends = {}, {}
    for c, rows in conversations.items():
        for d in range(len(rows) + 1):
            members.setdefault(tuple(rows[:d]), []).append(c)
        ends.setdefault(tuple(rows), []).append(c)
    nodes = sorted(members, key=len, reverse=True)
    children, leaves, saved = dict.fromkeys(nodes, 0), dict.fromkeys(nodes, 0), dict.fromkeys(nodes, 0)
    for n in nodes:
        leaves[n] += not children[n]
        saved[n] += (len(members[n]) - 1) * (len(n[-1][1]) if n else 0)
        if n:
            children[n[:-1]] += 1
            leaves[n[:-1]] += leaves[n]
            saved[n[:-1]] += saved[n]
    digest = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return sorted(
        (
            (min(members[n]), len(n), min(members[n[:-1]]) if n else None, len(members[n]), children[n], leaves[n], saved[n], digest(ends.get(n, [])))
            for n in nodes
        ),
        key=lambda r: tuple((v is not None, v) for v in r),
    )


def made(seed, n):
    draw = random.Random(seed)
    return [
        (c, t, draw.choice(["user", "system"]), draw.choice(["a", "bé", "ccc\n", "東京"]))
        for c in draw.sample(range(3 * n), n)
        for t in range(draw.choice([1, 2, 3, 5, 8, 21]))
    ]


@pytest.mark.parametrize("shards", [1, 2, 7, 40])
def test_equals_dictionaries(spark, rows, shards):
    data = made(shards, 150)
    frame = spark.createDataFrame(data, SCHEMA)
    assert rows(pt.trie(pt.turns(frame), shards), *COLUMNS) == plain_trie(rebuilt(data, False))
    assert rows(pt.trie(pt.branched(pt.turns(frame)), shards), *COLUMNS) == plain_trie(rebuilt(data))


def test_one_group_of_copies_holds_a_third(spark, rows):
    data = [(c, t, "user", f"x{t}") for c in range(9000) if c % 3 == 0 for t in range(3)]
    data += [(c, t, "user", f"{'x' if t == 0 else 'y'}{c % 50 if t else 0}") for c in range(9000) if c % 3 and c < 1200 for t in range(4)]
    frame = spark.createDataFrame(data, SCHEMA)
    assert rows(pt.trie(pt.turns(frame), 8), *COLUMNS) == plain_trie(rebuilt(data, False))


def test_paths_longer_than_splitters(spark, rows):
    data = [(c, t, "user", "same" if t < 25 else f"{c % 9}") for c in range(60) for t in range(22 + c % 8)]
    frame = spark.createDataFrame(data, SCHEMA)
    assert rows(pt.trie(pt.turns(frame), 10), *COLUMNS) == plain_trie(rebuilt(data, False))


def test_odd_rows(spark, rows):
    data = [
        (1, None, None, None), (1, None, "user", "b"), (1, None, "user", "a"), (1, 3, "", ""), (1, 3, "", ""), (2, 1, "user", "x" * 100_000),
        (None, 1, "user", "gone"), (200, 0, "user", "base"), (201, 0, None, "own"), (205, 5, "user", None), (7, 0, "us", "era"), (8, 0, "use", "ra"),
    ]
    frame = spark.createDataFrame([(*r, "x", 1) for r in data], SCHEMA + ", path string, n long")
    assert rows(pt.trie(pt.branched(pt.turns(frame))), *COLUMNS) == plain_trie(rebuilt(data))
    assert pt.trie(pt.turns(frame.limit(0))).count() == 0


def test_skeleton_lengths_and_children():
    a, b, c = ("a" * pt.TOKEN, "b" * pt.TOKEN, "c" * pt.TOKEN)
    found = pt.skeleton([(a + b, [3, 5]), (a + c, [3, 7]), (b, [2])])
    assert found.children == {"": 2, a: 2, a + b: 0, a + c: 0, b: 0}
    assert found.lengths == {"": 17, a: 15, a + b: 5, a + c: 7, b: 2}
    assert found.splitters == [a + b, a + c, b]


def test_the_query_on_its_table(spark, folder, rows):
    from tallyweave.llm import queries
    from tallyweave.llm.common import table

    data = [tuple(r) for r in table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert rows(queries.op11_prefix_trie(spark, folder), *COLUMNS) == plain_trie(rebuilt(data))
