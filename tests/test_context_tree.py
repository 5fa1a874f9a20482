"""The variable-order model against plain dictionaries."""

import math
import random

import pytest

from tallyweave.operators import context_tree as CT

EVENT = "purchase_event_id"
STEPS = f"{EVENT} long, event_number int, session_id long, features array<string>, positions array<int>"


@pytest.fixture
def vocabulary(spark):
    return spark.createDataFrame([("a", 9, 0), ("b", 5, 1), ("c", 5, 2), ("", None, 3)], "feature string, n long, position int")


def steps_of(spark, sessions):
    rows = [(e, i + 1, 10 * e + i, sorted(f), []) for e, steps in sessions.items() for i, f in enumerate(steps)]
    return spark.createDataFrame(rows, STEPS)


def test_symbols_and_contexts(spark, rows, vocabulary):
    steps = steps_of(spark, {1: [{"a"}, {"a", "c", "b"}, set()], 2: [{"c"}]})
    named = CT.symbols(steps, vocabulary)
    assert rows(named) == [(1, 0, ""), (1, 1, "b"), (1, 2, "a"), (2, 0, "c")]
    b = CT.BETWEEN
    assert rows(CT.contexts(named)) == [(1, ["", b + "b", b + "b" + b + "a"]), (2, ["c"])]
    assert rows(CT.contexts(named, 1)) == [(1, [""]), (2, ["c"])]


def made(seed, n):
    draw = random.Random(seed)
    sessions = {e: [{draw.choice("abc")} for _ in range(draw.randint(1, 5))] for e in range(n)}
    labels = [(e, "x" if steps[-1] == {"a"} else draw.choice("xyz")) for e, steps in sessions.items()]
    return sessions, labels


def plain(sessions, labels, fresh, depth=3, strength=5.0):
    last = lambda steps, d: tuple(min(s) for s in steps[::-1][:d]) if len(steps) >= d else None
    out = {}
    n, items = len(sessions), {i for _, i in labels} | {"never"}
    bought = dict(labels)
    for e, steps in fresh.items():
        for item in items:
            p = prior = (sum(i == item for i in bought.values()) + 0.5) / (n + 1)
            for d in range(1, depth + 1):
                c = last(steps, d)
                same = [k for k, s in sessions.items() if c is not None and last(s, d) == c]
                if same:
                    p = (sum(bought[k] == item for k in same) + strength * p) / (len(same) + strength)
            out[e, item] = (p, prior)
    return out


def test_shares_back_off_like_dictionaries(spark, vocabulary):
    sessions, labels = made(1, 80)
    fresh = made(2, 30)[0] | {30: [{"a"}, {"b"}, {"c"}, {"a"}], 31: [{"c"}]}
    tree = CT.fit(CT.contexts(CT.symbols(steps_of(spark, sessions), vocabulary)), spark.createDataFrame(labels, f"{EVENT} long, item_id string"))
    want = plain(sessions, labels, fresh)
    pairs = spark.createDataFrame([*want, (99, "x")], f"{EVENT} long, item_id string")
    found = CT.shares(tree, CT.contexts(CT.symbols(steps_of(spark, fresh), vocabulary)), pairs)
    got = {(r[EVENT], r["item_id"]): (r["share"], r["prior"]) for r in found.collect()}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k]) for k in want)


def test_another_order_gives_other_scores(spark, rows, vocabulary):
    sessions, labels = made(3, 60)
    tree = CT.fit(CT.contexts(CT.symbols(steps_of(spark, sessions), vocabulary)), spark.createDataFrame(labels, f"{EVENT} long, item_id string"))
    schema = f"run int, {EVENT} long, item_id string, score double"
    scores = spark.createDataFrame([(1, 1, "x", 0.3), (1, 1, "y", 0.3), (1, 7, "x", 0.4)], schema)

    def scored(steps):
        found = CT.contexts(CT.symbols(steps_of(spark, {1: steps}), vocabulary))
        return rows(CT.joined(scores, CT.shares(tree, found, scores)))

    there, back = scored([{"b"}, {"a"}]), scored([{"a"}, {"b"}])
    assert there[0][3] > 0.3 > there[1][3] and there[0][3] != back[0][3]
    assert there[2] == (1, 7, "x", pytest.approx(0.4))
    want = plain(sessions, labels, {1: [{"b"}, {"a"}]})[1, "x"]
    logit = lambda p: math.log(p / (1 - p))
    assert there[0][3] == pytest.approx(1 / (1 + math.exp(-(logit(0.3) + logit(want[0]) - logit(want[1])))))


def test_nothing_learnt(spark, vocabulary):
    sessions, labels = made(4, 5)
    found = CT.contexts(CT.symbols(steps_of(spark, sessions), vocabulary))
    none = CT.fit(found.limit(0), spark.createDataFrame(labels, f"{EVENT} long, item_id string"))
    pairs = spark.createDataFrame(labels, f"{EVENT} long, item_id string")
    assert {(r["share"], r["prior"]) for r in CT.shares(none, found, pairs).collect()} == {(0.5, 0.5)}
    assert CT.shares(none, found.limit(0), pairs).count() == 0
