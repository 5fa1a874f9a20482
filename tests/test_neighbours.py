"""Nearest reference events against all pairs, and what is read off them."""

import numpy as np
import pytest

from tallyweave.operators import neighbours as NB

EVENT = "purchase_event_id"
SCHEMA = f"{EVENT} long, x array<double>"


def plain(questions, references, k):
    unit = lambda v: np.array(v) / (np.linalg.norm(v) or 1)
    out = []
    for q, x in questions:
        near = sorted((-round(float(unit(x) @ unit(y)), 9) + 0.0, e) for e, y in references)[:k]
        out += [(q, rank, e, -c + 0.0) for rank, (c, e) in enumerate(near, 1)]
    return sorted(out)


def made(seed, n, d, binary):
    draw = np.random.default_rng(seed)
    middles = draw.normal(size=(7, d)) * 3
    rows = (draw.random(size=(n, d)) < 0.2).astype(float) if binary else middles[draw.integers(7, size=n)] + draw.normal(size=(n, d))
    return [(i, v.tolist()) for i, v in enumerate(rows)]


@pytest.mark.parametrize("binary", [False, True])
def test_equals_all_pairs(spark, rows, monkeypatch, binary):
    monkeypatch.setattr(NB, "CELL", 40)
    monkeypatch.setattr(NB, "GROUP", 7)
    references, questions = made(1, 700, 12, binary), made(2, 90, 12, binary)
    found = NB.nearest(spark.createDataFrame(questions, SCHEMA), spark.createDataFrame(references, SCHEMA), 4)
    want = plain(questions, references, 4)
    got = rows(found)
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert [r[3] for r in got] == pytest.approx([r[3] for r in want], abs=2e-9)


def test_few_references_and_zero_vectors(spark, rows):
    references = [(5, [1.0, 0.0]), (3, [0.0, 0.0]), (9, [2.0, 0.0])]
    questions = [(1, [3.0, 0.0]), (2, [0.0, 0.0]), (4, [0.0, -1.0])]
    asked, told = spark.createDataFrame(questions, SCHEMA), spark.createDataFrame(references, SCHEMA)
    assert rows(NB.nearest(asked, told, 5)) == plain(questions, references, 5)
    assert NB.nearest(asked, told.limit(0), 5).count() == 0 and NB.nearest(asked.limit(0), told, 5).count() == 0


def test_what_neighbours_share(spark, rows):
    near = spark.createDataFrame([(1, 1, 10), (1, 2, 11), (1, 3, 12), (2, 1, 10)], f"question long, rank int, {EVENT} long")
    aged = spark.createDataFrame(
        [(10, 0, ["a", "b"], [0, 1]), (11, 0, ["a"], [0]), (12, 0, ["b"], [1]), (10, 2, ["c"], [2]), (11, 1, [], []), (12, 1, ["a"], [0])],
        f"{EVENT} long, age int, features array<string>, positions array<int>",
    )
    assert rows(NB.imputed_steps(near, aged)) == [(1, 1, ["a", "b"], [0, 1]), (2, 1, ["c"], [2]), (2, 2, ["a", "b"], [0, 1])]
    told = spark.createDataFrame([(10, [1.0, 2.0]), (11, [3.0, 6.0]), (12, [5.0, 1.0])], f"{EVENT} long, embedding array<double>")
    assert rows(NB.imputed_embeddings(near, told)) == [(1, [3.0, 3.0]), (2, [1.0, 2.0])]


def test_recall_on_every_fiftieth_event(spark):
    references, questions = made(3, 3000, 24, False), [(i, v) for i, v in made(4, 3000, 24, False) if i % 50 == 0]
    found = NB.nearest(spark.createDataFrame(questions, SCHEMA), spark.createDataFrame(references, SCHEMA), 5)
    got = {(r["question"], r[EVENT]) for r in found.collect()}
    want = {(q, e) for q, _, e, _ in plain(questions, references, 5)}
    assert len(got & want) >= 0.99 * len(want)
