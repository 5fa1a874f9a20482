"""What neighbour search hands from task to task."""

import numpy as np
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from tallyweave.operators import neighbours as NB

EVENT = "purchase_event_id"


def test_a_question_is_one_row_until_spark_repeats_it(spark, monkeypatch):
    """Python once wrote a question's vector for each block that it visits: a batch filled the worker."""
    monkeypatch.setattr(NB, "CELL", 1)
    middle = spark.sparkContext.broadcast(np.eye(3))
    cells = spark.sparkContext.broadcast((np.array([2, 0, 3]), np.zeros(3), np.ones(3), np.array([0, 2, 2, 5])))
    asked = spark.createDataFrame(
        [(1, [1.0, 0.0, 0.0], float("nan")), (2, [0.0, 1.0, 0.0], float("inf")), (3, [0.0, 1.0, 0.0], float("nan"))],
        "question long, x array<double>, reach double",
    )
    found = {r["question"]: r["blocks"] for r in NB._visits(asked, middle, cells).collect()}
    assert found == {1: [0, 1], 2: [0, 1, 2, 3, 4], 3: [0, 1]}


def test_best_takes_the_first_of_equals():
    near = np.array([[0.5, 1.0, 0.5, 0.5], [0.0, 0.0, 0.0, 0.0], [0.1, 0.2, 0.3, 0.4]])
    row, column = NB._best(near, 2)
    assert [column[row == r].tolist() for r in range(3)] == [[0, 1], [0, 1], [2, 3]]


def test_stored_vectors_are_searched_like_arrays(spark, rows):
    draw = np.random.default_rng(5)
    sets = [(i, np.flatnonzero(draw.random(20) < 0.2).tolist()) for i in range(120)]
    arrays = spark.createDataFrame([(i, [float(p in s) for p in range(20)]) for i, s in sets], f"{EVENT} long, x array<double>")
    stored = spark.createDataFrame([(i, Vectors.sparse(20, s, [1.0] * len(s))) for i, s in sets], [EVENT, "x"])
    asked = F.col(EVENT) % 3 == 0
    assert rows(NB.nearest(stored.where(asked), stored, 3)) == rows(NB.nearest(arrays.where(asked), arrays, 3))


def test_a_visited_cell_is_not_visited_again(spark):
    """The second round once compared the questions with all of their first cell again."""
    middle = spark.sparkContext.broadcast(np.eye(3))
    cells = spark.sparkContext.broadcast((np.array([2, 0, 3]), np.zeros(3), np.ones(3), np.array([0, 2, 2, 5])))
    asked = spark.createDataFrame(
        [(1, [1.0, 0.0, 0.0], float("inf"), 0), (2, [0.0, 1.0, 0.0], float("inf"), 2)], "question long, x array<double>, reach double, seen int"
    )
    assert {r["question"]: r["blocks"] for r in NB._visits(asked, middle, cells).collect()} == {1: [2, 3, 4], 2: [0, 1]}


def test_single_precision_leaves_out_nothing_that_counts():
    draw = np.random.default_rng(7)
    for width, share in ((300, 0.02), (300, 0.02), (24, 0.5), (24, None)):
        rows = draw.normal(size=(1000, width)) if share is None else (draw.random((1000, width)) < share).astype(float)
        rows[500:600] = rows[:100]  # ties go to the first
        rows[7] = 0
        there, asking = NB._unit(rows[:900]), rows[860:1000]
        at = [np.flatnonzero(x) for x in asking]
        some = NB.Rows(np.array([len(a) for a in at]), np.concatenate(at), np.concatenate([x[a] for x, a in zip(asking, at, strict=True)]), width)
        near = np.round(NB._unit(asking) @ there.T, NB.DIGITS) + 0.0
        for k in (2, 5):
            want = np.argsort(-near, axis=1, kind="stable")[:, :k]
            row, column, value = NB._Block(there).best(some, np.full(140, -2.0), k)
            got = sorted(zip(row.tolist(), (-value).tolist(), column.tolist(), strict=True))
            assert [g[2] for g in got] == want.ravel().tolist()
            assert [-g[1] for g in got] == np.take_along_axis(near, want, axis=1).ravel().tolist()
            # with the k-th best known, what is returned still holds it and all above it
            bound = np.take_along_axis(near, want, axis=1)[:, -1]
            row, column, _ = NB._Block(there).best(some, bound, k)
            assert set(zip(row.tolist(), column.tolist(), strict=True)) == {(i, c) for i, cs in enumerate(want.tolist()) for c in cs}
