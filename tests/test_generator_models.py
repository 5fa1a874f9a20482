"""The linear generator against numpy, generated sessions, and the item scorer."""

import numpy as np
import pytest
from pyspark.ml.linalg import SparseVector
from pyspark.sql import functions as F

from tallyweave.functions.vectors import entry, shifted, stage_vectors
from tallyweave.operators import impute as I
from tallyweave.operators import models as MO
from tallyweave.operators import ridge

PAIRS = "purchase_event_id long, x array<double>, y array<double>"


def _pairs(spark, n=40, inputs=4, outputs=3):
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(n, inputs)), rng.normal(size=(n, outputs))
    frame = spark.createDataFrame([(i, a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(x, y))], PAIRS)
    return x, y, frame.repartition(5)


def test_generator_equals_ridge_on_the_whole_matrix(spark):
    x, y, pairs = _pairs(spark)
    fitted = I.fit_generator(pairs, ridge=2.0)
    # the same ridge problem posed as ordinary least squares on centred data
    mean_x, mean_y = x.mean(axis=0), y.mean(axis=0)
    stacked = np.vstack([x - mean_x, np.sqrt(2.0) * np.eye(x.shape[1])])
    target = np.vstack([y - mean_y, np.zeros((x.shape[1], y.shape[1]))])
    slopes = np.array([_least_squares(stacked, target[:, j]) for j in range(target.shape[1])]).T
    expected = (x[:5] - mean_x).dot(slopes) + mean_y
    found = I.generate(pairs.where("purchase_event_id < 5"), fitted, ["purchase_event_id"])
    for row in found.collect():
        assert row["y"] == pytest.approx(expected[row["purchase_event_id"]].tolist(), abs=1e-6)


def _least_squares(a, b, rounds=20_000):
    """Plain gradient descent: no linear algebra library on the driver."""
    gram = np.array([[float((a[:, i] * a[:, j]).sum()) for j in range(a.shape[1])] for i in range(a.shape[1])])
    right = np.array([float((a[:, i] * b).sum()) for i in range(a.shape[1])])
    w = np.zeros(a.shape[1])
    rate = 1.0 / gram.trace()
    for _ in range(rounds):
        w = w - rate * ((gram * w).sum(axis=1) - right)
    return w


def test_moments_do_not_depend_on_the_partitioning(spark, rows):
    _, _, pairs = _pairs(spark)
    def rounded(frame):
        sums = F.transform("sums", lambda v: F.round(v, 9))
        return rows(I.generator_moments(frame).select("row", sums))

    assert rounded(pairs) == rounded(pairs.coalesce(1))


def test_generated_steps_threshold_drop_and_renumber(spark, rows):
    vocabulary = spark.createDataFrame([("a", 0), ("b", 1)], "feature string, position int")
    # three steps, latest first: (a at exactly one half), (nothing), (a and b)
    generated = spark.createDataFrame(
        [(1, 0, [0.5, 0.49]), (1, 1, [0.0, 0.1]), (1, 2, [0.9, 0.7]), (2, 0, [0.1] * 2)],
        "purchase_event_id long, age int, y array<double>",
    )
    steps = I.generated_steps(generated, vocabulary)
    assert rows(steps) == [(1, 1, ["a", "b"], [0, 1]), (1, 2, ["a"], [0])]


def test_step_pairs_hold_every_step(spark, rows):
    steps = spark.createDataFrame(
        [(1, 1, 7, [0]), (1, 2, 8, [1]), (1, 3, 9, [0, 1]), (2, 3, 9, [])],
        "purchase_event_id long, event_number int, session_id long, positions array<int>",
    )
    events = spark.createDataFrame([(1, [5.0]), (2, [6.0])], "purchase_event_id long, x array<double>")
    assert rows(I.step_pairs(events, steps, width=2)) == [
        (1, 0, [5.0, 1.0], [1.0, 1.0]),
        (1, 1, [5.0, 0.5], [0.0, 1.0]),
        (1, 2, [5.0, 1 / 3], [1.0, 0.0]),
        (2, 0, [6.0, 1.0], [0.0, 0.0]),
    ]
    assert rows(I.length_pairs(events, steps)) == [(1, [5.0], [3.0]), (2, [6.0], [1.0])]


def test_sessions_are_generated_where_the_data_can_be_learnt(spark, rows):
    rng = np.random.default_rng(3)
    vocabulary = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "feature string, position int")
    events, steps = [], []
    for event in range(200):
        kind = event % 2
        events.append((event, [float(kind) + rng.normal() * 0.1, rng.normal()]))
        # kind 0: three steps of a, the last one with c; kind 1: one step of b
        for number in range(1, 4 if kind == 0 else 2):
            steps.append((event, number, number, [1] if kind else [0, 2] if number == 3 else [0]))
    frame = spark.createDataFrame(events, "purchase_event_id long, x array<double>")
    schema = "purchase_event_id long, event_number int, session_id long, positions array<int>"
    told = spark.createDataFrame(steps, schema)
    features = I.fit_discriminant(I.step_pairs(frame, told, 3))
    lengths = I.fit_generator(I.length_pairs(frame, told))
    fresh = spark.createDataFrame([(900, [0.0, 0.3]), (901, [1.0, -0.2])], "purchase_event_id long, x array<double>")
    found = rows(I.generate_steps(fresh, features, lengths, 3, vocabulary), "purchase_event_id", "event_number", "features")
    assert found == [(900, 1, ["a"]), (900, 2, ["a"]), (900, 3, ["a", "c"]), (901, 1, ["b"])]


def test_staged_entries_read_back_as_sparse_vectors(spark):
    frame = spark.createDataFrame(
        [(1, [(0, 2.0), (3, 0.0)]), (2, None)], "purchase_event_id long, entries array<struct<at:int,x:double>>"
    )
    longer = frame.withColumn("entries", F.concat(shifted(F.col("entries"), 1), entry(F.lit(7), 5)))
    found = {r[0]: r[1] for r in stage_vectors(longer, 6, "test-vectors").collect()}
    assert found == {1: SparseVector(6, {1: 2.0, 5: 7.0}), 2: SparseVector(6, {5: 7.0})}


def test_scorer_learns(spark):
    entries = spark.range(60).select(
        F.col("id").alias("purchase_event_id"),
        F.expr("array(struct(cast(id % 3 as int) as at, 1.0D as x))").alias("entries"),
    )
    vectors = stage_vectors(entries, 3, "scorer-vectors")
    targets = entries.select("purchase_event_id", F.concat(F.lit("i"), F.col("purchase_event_id") % 3).alias("item_id"))
    pairs = vectors.select("purchase_event_id").join(targets.select("item_id").distinct(), how="cross")
    scores = ridge.score(ridge.fit(vectors, targets), vectors, pairs, (1,))
    assert scores.count() == 180
    best = scores.groupBy("purchase_event_id").agg(F.max_by("item_id", "score").alias("best"))
    for row in best.collect():
        assert row["best"] == f"i{row['purchase_event_id'] % 3}"


def test_batch_score_applies_any_object(spark, rows):
    scored = MO.batch_score(
        spark.range(4), {"add": 10}, lambda model, batch: batch.assign(y=batch["id"] + model["add"]), "id long, y long"
    )
    assert rows(scored) == [(0, 10), (1, 11), (2, 12), (3, 13)]


def test_bootstrap_weights_are_repeatable_counts_with_mean_one(spark, rows):
    events = spark.range(5_000).withColumnRenamed("id", "purchase_event_id")
    assert MO.bootstrap_weights(events, 1).where("weight <> 1").count() == 0
    first = MO.bootstrap_weights(events, 2)
    assert rows(first) == rows(MO.bootstrap_weights(events.repartition(9), 2))
    assert rows(first) != rows(MO.bootstrap_weights(events, 3))
    stats = first.agg(F.avg("weight").alias("m"), F.var_samp("weight").alias("v")).first()
    assert stats["m"] == pytest.approx(1, abs=0.06) and stats["v"] == pytest.approx(1, abs=0.1)
