"""Fusion, distillation, weights, anchors and relative representations."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyweave.operators import anchors as A
from tallyweave.operators import fusion as FU
from tallyweave.operators import weights as W

PAIR = "purchase_event_id long, item_id string"
RUN = "run int, " + PAIR + ", score double"
TYPES = "purchase_event_id long, event string"


def test_fusion_by_type(spark, rows):
    types = spark.createDataFrame([(1, "conversation"), (2, "session"), (3, "intersection")], TYPES)
    talk = spark.createDataFrame([(1, 1, "a", 0.2), (1, 3, "a", 0.4)], RUN)
    clicks = spark.createDataFrame([(1, 2, "a", 0.6), (1, 3, "a", 1.0)], RUN)
    fused = FU.late_fusion(talk, clicks, types)
    assert rows(fused) == [(1, 1, "a", 0.2), (1, 2, "a", 0.6), (1, 3, "a", 0.7)]


def test_fused_score_is_null_when_one_parent_is(spark, rows):
    types = spark.createDataFrame([(3, "intersection")], TYPES)
    talk = spark.createDataFrame([(1, 3, "a", None)], RUN)
    clicks = spark.createDataFrame([(1, 3, "a", 1.0)], RUN)
    assert rows(FU.late_fusion(talk, clicks, types)) == [(1, 3, "a", None)]


def test_routing_takes_the_model_of_the_type(spark, rows):
    types = spark.createDataFrame([(1, "conversation"), (2, "session")], TYPES)
    both = [(1, e, "a", s) for e, s in ((1, 0.1), (2, 0.2))]
    routed = FU.routed_scores(
        {
            "conversation": spark.createDataFrame(both, RUN),
            "session": spark.createDataFrame([(r, e, i, s + 1) for r, e, i, s in both], RUN),
        },
        types,
    )
    assert rows(routed, "purchase_event_id", "score") == [(1, 0.1), (2, 1.2)]


def test_sample_weights(spark, rows):
    data = [(1, "conversation"), (2, "session"), (3, "session"), (4, "intersection")]
    found = W.sample_weights(spark.createDataFrame(data, TYPES))
    derived = (2 * 0.25 + 0.5) / (1 - 0.25)
    assert rows(found, "event", F.round("weight", 9).alias("weight")) == [
        ("conversation", 2.0), ("intersection", round(derived, 9)), ("session", 1.0), ("session", 1.0),
    ]
    only = W.sample_weights(spark.createDataFrame([(4, "intersection")], TYPES))
    assert only.first()["weight"] is None


def test_distillation_weights_and_loss(spark):
    types = spark.createDataFrame([(1, "conversation"), (2, "session"), (3, "intersection"), (4, "session")], TYPES)
    weights = W.distillation_weights(types)
    assert tuple(weights.first()) == (0.5, 0.75)
    targets = spark.createDataFrame(
        [(3, "a", 1.0, 0.3, 0.6), (3, "b", 0.0, 0.2, 0.9)],
        PAIR + ", y double, z1 double, z2 double",
    )
    student = spark.createDataFrame([(3, "a", 0.8), (3, "b", 0.0)], PAIR + ", score double")

    def bce(t, p):
        p = min(max(p, 1e-7), 1 - 1e-7)
        return -(t * math.log(p) + (1 - t) * math.log(1 - p))

    expected = 0.0
    for (y, z1, z2), p in (((1.0, 0.3, 0.6), 0.8), ((0.0, 0.2, 0.9), 0.0)):
        expected += (bce(y, p) + 0.5 * bce(z1, p) + 0.75 * bce(z2, p)) / 2
    assert FU.distillation_loss(targets, student, weights).first()["loss"] == pytest.approx(expected)


USERS = "user_id long, purchase_event_id long, conversation_id long, session_id long, event_number int"


def test_anchor_candidates_have_one_row_of_each(spark, rows):
    users = spark.createDataFrame(
        [
            (1, 1, 10, None, 1), (1, 1, None, 20, 2),
            (1, 2, 11, None, 1), (1, 2, 12, None, 2),
            (1, 3, 13, None, 1), (1, 3, None, 21, 2), (1, 3, None, 22, 3),
        ],
        USERS,
    )
    assert rows(A.anchor_candidates(users)) == [(1,)]


def test_quota_class_and_sample(spark, rows):
    labels = spark.createDataFrame(
        [(e, "a") for e in range(8)] + [(0, "b"), (1, "b"), (1, "c"), (2, "c")], PAIR
    )
    quotas = A.anchor_quota(labels, 6)  # shares 8, 2, 2 of 12 -> 4, 1, 1
    assert rows(quotas) == [("a", 4), ("b", 1), ("c", 1)]
    candidates = spark.createDataFrame([(e,) for e in range(8)], "purchase_event_id long")
    classes = A.anchor_class(candidates, labels, quotas)
    found = {e: c for e, c, _ in rows(classes)}
    assert (found[0], found[1], found[2], found[3]) == ("b", "b", "c", "a")
    sample = A.anchor_sample(classes, 6)
    per_class = {r["class"]: r["count"] for r in sample.groupBy("class").count().collect()}
    assert per_class == {"a": 4, "b": 1, "c": 1}
    positions = rows(sample, "anchor_pos", "purchase_event_id")
    assert [p for p, _ in positions] == list(range(1, 7))
    assert [e for _, e in positions] == sorted(e for _, e in positions)
    assert rows(sample) == rows(A.anchor_sample(classes.repartition(5), 6))


def test_short_classes_give_all_and_are_reported(spark, rows):
    labels = spark.createDataFrame([(e, "a") for e in range(4)], PAIR)
    quotas = A.anchor_quota(labels, 10)
    classes = A.anchor_class(spark.createDataFrame([(1,), (2,)], "purchase_event_id long"), labels, quotas)
    assert A.anchor_sample(classes, 10).count() == 2
    assert rows(A.anchor_shortfall(classes, quotas)) == [("a", 10, 8)]


@pytest.mark.parametrize("block", [1, 2, 100])
def test_cosines_match_numpy_for_any_block(spark, block):
    rng = np.random.default_rng(0)
    steps, anchors = rng.normal(size=(7, 5)), rng.normal(size=(3, 5))
    steps[2] = 0.0
    frame = spark.createDataFrame(
        [(i, v.tolist()) for i, v in enumerate(steps)], "purchase_event_id long, embedding array<double>"
    )
    fitted = spark.createDataFrame(
        [(i + 1, v.tolist()) for i, v in enumerate(anchors)], "anchor_pos int, vector array<double>"
    )
    found = A.relative_representation(frame, fitted, "embedding", block=block).orderBy("purchase_event_id").collect()
    for row, v in zip(found, steps):
        lengths = np.linalg.norm(v) * np.linalg.norm(anchors, axis=1)
        expected = np.divide(anchors @ v, lengths, out=np.zeros(3), where=lengths > 0)
        assert row["relative"] == pytest.approx(expected.tolist())


def test_cosines_of_places(spark):
    frame = spark.createDataFrame([(1, [0, 2]), (2, [])], "purchase_event_id long, positions array<int>")
    fitted = spark.createDataFrame([(1, [0]), (2, [1])], "anchor_pos int, vector array<int>")
    found = A.relative_representation(frame, fitted, "positions", width=3).orderBy("purchase_event_id").collect()
    assert found[0]["relative"] == pytest.approx([1 / math.sqrt(2), 0.0])
    assert found[1]["relative"] == [0.0, 0.0]


def test_mean_cosines_are_the_means_of_each_steps_cosines(spark):
    """Steps sum by event before they meet the anchors: one row goes on for each place of an event, none for each step."""
    draw = np.random.default_rng(2)
    clicks = [(e, sorted(set(draw.integers(0, 6, 3).tolist()))) for e in draw.integers(0, 5, 200).tolist()] + [(7, []), (8, [1])]
    talk = [(e, draw.normal(size=4).tolist()) for e in draw.integers(0, 6, 30).tolist()] + [(8, [0.0] * 4)]
    places = draw.integers(0, 2, (3, 6)).astype(float)
    places[0, 0], vectors = 1.0, draw.normal(size=(3, 4))
    fixed = [A._unit(places), A._unit(vectors)]
    steps = [
        [(e, [(p, 1.0) for p in at], 1 / math.sqrt(len(at)) if at else 0.0) for e, at in clicks],
        [(e, list(enumerate(x)), 1 / float(np.linalg.norm(x)) if any(x) else 0.0) for e, x in talk],
    ]
    kind = "purchase_event_id long, entries array<struct<at:int,x:double>>, scale double"
    parts = [A.Modality(spark.createDataFrame(s, kind), f.T, np.zeros(3), i) for i, (s, f) in enumerate(zip(steps, fixed, strict=True))]
    found = {r["purchase_event_id"]: r["mean"] for r in A.mean_cosines(parts).collect()}
    want: dict[int, list] = {}
    for e, at in clicks:
        row = np.zeros((1, 6))
        row[0, at] = 1
        want.setdefault(e, []).append(np.append(A._unit(row) @ fixed[0].T, 0))
    for e, x in talk:
        want.setdefault(e, []).append(np.append(A._unit(np.array([x])) @ fixed[1].T, 1))
    assert set(found) == set(want)
    assert all(np.allclose(found[e], np.mean(want[e], axis=0), atol=1e-12) for e in want)
