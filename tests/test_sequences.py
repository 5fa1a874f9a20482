"""Chunks of steps, and cosines with more anchors than one matrix holds."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyweave.operators import anchors as A
from tallyweave.operators import features as FE
from tallyweave.operators import sequences as SQ

EVENT = "purchase_event_id"
STEPS = f"{EVENT} long, event_number int, session_id long, features array<string>, positions array<int>"


def made(spark, long=700):
    rows = [(1, i + 1, i, [], [i % 5, 5 + i % 3] if i % 4 else []) for i in range(long)]  # one event with nearly all steps
    rows += [(2, 1, 9, [], [3])] + [(3, n, 10 - n, [], [n]) for n in (1, 2, 3)] + [(4, None, None, [], [])]
    return spark.createDataFrame(rows, STEPS)


@pytest.mark.parametrize("per_chunk,max_steps", [(1, None), (64, None), (1000, None), (64, 2), (64, 650)])
def test_chunks_rebuild_the_padded_slots(spark, rows, per_chunk, max_steps):
    steps = made(spark)
    chunks = SQ.chunked(steps, ["session_id"], per_chunk)
    found = SQ.slots(chunks, per_chunk, max_steps)
    want = FE.padded_slots(steps, ["session_id"], max_steps)
    columns = (EVENT, "slot", "n_steps", "positions")
    assert rows(found, *columns) == rows(want, *columns)


def test_a_long_event_spans_many_small_chunks(spark):
    chunks = SQ.chunked(made(spark), ["session_id"], 64)
    assert chunks.where(f"{EVENT} = 1").count() == 11
    assert chunks.where("size(offsets) > 65 or element_at(offsets, -1) <> size(values)").count() == 0
    assert chunks.where(F.exists(F.sequence(F.lit(1), F.size("offsets") - 1), lambda i: F.element_at("offsets", i + 1) < F.element_at("offsets", i))).count() == 0


def cosines(x, y):
    unit = lambda m: np.divide(m, np.linalg.norm(m, axis=1, keepdims=True), out=np.zeros_like(m), where=np.linalg.norm(m, axis=1, keepdims=True) > 0)
    return unit(x) @ unit(y).T


def test_many_anchors_meet_the_steps_in_blocks(spark, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    draw = np.random.default_rng(1)
    steps, anchors = draw.normal(size=(40, 6)), draw.normal(size=(5003, 6))
    steps[3] = 0
    anchors[17] = 0
    frame = spark.createDataFrame([(i, v.tolist() if i != 5 else None) for i, v in enumerate(steps)], f"{EVENT} long, v array<double>")
    fitted = spark.createDataFrame([(i + 1, v.tolist()) for i, v in enumerate(anchors)], "anchor_pos int, vector array<double>").repartition(7)
    monkeypatch.setattr(A, "STEP_GROUP", 16)
    monkeypatch.setattr(DataFrame, "toPandas", lambda self: pytest.fail("anchors came to the driver"))
    found = A.relative_representation(frame, fitted, "v", block=512)
    want = cosines(steps, anchors)
    want[5] = 0
    got = {r[EVENT]: r["relative"] for r in found.collect()}
    assert len(got) == 40
    for i in range(40):
        assert np.allclose(got[i], want[i], atol=1e-12)


def test_places_meet_anchors_in_blocks(spark):
    draw = np.random.default_rng(2)
    steps, anchors = (draw.random(size=(30, 9)) < 0.3).astype(float), (draw.random(size=(25, 9)) < 0.3).astype(float)
    listed = lambda m: [np.flatnonzero(v).tolist() for v in m]
    frame = spark.createDataFrame(list(enumerate(listed(steps))), f"{EVENT} long, positions array<int>")
    fitted = spark.createDataFrame([(i + 1, v) for i, v in enumerate(listed(anchors))], "anchor_pos int, vector array<int>")
    want = cosines(steps, anchors)
    for block in (4, 25, 100):
        got = {r[EVENT]: r["relative"] for r in A.relative_representation(frame, fitted, "positions", 9, block).collect()}
        assert all(np.allclose(got[i], want[i]) for i in range(30))


def test_no_anchor(spark):
    frame = spark.createDataFrame([(1, [1.0])], f"{EVENT} long, v array<double>")
    fitted = spark.createDataFrame([], "anchor_pos int, vector array<double>")
    assert [tuple(r) for r in A.relative_representation(frame, fitted, "v").collect()] == [(1, [])]
