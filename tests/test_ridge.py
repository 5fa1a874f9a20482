"""Item-blocked ridge scorers, their repeated runs, distillation and the encoder, against numpy on whole matrices."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tallyweave.operators import encoder, ridge
from tallyweave.operators.models import bootstrap_weights

EVENT = "purchase_event_id"


def made(spark, n=90, d=5, items=7, seed=1):
    draw = np.random.default_rng(seed)
    x = draw.normal(size=(n, d)) * (draw.random(size=(n, d)) < 0.7)
    y = (draw.random(size=(n, items)) < 0.2 + 0.3 * (x[:, [0]] > 0)).astype(float)
    y[:, 0] = 1  # an item that everyone buys
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], f"{EVENT} long, v array<double>").repartition(6)
    labels = spark.createDataFrame([(int(e), f"i{j}") for e, j in zip(*np.nonzero(y))], f"{EVENT} long, item_id string")
    return x, y, vectors.select(EVENT, array_to_vector("v").alias("vector")), labels


def plain(x, y, w, shrink=1.0):
    """Coefficients of every item, the constant last, by stacking the penalty under the rows."""
    ones = np.hstack([x, np.ones((len(x), 1))])
    penalty = np.sqrt(np.append(np.full(x.shape[1], shrink), 1e-9))
    rows = np.vstack([ones * np.sqrt(w)[:, None], np.diag(penalty)])
    return np.linalg.lstsq(rows, np.vstack([y * np.sqrt(w)[:, None], np.zeros((len(penalty), y.shape[1]))]), rcond=None)[0]


def coefficients(scorer, run=0):
    rows = scorer.coefficients.where(F.col("run") == run).collect()
    return {r["item_id"]: np.array(r["coefficients"]) for r in rows}


@pytest.mark.parametrize("per_block", [1, 3, 512])
def test_equals_numpy_in_any_blocks(spark, per_block):
    x, y, vectors, labels = made(spark)
    found = ridge.fit(vectors, labels, items_per_block=per_block)
    want = plain(x, y, np.ones(len(x)))
    got = coefficients(found)
    assert found.blocks == -(-7 // per_block) and len(got) == 7
    for j in range(7):
        assert got[f"i{j}"] == pytest.approx(want[:, j], abs=1e-8)


def test_runs_together_equal_runs_alone(spark):
    x, y, vectors, labels = made(spark)
    events = vectors.select(EVENT)
    tables = [None, bootstrap_weights(events, 2), bootstrap_weights(events, 3)]
    together = ridge.fit(vectors, labels, tables)
    for r, table in enumerate(tables):
        alone = coefficients(ridge.fit(vectors, labels, [table]))
        w = np.ones(len(x))
        if table is not None:
            w = np.array([row["weight"] for row in table.orderBy(EVENT).collect()])
        want = plain(x, y, w)
        for item, got in coefficients(together, r).items():
            assert got == pytest.approx(alone[item], abs=1e-9)
            assert got == pytest.approx(want[:, int(item[1:])], abs=1e-7)


def test_an_item_whose_buyers_all_weigh_nothing(spark):
    x, y, vectors, labels = made(spark)
    weights = labels.groupBy(EVENT).agg(F.max((F.col("item_id") == "i3").cast("int")).alias("_b")).select(EVENT, (1.0 - F.col("_b")).alias("weight"))
    got = coefficients(ridge.fit(vectors, labels, [weights]))
    assert got["i3"] == pytest.approx(np.zeros(6), abs=1e-8)


@pytest.mark.parametrize("per_block,per_task", [(2, 7), (512, 1024)])
def test_scores_of_the_wanted_pairs(spark, per_block, per_task):
    x, y, vectors, labels = made(spark)
    found = ridge.fit(vectors, labels, items_per_block=per_block)
    pairs = [(e, f"i{j}") for e in range(95) for j in range(9) if (e + j) % 3] * 2
    wanted = spark.createDataFrame(pairs, f"{EVENT} long, item_id string")
    rows = ridge.score(found, vectors, wanted, (4,), ridge.linear, per_task).collect()
    want = np.hstack([x, np.ones((len(x), 1))]) @ plain(x, y, np.ones(len(x)))
    assert {(r[EVENT], r["item_id"]) for r in rows} == {(e, i) for e, i in pairs if e < 90 and int(i[1:]) < 7}
    assert len(rows) == len({(r[EVENT], r["item_id"]) for r in rows}) and {r["run"] for r in rows} == {4}
    for r in rows:
        assert r["score"] == pytest.approx(want[r[EVENT], int(r["item_id"][1:])], abs=1e-8)
    risen = {(r[EVENT], r["item_id"]): r["score"] for r in ridge.score(found, vectors, wanted, (1,)).collect()}
    assert all(0 < s < 1 for s in risen.values())
    straight = {(r[EVENT], r["item_id"]): r["score"] for r in rows}
    order = sorted(straight, key=straight.get)
    assert [risen[k] for k in order] == sorted(risen.values())


def test_scores_of_items_are_independent(spark):
    x, y, vectors, labels = made(spark)
    both = coefficients(ridge.fit(vectors, labels))
    without = coefficients(ridge.fit(vectors, labels.where("item_id <> 'i0'")))
    assert all(without[i] == pytest.approx(both[i], abs=1e-10) for i in without)


def test_distillation_from_moments_equals_the_exploded_fit(spark):
    x, y, vectors, labels = made(spark)
    draw = np.random.default_rng(9)
    x1, x2 = draw.normal(size=(90, 3)), draw.normal(size=(90, 4))
    tables = [
        spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(t)], f"{EVENT} long, v array<double>").select(EVENT, array_to_vector("v").alias("vector"))
        for t in (x1, x2)
    ]
    drawn = bootstrap_weights(vectors.select(EVENT), 2)
    both = [None, drawn]
    teachers = [ridge.fit(t, labels, both) for t in tables]
    weights = ridge.weighted(vectors, both)
    told = [(ridge.cross_moments(vectors, t, weights, 2), teacher, f) for t, teacher, f in zip(tables, teachers, (0.5, 2.0))]
    student = ridge.solve(
        ridge.square_moments(vectors, weights, 2), ridge.label_moments(vectors, labels, weights, 2), 2, items_per_block=2, teachers=told
    )
    for r, w in enumerate((np.ones(90), np.array([row["weight"] for row in drawn.orderBy(EVENT).collect()]))):
        targets = y.copy()
        for t, f in ((x1, 0.5), (x2, 2.0)):
            targets += f * np.hstack([t, np.ones((90, 1))]) @ plain(t, y, w)
        want = plain(x, targets, w)
        got = coefficients(student, r)
        assert len(got) == 7
        for item, c in got.items():
            assert c == pytest.approx(want[:, int(item[1:])], abs=1e-6)


def test_no_items_and_no_coefficients_on_the_driver(spark, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    x, y, vectors, labels = made(spark)
    for name in ("collect", "toPandas", "first", "head", "take"):
        monkeypatch.setattr(DataFrame, name, lambda self, *a, **k: pytest.fail("rows came to the driver"))
    found = ridge.fit(vectors, labels)
    plan = ridge.score(found, vectors, labels, (1,))._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_empty_tables(spark):
    x, y, vectors, labels = made(spark)
    none = ridge.fit(vectors, labels.limit(0))
    assert none.coefficients.count() == 0 and ridge.score(none, vectors, labels, (1,)).count() == 0
    assert ridge.score(ridge.fit(vectors, labels), vectors.limit(0), labels, (1,)).count() == 0


# --- encoder ---------------------------------------------------------------------------------


def canonical(x, y, shrink):
    """Canonical directions of the rows (step, item) by numpy on the whole, exploded matrix."""
    e, j = np.nonzero(y)
    rows, one_hot = x[e], np.eye(y.shape[1])[j]
    rows = rows - rows.mean(axis=0)
    total = rows.T @ rows + shrink * np.eye(x.shape[1])
    hat = one_hot @ np.linalg.pinv(one_hot.T @ one_hot) @ one_hot.T
    values, vectors = np.linalg.eig(np.linalg.solve(total, rows.T @ hat @ rows))
    order = np.argsort(-values.real)
    return values.real[order], vectors.real[:, order], x[e].mean(axis=0)


def test_encoder_spans_the_canonical_subspace(spark):
    x, y, vectors, labels = made(spark, n=120, d=6, items=5)
    fitted = encoder.fit(vectors, labels, directions=3, shrink=0.5)
    values, want, mean = canonical(x, y, 0.5)
    rows = fitted.orderBy("direction").collect()
    got = np.array([r["weights"] for r in rows]).T
    assert [r["correlation"] ** 2 for r in rows] == pytest.approx(values[:3], abs=1e-8)
    q1, q2 = np.linalg.qr(got)[0], np.linalg.qr(want[:, :3])[0]
    assert np.abs(q1 @ q1.T - q2 @ q2.T).max() < 1e-6
    for row in encoder.encode(vectors, fitted).collect():
        assert row["encoded"] == pytest.approx((x[row[EVENT]] - mean) @ got, abs=1e-8)


def test_encoder_takes_several_steps_of_an_event(spark):
    x, y, vectors, labels = made(spark, n=60, d=4, items=4)
    twice = vectors.unionByName(vectors.where(f"{EVENT} < 20"))
    values, _, _ = canonical(np.vstack([x, x[:20]]), np.vstack([y, y[:20]]), 1.0)
    found = [r["correlation"] ** 2 for r in encoder.fit(twice, labels).orderBy("direction").collect()]
    assert len(found) <= 3 and found == pytest.approx(values[: len(found)], abs=1e-8)


def test_an_encoder_needs_labels(spark):
    x, y, vectors, labels = made(spark)
    with pytest.raises(ValueError, match="no direction"):
        encoder.projection(encoder.fit(vectors, labels.limit(0)))


def test_without_weights_nothing_is_joined(spark, rows):
    rows_of = spark.createDataFrame([(1, [1.0, 2.0]), (2, [0.0, 3.0]), (None, [5.0, 5.0])], f"{EVENT} long, v array<double>")
    vectors = rows_of.select(EVENT, array_to_vector("v").alias("vector"))
    labels = spark.createDataFrame([(1, "a"), (2, "a"), (2, "b"), (None, "b")], "purchase_event_id long, item_id string")
    ones = ridge.weighted(vectors, [None, None])
    assert rows(ridge.square_moments(vectors, None, 2)) == rows(ridge.square_moments(vectors, ones, 2))
    assert rows(ridge.label_moments(vectors, labels, None, 2)) == rows(ridge.label_moments(vectors, labels, ones, 2))
    assert "Join" not in ridge.square_moments(vectors, None, 2)._jdf.queryExecution().toString()
