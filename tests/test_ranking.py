"""Hand-worked frames for labels, masks, rankings, metrics and reports."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from tallyweave.operators import labels as L
from tallyweave.operators import metrics as M
from tallyweave.operators import ranking as R

PAIR = "purchase_event_id long, item_id string"
SCORED = PAIR + ", score double"
RUN = "run int, " + SCORED


def test_items_are_split_and_ordered_as_strings(spark, rows):
    bought = spark.createDataFrame([(1, "10;2"), (1, "2")], PAIR)
    assert rows(L.item_labels(bought)) == [(1, "10"), (1, "2")]
    wide = L.item_matrix(L.item_labels(bought), ["10", "2", "3"])
    assert rows(wide) == [(1, 1, 1, 0)]


def test_mask_zeroes_or_drops(spark, rows):
    scores = spark.createDataFrame([(1, "a", 0.5), (1, "b", 0.9)], SCORED)
    on_sale = spark.createDataFrame([(1, "a")], PAIR)
    assert rows(L.masked_scores(scores, on_sale)) == [(1, "a", 0.5), (1, "b", 0.0)]
    assert rows(L.masked_scores(scores, on_sale, drop_unavailable=True)) == [(1, "a", 0.5)]


def test_ties_go_to_the_smaller_string_and_nan_comes_last(spark, rows):
    scores = spark.createDataFrame([(1, "2", 0.5), (1, "10", 0.5), (1, "7", float("nan")), (1, "8", None), (1, "9", 0.0)], SCORED)
    assert rows(R.ranked_items(scores), "rank", "item_id") == [(1, "10"), (2, "2"), (3, "9"), (4, "7"), (5, "8")]


def test_masked_items_fill_the_top(spark, rows):
    scores = spark.createDataFrame([(1, "c", 5.0)], SCORED)
    events = spark.createDataFrame([(1,), (2,)], "purchase_event_id long")
    items = spark.createDataFrame([(i,) for i in "abcd"], "item_id string")
    top = R.topk_sparse(scores, events, items, 3)
    assert rows(top, "purchase_event_id", "rank", "item_id", "score") == [
        (1, 1, "c", 5.0), (1, 2, "a", 0.0), (1, 3, "b", 0.0), (2, 1, "a", 0.0), (2, 2, "b", 0.0), (2, 3, "c", 0.0),
    ]


@pytest.mark.parametrize("seed", range(3))
def test_sparse_top_k_equals_dense_top_k(spark, rows, seed):
    rng = random.Random(seed)
    items = [str(i) for i in range(12)]
    dense = [(e, i, float(rng.choice([0, 0, 0, 1, 2]))) for e in range(30) for i in items]
    frame = spark.createDataFrame(dense, SCORED)
    expected = R.topk_items(frame, 4)
    found = R.topk_sparse(
        frame.where("score > 0"), frame.select("purchase_event_id"), frame.select("item_id"), 4
    )
    columns = ("purchase_event_id", "rank", "item_id", "score")
    assert rows(found, *columns) == rows(expected, *columns)


def _one(spark, order, relevant, ks):
    """Metrics of one event whose items rank in the given order."""
    scores = spark.createDataFrame([(1, i, 1.0 - n / 100) for n, i in enumerate(order)], SCORED)
    labels = spark.createDataFrame([(1, i) for i in relevant], PAIR)
    found = M.event_metrics(R.topk_items(scores, max(ks)), labels, ks).orderBy("k").collect()
    return {r["k"]: r.asDict() for r in found}


def test_average_precision_by_hand(spark):
    found = _one(spark, "abcde", "ace", [1, 3, 5])
    assert found[1]["average_precision"] == 1.0
    assert found[3]["average_precision"] == pytest.approx((1 + 2 / 3) / 3)
    assert found[5]["average_precision"] == pytest.approx((1 + 2 / 3 + 3 / 5) / 3)
    assert found[3]["precision"] == pytest.approx(2 / 3) and found[3]["recall"] == pytest.approx(2 / 3)


def test_no_labels_and_no_hits(spark):
    none = _one(spark, "abc", "", [3])[3]
    assert none["hit"] == 0 and none["precision"] == 0
    assert none["recall"] is None and none["average_precision"] is None
    miss = _one(spark, "abc", "z", [3])[3]
    assert miss["reciprocal_rank"] == 0 and miss["average_precision"] == 0


def test_fewer_items_than_k(spark):
    found = _one(spark, "ab", "b", [3])[3]
    assert found["hit"] == 1 and found["precision"] == pytest.approx(1 / 3)
    assert found["reciprocal_rank"] == 0.5 and found["average_precision"] == 0.5


def test_metric_properties(spark):
    rng = random.Random(5)
    scores = [(r, e, str(i), rng.random()) for r in (1, 2) for e in range(20) for i in range(8)]
    labels = {(e, str(rng.randrange(8))) for e in range(20) for _ in range(2)}
    top = R.topk_items(spark.createDataFrame(scores, RUN), 5)
    frame = spark.createDataFrame(sorted(labels), PAIR)
    found = M.event_metrics(top, frame, range(1, 6)).collect()
    again = M.event_metrics(top.repartition(7), frame.repartition(3), range(1, 6)).collect()
    assert {tuple(r) for r in found} == {tuple(r) for r in again}
    by_event = {}
    for r in found:
        assert 0 <= r["average_precision"] <= 1
        by_event.setdefault((r["run"], r["purchase_event_id"]), {})[r["k"]] = r
    for curve in by_event.values():
        hits = [curve[k]["hit"] for k in range(1, 6)]
        assert hits == sorted(hits)
        assert (curve[5]["reciprocal_rank"] == 1) == (curve[1]["hit"] == 1)


def test_report_shows_types_without_scores_as_null(spark, rows):
    types = spark.createDataFrame([(1, "session"), (2, "conversation")], "purchase_event_id long, event string")
    found = spark.createDataFrame(
        [(1, 1, 1.0, 0.5), (2, 1, 0.0, 0.25)], "run int, purchase_event_id long, hit double, average_precision double"
    )
    report = M.metrics_by_type(types, found, runs=[1, 2])
    assert rows(report, "run", "event", "n_events", "hit_rate", "mean_average_precision") == [
        (1, "conversation", 1, None, None), (1, "session", 1, 1.0, 0.5), (1, "union", 2, 1.0, 0.5),
        (2, "conversation", 1, None, None), (2, "session", 1, 0.0, 0.25), (2, "union", 2, 0.0, 0.25),
    ]
    assert rows(M.metrics_over_runs(report)) == [
        ("conversation", None, None), ("session", 0.5, 0.375), ("union", 0.5, 0.375),
    ]
    assert "union" not in {r["event"] for r in M.metrics_by_type(types, found, [1, 2], union=False).collect()}


def _pairwise_auc(scores, labels):
    """Share of (positive, negative) pairs in the right order, ties half."""
    positive = [s for s, y in zip(scores, labels) if y]
    negative = [s for s, y in zip(scores, labels) if not y]
    if not positive or not negative:
        return None
    wins = sum((p > n) + 0.5 * (p == n) for p, n in itertools.product(positive, negative))
    return wins / (len(positive) * len(negative))


def test_auc_equals_all_pairs_and_skips_one_class_items(spark):
    rng = random.Random(2)
    n = 60
    dense = {i: [rng.choice([0.0, 0.0, 0.1, 0.2, rng.random()]) for _ in range(n)] for i in "abcd"}
    bought = {i: [int(rng.random() < 0.3) for _ in range(n)] for i in "abc"}
    bought["d"] = [0] * n
    scores = spark.createDataFrame([(e, i, s) for i, v in dense.items() for e, s in enumerate(v) if s], SCORED)
    labels = spark.createDataFrame([(e, i) for i, v in bought.items() for e, y in enumerate(v) if y], PAIR)
    events = spark.range(n).withColumnRenamed("id", "purchase_event_id")
    found = {r["item_id"]: r["auc"] for r in M.item_auc(scores, labels, events).collect()}
    expected = {i: _pairwise_auc(dense[i], bought[i]) for i in "abcd"}
    assert found["d"] is None and expected["d"] is None
    for i in "abc":
        assert found[i] == pytest.approx(expected[i])
    macro = M.macro_auc(scores, labels, events).first()
    assert macro["macro_auc"] == pytest.approx(sum(expected[i] for i in "abc") / 3)
    assert (macro["n_items"], macro["n_skipped"]) == (3, 1)


def test_auc_of_an_item_without_scores_is_a_half(spark):
    scores = spark.createDataFrame([(0, "a", 1.0)], SCORED)
    labels = spark.createDataFrame([(0, "a"), (1, "b")], PAIR)
    events = spark.range(3).withColumnRenamed("id", "purchase_event_id")
    found = {r["item_id"]: r["auc"] for r in M.item_auc(scores, labels, events).collect()}
    assert found == {"a": 1.0, "b": 0.5}


def test_popularity_counts_and_scores(spark, rows):
    labels = spark.createDataFrame([(1, "a"), (2, "a"), (2, "b")], PAIR)
    on_sale = spark.createDataFrame([(9, "a"), (9, "z")], PAIR)
    assert rows(L.popularity_scores(on_sale, L.item_popularity(labels))) == [(9, "a", 2.0), (9, "z", 0.0)]


def test_curve_has_a_column_per_type(spark):
    types = spark.createDataFrame([(1, "session")], "purchase_event_id long, event string")
    found = spark.range(1).select(
        F.lit(1).alias("run"), F.lit(1).cast("long").alias("purchase_event_id"), F.lit(1).alias("k"),
        F.lit(0.5).alias("average_precision"),
    )
    row = M.map_by_k(types, found, [1], [1]).first()
    assert (row["session"], row["union"], row["conversation"]) == (0.5, 0.5, None)


@pytest.mark.parametrize("k", [1, 3, 5])
def test_sparse_top_k_equals_dense_with_any_scores(spark, rows, k):

    draw = random.Random(k)
    items = [f"i{n:02d}" for n in range(12)]
    scores, dense = [], []
    for event in range(60):
        for item in items:
            score = draw.choice([None, None, -2.0, -1.0, 0.0, 1.0, 2.0, float("nan")])
            if score is not None:
                scores.append((event, item, score))
            dense.append((event, item, 0.0 if score is None else score))
    schema = "purchase_event_id long, item_id string, score double"
    events = spark.range(60).withColumnRenamed("id", "purchase_event_id")
    catalogue = spark.createDataFrame([(i,) for i in items], "item_id string")
    sparse = R.topk_sparse(spark.createDataFrame(scores, schema), events, catalogue, k)
    expected = R.topk_items(spark.createDataFrame(dense, schema), k)
    columns = ("purchase_event_id", "item_id", "score", "rank")
    assert rows(sparse, *columns) == rows(expected, *columns)
