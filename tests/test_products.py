"""Sums of products of stored vectors, and how vectors meet other tables of events."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyweave.functions import products as P
from tallyweave.functions.vectors import entry, stage_vectors
from tallyweave.operators import ridge

EVENTS, ITEMS = 6, ("a", "b")


def _rows(full: np.ndarray) -> P.Rows:
    row, at = np.nonzero(full)
    return P.Rows(np.bincount(row, minlength=len(full)), at, full[row, at], full.shape[1])


@pytest.mark.parametrize(("n", "width", "filled", "dense"), [(2500, 90, 4, 0), (1500, 80, 3, 20), (40, 12, 2, 12), (3, 4, 0, 0)])
def test_products_of_sparse_rows_equal_those_of_matrices(n, width, filled, dense):
    rng = np.random.default_rng(1)
    x = np.zeros((n, width))
    for row in x:
        row[rng.choice(width, filled, replace=False)] = rng.normal(size=filled)
    x[:, :dense] = rng.normal(size=(n, dense))
    y, w = x[::-1, 1:], rng.poisson(1, size=(n, 2)).astype(float)
    square, cross = np.zeros((2, width, width)), np.zeros((2, width, width - 1))
    P.add_products(square, _rows(x), None, w)
    P.add_products(cross, _rows(x), _rows(y), w)
    for r in range(2):
        assert np.allclose(square[r], (x * w[:, r, None]).T @ x)
        assert np.allclose(cross[r], (x * w[:, r, None]).T @ y)


def test_stored_vectors_of_both_kinds_become_rows():
    kinds = pa.struct([("type", pa.int8()), ("size", pa.int32()), ("indices", pa.list_(pa.int32())), ("values", pa.list_(pa.float64()))])
    held = pa.array(
        [
            {"type": 0, "size": 3, "indices": [2], "values": [5.0]},
            {"type": 1, "size": None, "indices": None, "values": [1.0, 0.0, 2.0]},
            {"type": 0, "size": 3, "indices": [], "values": []},
        ],
        kinds,
    )
    assert P.vectors(held).matrix().tolist() == [[0, 0, 5, 1], [1, 0, 2, 1], [0, 0, 0, 1]]
    assert P.vectors(held.slice(1)).matrix().tolist() == [[1, 0, 2, 1], [0, 0, 0, 1]]


def _plan(df) -> str:
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )


def test_vectors_meet_events_by_shuffle_however_small_their_files(spark):
    """Their files are a small share of the vectors' size: a broadcast of them filled the driver."""
    rows = spark.range(EVENTS).select(F.col("id").alias("purchase_event_id"), entry(F.col("id") + 1, 1).alias("entries"))
    vectors = stage_vectors(rows, 4, "product-vectors")
    labels = spark.createDataFrame([(i, ITEMS[i % 2]) for i in range(EVENTS)], "purchase_event_id long, item_id string")
    weights = ridge.weighted(vectors, [None])
    for df in (ridge.square_moments(vectors, weights, 1), ridge.label_moments(vectors, labels, weights, 1)):
        assert "BroadcastHashJoin" not in _plan(df)
    scored = ridge.score(ridge.fit(vectors, labels), vectors, labels, (1,))
    joins = _plan(scored).split("\n\n\n")[0]
    # only the items known, which the scorer's coefficients name, may travel
    assert joins.count("SortMergeJoin") == 1 and "BroadcastHashJoin Inner" not in joins
    assert scored.count() == EVENTS
