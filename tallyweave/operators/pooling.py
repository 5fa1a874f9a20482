"""Fixed-size event features pooled from session steps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.operators.features import with_ages
from tallyweave.schemas import EVENT


def pooled_sessions(steps: DataFrame, tie_breakers: Sequence[str] = ("session_id",)) -> DataFrame:
    """Per event and feature: seen in any step, seen in the last step, and a sum that halves with
    every step back. Long form; features never seen are 0 and implied."""
    hits = with_ages(steps, tie_breakers).select(
        EVENT,
        F.col("age").cast("double").alias("_age"),
        F.explode(F.arrays_zip("positions", "features")).alias("_f"),
    )
    return hits.groupBy(EVENT, F.col("_f.positions").alias("position"), F.col("_f.features").alias("feature")).agg(
        F.lit(1.0).alias("any_step"),
        F.max((F.col("_age") == 0).cast("double")).alias("last_step"),
        F.sum(F.pow(F.lit(0.5), F.col("_age"))).alias("recency"),
    )


def pooled_entries(steps: DataFrame, pooled: DataFrame, width: int) -> DataFrame:
    """Per event of ``steps``: the filled places of a vector of ``3 * width`` values, in order.

    An event holds at most one row per class of the bounded vocabulary. ``entries`` is null for an
    event without features.
    """
    triple = F.array(
        *[
            F.struct((F.col("position") + i * width).cast("int").alias("at"), F.col(name).alias("x"))
            for i, name in enumerate(("any_step", "last_step", "recency"))
        ]
    )
    packed = pooled.groupBy(EVENT).agg(F.array_sort(F.flatten(F.collect_list(triple))).alias("entries"))
    return steps.select(EVENT).distinct().join(packed, EVENT, "left")
