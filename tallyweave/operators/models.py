"""Weights of repeated runs, and batch scoring of any model."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.schemas import EVENT


DRAW_BITS = 52


def bootstrap_weights(events: DataFrame, run: int, seed: int = 42) -> DataFrame:
    """Weight of each event in a repeated run: 1 in run 1, later a Poisson count drawn from a hash of the id.

    The draw depends on seed, run and event only, so it is the same on any partitioning. It is the number
    of cumulative shares, 1/e (1/0! + ... + 1/n!), that a uniform number of DRAW_BITS bits reaches; beyond
    18 events in a unit the shares differ from 1 by less than such a number can tell.
    """
    if run == 1:
        return events.select(EVENT, F.lit(1.0).alias("weight"))
    draw = F.pmod(F.xxhash64(F.lit(seed), F.lit(run), EVENT), F.lit(1 << DRAW_BITS)) / F.lit(float(1 << DRAW_BITS))
    shares = accumulate(math.exp(-1) / math.factorial(n) for n in range(19))
    steps = [(draw >= F.lit(share)).cast("double") for share in shares if share < 1]
    return events.select(EVENT, sum(steps[1:], steps[0]).alias("weight"))


def batch_score(
    rows: DataFrame, model: object, predict: Callable[[object, pd.DataFrame], pd.DataFrame], schema: str
) -> DataFrame:
    """Apply ``predict(model, batch)`` to Arrow batches; the model is broadcast once per executor."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield predict(shared.value, batch)

    return rows.mapInPandas(run, schema)
