"""Helpers that several operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A given table; only Spark reads it, so any store that Spark reaches will do."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def texts_of(documents: DataFrame, *extra: str) -> DataFrame:
    """``doc_id``, ``text`` (null becomes empty) and the named columns; whatever else there is goes."""
    return documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *extra)


def fold(column: str, folds: int) -> Column:
    """crc32 of the column written as text, modulo ``folds``; null stays null."""
    return F.crc32(F.col(column).cast("string")) % folds


def hash_share(*columns: str, seed: int = 0) -> Column:
    """A number in [0, 1) that depends on the row's columns alone, so a retried task draws the same."""
    return F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit(1 << 30)) / F.lit(float(1 << 30))


class Shared:
    """A value on every executor, by ``value``. Its classes travel with it: nothing needs to be installed there."""

    def __init__(self, spark: SparkSession, value: object):
        self.sent = spark.sparkContext.broadcast(cloudpickle.dumps(value))

    def __getstate__(self) -> dict:
        return {"sent": self.sent}

    @property
    def value(self):
        if "held" not in self.__dict__:
            self.held = cloudpickle.loads(self.sent.value)
        return self.held


def per_batch(work: Callable[[pd.DataFrame], pd.DataFrame]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """A function on one frame as a function for ``mapInPandas``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield work(frame)

    return run


def pool_adjacent(weights: np.ndarray, means: np.ndarray) -> np.ndarray:
    """Isotonic fit: the non-decreasing sequence nearest to ``means`` under ``weights``."""
    blocks: list[list[float]] = []
    for weight, mean in zip(weights.tolist(), means.tolist(), strict=True):
        blocks.append([weight, mean, 1])
        while len(blocks) > 1 and blocks[-2][1] >= blocks[-1][1]:
            w2, m2, n2 = blocks.pop()
            w1, m1, n1 = blocks.pop()
            total = w1 + w2
            blocks.append([total, (w1 * m1 + w2 * m2) / total if total else 0.0, n1 + n2])
    return np.repeat([b[1] for b in blocks], [int(b[2]) for b in blocks])
