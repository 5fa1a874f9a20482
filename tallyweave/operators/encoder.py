"""A learned projection of steps, from summed moments: the directions that tell bought items apart.

A row is a step (a conversation, or a session) together with one bought item of its event. Canonical
correlation of the step's vector x with the item solves

    B v = r^2 (T + ridge I) v,   T = sum (x - m)(x - m)',   B = sum over items of n_i (m_i - m)(m_i - m)',

m being the mean of all rows and m_i that of an item's n_i rows. T comes from the square moments, with the
number of bought items as weight, and B from the label moments; both are sums with a size that depends on
the vectors' width alone, so one task solves them, and rows are read twice whatever their number. There is
at most one direction less than there are items.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.functions.batches import stacked
from tallyweave.functions.products import Rows, products
from tallyweave.operators import ridge
from tallyweave.schemas import EVENT
from tallyweave.state import stage

DIRECTIONS = 64
RIDGE = 1.0
FITTED = "direction int, correlation double, weights array<double>, shift double"


def between_moments(labelled: DataFrame) -> DataFrame:
    """The sum over items of s s' / n for the label moments s, whose last number is n; as ``row`` and ``sums``."""
    rows = labelled.where(F.element_at("sums", -1) > 0).select(
        F.col("sums").alias("x"), F.array(1 / F.element_at("sums", -1)).alias("w")
    )
    return ridge._matrix_sum(rows, 1)


def solved(square: np.ndarray, between: np.ndarray, directions: int, shrink: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Squared correlations, directions (columns) and the mean, from both matrices with the constant last."""
    n = square[-1, -1]
    mean = square[:-1, -1] / n
    total = square[:-1, :-1] - n * np.outer(mean, mean)
    apart = between[:-1, :-1] - n * np.outer(mean, mean)
    low = np.linalg.cholesky(total + shrink * np.eye(len(total)))
    inner = np.linalg.solve(low, np.linalg.solve(low, apart).T)
    found, turned = np.linalg.eigh((inner + inner.T) / 2)
    best = np.argsort(-found)[:directions]
    best = best[found[best] > 1e-9]
    vectors = np.linalg.solve(low.T, turned[:, best])
    # of the two signs that in which the largest number is positive
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
    return found[best], vectors * signs, mean


def fit(steps: DataFrame, labels: DataFrame, directions: int = DIRECTIONS, shrink: float = RIDGE) -> DataFrame:
    """Fitted state: ``direction`` (from 0, the strongest first), ``correlation``, ``weights`` and ``shift``.

    ``steps(event, vector)`` may hold several rows of an event, ``vector`` being an ML vector; steps of
    events without a label take no part. Without any such step there is no direction.
    """
    bought = labels.select(EVENT, "item_id").distinct()
    weights = stage(bought.groupBy(EVENT).agg(F.array(F.count(F.lit(1)).cast("double")).alias("w")), "encoder-weights")
    single = weights.select(EVENT, F.array(F.lit(1.0)).alias("w"))
    square = ridge.square_moments(steps, weights, 1).select(F.lit("square").alias("kind"), "row", "sums")
    between = between_moments(ridge.label_moments(steps, bought, single, 1)).select(F.lit("between").alias("kind"), "row", "sums")

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        of = {kind: stacked(part.sort_values("row")["sums"]) for kind, part in rows.groupby("kind")}
        found, vectors, mean = solved(of["square"], of["between"], directions, shrink)
        return pd.DataFrame({
            "direction": np.arange(len(found)), "correlation": np.sqrt(np.minimum(found, 1)), "weights": list(vectors.T), "shift": mean @ vectors,
        })

    return square.unionByName(between).groupBy().applyInPandas(solve, FITTED)


@dataclass(frozen=True)
class Projection:
    """The directions of a fitted encoder as one matrix; its size depends on the vectors' width alone."""

    weights: np.ndarray
    shift: np.ndarray


def projection(fitted: DataFrame) -> Projection:
    rows = fitted.orderBy("direction").toPandas()
    if not len(rows):
        raise ValueError("the encoder found no direction: no labelled step, or a single item")
    return Projection(np.stack(rows["weights"].to_numpy()).T, rows["shift"].to_numpy())


def encode(steps: DataFrame, fitted: DataFrame, vector: str = "vector") -> DataFrame:
    """``steps`` with ``encoded``, the projections of their centred vectors, in place of ``vector``; null stays null."""
    found = projection(fitted)
    shared = steps.sparkSession.sparkContext.broadcast((found.weights, found.shift))

    @F.pandas_udf("array<double>")
    def project(values: pd.Series) -> pd.Series:
        weights, shift = shared.value
        there = np.flatnonzero(values.notna())
        out: list[np.ndarray | None] = [None] * len(values)
        if len(there):
            for i, row in zip(there.tolist(), stacked(values.iloc[there]) @ weights - shift, strict=True):
                out[i] = row
        return pd.Series(out, index=values.index, dtype=object)

    return steps.withColumn("encoded", project(vector_to_array(F.col(vector)))).drop(vector)


def scaled(steps: DataFrame, found: Projection) -> DataFrame:
    """``steps(..., entries)`` with ``scale``: one over the length of a step's projection, 0 where that is zero."""
    shared = steps.sparkSession.sparkContext.broadcast((found.weights, found.shift))

    @F.pandas_udf("double")
    def scale(at: pd.Series, x: pd.Series) -> pd.Series:
        weights, shift = shared.value
        if not len(at):
            return pd.Series(dtype=float)
        rows = Rows(at.map(len).to_numpy(), np.concatenate(at.to_list()).astype(int), np.concatenate(x.to_list()).astype(float), len(weights))
        lengths = np.concatenate([np.linalg.norm(made - shift, axis=1) for _, _, made in products(rows, weights)])
        return pd.Series(np.divide(1, lengths, out=np.zeros_like(lengths), where=lengths > 0), index=at.index)

    return steps.withColumn("scale", scale(F.col("entries.at"), F.col("entries.x")))
