"""Filling a missing modality: column means, column modes, and a linear generator."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyweave.functions.batches import scattered, stacked
from tallyweave.operators.embeddings import long_vector
from tallyweave.operators.features import with_ages
from tallyweave.operators.ridge import SUMMERS
from tallyweave.operators.timeline import event_spine
from tallyweave.schemas import EVENT


# --- means and modes -----------------------------------------------------------------------


def fit_mean(rows: DataFrame) -> DataFrame:
    """Mean of each embedding position, ignoring nulls: one small table ``pos, value``."""
    return long_vector(rows, []).groupBy("pos").agg(F.avg("value").alias("value"))


def mean_vector(means: DataFrame) -> DataFrame:
    """The fitted means as one row with one array."""
    return means.agg(F.array_sort(F.collect_list(F.struct("pos", "value"))).alias("_m")).select(
        F.col("_m.value").alias("embedding")
    )


def impute_conversations(timeline: DataFrame, embeddings: DataFrame, means: DataFrame) -> DataFrame:
    """Every event of the timeline with an embedding; gaps take the fitted means."""
    filler = mean_vector(means).scalar()
    spine = event_spine(timeline, embeddings.select(EVENT, "embedding")).withColumn("_mean", filler)
    filled = F.when(F.col("embedding").isNull(), F.col("_mean")).otherwise(
        F.zip_with("embedding", "_mean", lambda x, m: F.coalesce(x, m))
    )
    return spine.select(EVENT, filled.alias("embedding"))


def fit_mode(steps: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Most frequent value (0 or 1, smallest on ties) of each feature over steps.

    A 0/1 column has mode 1 only where more than half of the steps hold the feature.
    """
    total = steps.agg(F.count(F.lit(1))).scalar()
    counts = steps.select(F.explode("features").alias("feature")).groupBy("feature").agg(
        F.count(F.lit(1)).alias("_n")
    )
    present = F.coalesce("_n", F.lit(0))
    return vocabulary.select("feature", "position").join(counts, "feature", "left").select(
        "feature", "position", (present * 2 > total).cast("int").alias("mode")
    )


def impute_sessions(timeline: DataFrame, steps: DataFrame, modes: DataFrame) -> DataFrame:
    """Every event with at least one step; an event without any gets the features whose mode is 1.

    A missing event number becomes 1.
    """
    usual = modes.where(F.col("mode") == 1).agg(
        F.array_sort(F.collect_list(F.struct("position", "feature"))).alias("_u")
    )
    spine = event_spine(timeline, steps)
    names = usual.select(F.col("_u.feature")).scalar()
    places = usual.select(F.col("_u.position")).scalar()
    return (
        spine.withColumn("features", F.coalesce("features", names))
        .withColumn("positions", F.coalesce("positions", places))
        .withColumn("event_number", F.coalesce("event_number", F.lit(1)))
    )


# --- generator -----------------------------------------------------------------------------
# A ridge regression fitted on events that have both modalities. Its sufficient statistics X'X and
# X'Y are sums over events; only they, whose size depends on the numbers of columns alone, meet in one
# task.


MOMENTS = T.StructType([T.StructField("row", T.IntegerType()), T.StructField("sums", T.ArrayType(T.DoubleType()))])


def generator_moments(pairs: DataFrame) -> DataFrame:
    """Rows of ``[X'X | X'Y]`` for ``pairs(x, y)``, the last column of X being the constant 1.

    Each of at most SUMMERS tasks adds up its own batches and sends one matrix on, so what is shuffled does
    not grow with the input.
    """

    def partial(batches):
        total = None
        for batch in batches:
            if not len(batch):
                continue
            x = stacked(batch["x"])
            x = np.hstack([x, np.ones((len(x), 1))])
            part = x.T @ np.hstack([x, stacked(batch["y"])])
            total = part if total is None else total + part
        if total is not None:
            yield pd.DataFrame({"row": np.arange(len(total)), "sums": list(total)})

    partials = pairs.select("x", "y").coalesce(SUMMERS).mapInPandas(partial, MOMENTS)
    total = vector_to_array(Summarizer.sum(array_to_vector("sums")))
    return partials.groupBy("row").agg(total.alias("sums"))


COEFFICIENTS = T.StructType([
    T.StructField("row", T.IntegerType()),
    T.StructField("coefficients", T.ArrayType(T.DoubleType())),
])


def fit_generator(pairs: DataFrame, ridge: float = 1.0) -> DataFrame:
    """Fitted state of a generator: ``row, coefficients``, the last row being the intercept.

    One task solves the summed system, whose size does not grow with the events; the intercept is
    not shrunk.
    """

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        moments = stacked(rows.sort_values("row")["sums"])
        height = len(moments)
        penalty = ridge * np.eye(height)
        penalty[-1, -1] = 0.0
        solved = np.linalg.solve(moments[:, :height] + penalty, moments[:, height:])
        return pd.DataFrame({"row": np.arange(height), "coefficients": list(solved)})

    return generator_moments(pairs).groupBy().applyInPandas(solve, COEFFICIENTS)


def generator_matrix(fitted: DataFrame) -> np.ndarray:
    return stacked(fitted.orderBy("row").toPandas()["coefficients"])


def apply_generator(matrix: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.hstack([x, np.ones((len(x), 1))]) @ matrix


def generate(rows: DataFrame, fitted: DataFrame, keys: list[str]) -> DataFrame:
    """Predicted ``y`` of each row's ``x``; the coefficients travel to each executor once."""
    shared = rows.sparkSession.sparkContext.broadcast(generator_matrix(fitted))
    schema = T.StructType([*[rows.schema[k] for k in keys], T.StructField("y", T.ArrayType(T.DoubleType()))])

    def predict(batches):
        for batch in batches:
            if len(batch):
                yield batch[keys].assign(y=list(apply_generator(shared.value, stacked(batch["x"]))))

    return rows.select(*keys, "x").mapInPandas(predict, schema)


def step_place(age: Column) -> Column:
    """Where a step stands, as one number: 1 for the last step, then 1/2, 1/3 and so on."""
    return F.lit(1.0) / (age + F.lit(1))


def step_pairs(events: DataFrame, steps: DataFrame, width: int) -> DataFrame:
    """All steps of ``events(event, x)``, one row each: ``x`` with the step's place added, ``y`` its 0/1 features."""
    aged = with_ages(steps, ["session_id"])
    rows = events.join(aged, EVENT)
    x = F.concat(F.col("x").cast("array<double>"), F.array(step_place(F.col("age"))))
    return rows.select(EVENT, "age", x.alias("x"), dense_ones(F.col("positions"), width).alias("y"))


def length_pairs(events: DataFrame, steps: DataFrame) -> DataFrame:
    """Events with their number of steps as ``y``."""
    counts = steps.groupBy(EVENT).agg(F.count(F.lit(1)).cast("double").alias("_n"))
    return events.join(counts, EVENT).select(EVENT, "x", F.array("_n").alias("y"))


def dense_ones(positions: Column, width: int) -> Column:
    """0/1 array with ones at ``positions``."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def scatter(series: pd.Series) -> pd.Series:
        return pd.Series(list(scattered(series, width)))

    return scatter(positions)


def fit_discriminant(pairs: DataFrame, ridge: float = 1.0) -> DataFrame:
    """Log-odds of each 0/1 target: ``row, coefficients`` as in ``fit_generator``.

    A linear discriminant from the same sums: the means of the rows with and without a feature, one
    covariance within both, and the share of rows with it. A feature of all rows, or of none, gets
    log-odds that don't depend on ``x``.
    """

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        moments = stacked(rows.sort_values("row")["sums"])
        inputs = len(moments) - 1
        square, sums, n = moments[:inputs, :inputs], moments[:inputs, inputs], moments[inputs, inputs]
        with_it, count = moments[:inputs, inputs + 1 :], moments[inputs, inputs + 1 :]
        found = np.zeros((inputs + 1, len(count)))
        for j, ones in enumerate(count):
            zeros = n - ones
            prior = np.log((ones + 0.5) / (zeros + 0.5))
            if not ones or not zeros:
                found[inputs, j] = prior
                continue
            mean_1, mean_0 = with_it[:, j] / ones, (sums - with_it[:, j]) / zeros
            within = square - ones * np.outer(mean_1, mean_1) - zeros * np.outer(mean_0, mean_0)
            slope = np.linalg.solve((within + ridge * np.eye(inputs)) / n, mean_1 - mean_0)
            found[:inputs, j] = slope
            found[inputs, j] = prior - slope @ (mean_1 + mean_0) / 2
        return pd.DataFrame({"row": np.arange(inputs + 1), "coefficients": list(found)})

    return generator_moments(pairs).groupBy().applyInPandas(solve, COEFFICIENTS)


def generate_steps(
    events: DataFrame, features: DataFrame, lengths: DataFrame, longest: int, vocabulary: DataFrame
) -> DataFrame:
    """Sessions of ``events(event, x)``: as many steps as the fitted length says, each with the features
    whose fitted probability is at least one half.

    ``features`` is fitted on step pairs, ``lengths`` on length pairs; a length is rounded and lies
    between 1 and ``longest``, the longest event of the fit.
    """
    told = generate(events, lengths, [EVENT])
    n = F.least(F.greatest(F.round(F.col("y")[0]).cast("int"), F.lit(1)), F.lit(longest))
    ages = told.select(EVENT, F.explode(F.sequence(F.lit(0), n - 1)).alias("age"))
    x = F.concat(F.col("x").cast("array<double>"), F.array(step_place(F.col("age"))))
    odds = generate(events.join(ages, EVENT).select(EVENT, "age", x.alias("x")), features, [EVENT, "age"])
    return generated_steps(odds.select(EVENT, "age", F.transform("y", lambda v: 1 / (1 + F.exp(-v))).alias("y")), vocabulary)


def generated_steps(generated: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Sessions read off probabilities ``y`` by event and ``age``: a feature is on from 0.5, steps without
    one are dropped and the others renumbered from the earliest. An event whose steps are all empty
    keeps no step."""
    on = F.filter(
        F.transform("y", lambda v, i: F.when(v >= 0.5, i)), lambda i: i.isNotNull()
    )
    hits = generated.select(EVENT, "age", F.explode(on).alias("position"))
    rows = hits.join(vocabulary.select("position", "feature"), "position")
    packed = rows.groupBy(EVENT, "age").agg(
        F.array_sort(F.collect_list(F.struct("position", "feature"))).alias("_f")
    )
    order = F.row_number().over(Window.partitionBy(EVENT).orderBy(F.col("age").desc()))
    return packed.select(
        EVENT,
        order.alias("event_number"),
        F.col("_f.feature").alias("features"),
        F.col("_f.position").alias("positions"),
    )
