"""Independent item scores: multi-label ridge regression from moments, solved by blocks of items.

For event vectors x (with a constant 1 added), weights w and targets t the coefficients of item i solve

    (X'WX + ridge I) b_i = X'W t_i,

the constant not being shrunk. X'WX is the same for all items and is summed once. X'W t_i of a bought item
is the sum of w x over its buyers, so no row is made for a pair of an event and an item that was not
bought. Items are dealt to blocks by their hash; each block solves its own items in a task of its own, and
scores meet events block by block. Neither items nor coefficients pass through the driver, and any
catalogue will do.

Several runs (weights) share one reading: ``w`` is an array with a weight for each run.

Soft targets of teachers need no pairs either. With linear teachers z_i = X1 c_i, X'W z_i is
(X'W X1) c_i: one cross moment of the student's and the teacher's vectors serves all items.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.functions.batches import stacked
from tallyweave.functions.products import add_products, listed, slices
from tallyweave.functions.products import vectors as read_vectors
from tallyweave.schemas import EVENT
from tallyweave.state import stage

RIDGE = 1.0
#: Items of a block, on average.
ITEMS = 512
#: Events that meet a block of items in one task, on average.
EVENTS = 1024
#: Tasks that sum the square moments: each sends one matrix on, whatever it has read.
SUMMERS = 512


def weighted(events: DataFrame, weights: Sequence[DataFrame | None]) -> DataFrame:
    """Events with ``w``: the weight of each run in order, 0 where a run has none for the event.

    A run's weights are a table (event, ``weight``), or None for 1 throughout.
    """
    rows = events.select(EVENT).distinct()
    for r, table in enumerate(weights):
        if table is not None:
            rows = rows.join(table.select(EVENT, F.col("weight").cast("double").alias(f"_w{r}")), EVENT, "left")
    each = [F.lit(1.0) if t is None else F.coalesce(f"_w{r}", F.lit(0.0)) for r, t in enumerate(weights)]
    return rows.select(EVENT, F.array(*each).alias("w"))


SUMS = pa.schema([("run", pa.int32()), ("row", pa.int32()), ("sums", pa.list_(pa.float64()))])


def _matrix_sum(pairs: DataFrame, runs: int) -> DataFrame:
    """``run``, ``row`` and ``sums``: the rows of the sum of w x y' over ``pairs(x, y, w)``; ``y`` may be absent.

    ``x`` and ``y`` are ML vectors, which get the constant added, or arrays.
    """
    own = "y" not in pairs.columns

    def partial(batches):
        totals = None
        for batch in batches:
            if not batch.num_rows:
                continue
            x = read_vectors(batch.column("x"))
            y = None if own else read_vectors(batch.column("y"))
            if totals is None:
                totals = np.zeros((runs, x.width, x.width if own else y.width))
            add_products(totals, x, y, listed(batch.column("w")))
        if totals is not None:
            for r, total in enumerate(totals):
                ends = np.arange(len(total) + 1, dtype=np.int32) * total.shape[1]
                sums = pa.ListArray.from_arrays(pa.array(ends), pa.array(total.ravel()))
                row = np.arange(len(total), dtype=np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(total), r, np.int32)), pa.array(row), sums], schema=SUMS)

    partials = pairs.coalesce(SUMMERS).mapInArrow(partial, "run int, row int, sums array<double>")
    return partials.groupBy("run", "row").agg(vector_to_array(Summarizer.sum(array_to_vector("sums"))).alias("sums"))


def by_event(vectors: DataFrame) -> DataFrame:
    """Vectors that meet another table of events by shuffle, never by broadcast: stored vectors take a small
    share of their size in memory, and Spark would judge them by their files."""
    return vectors.hint("merge")


def _with_weights(rows: DataFrame, weights: DataFrame | None, runs: int) -> DataFrame:
    """Rows with ``w``; without a table of weights every event weighs 1 in each run, and nothing is joined."""
    if weights is None:
        return rows.where(F.col(EVENT).isNotNull()).withColumn("w", F.array(*[F.lit(1.0)] * runs))
    return by_event(rows).join(weights, EVENT)


def square_moments(vectors: DataFrame, weights: DataFrame | None, runs: int) -> DataFrame:
    """X'WX of every run, the constant last."""
    rows = _with_weights(vectors, weights, runs)
    return _matrix_sum(rows.select(F.col("vector").alias("x"), "w"), runs)


def cross_moments(vectors: DataFrame, others: DataFrame, weights: DataFrame, runs: int) -> DataFrame:
    """X'W X1 of every run for the events that both tables hold, the constants last."""
    rows = by_event(by_event(vectors).join(others.select(EVENT, F.col("vector").alias("y")), EVENT)).join(weights, EVENT)
    return _matrix_sum(rows.select(F.col("vector").alias("x"), "y", "w"), runs)


def label_moments(vectors: DataFrame, labels: DataFrame, weights: DataFrame | None, runs: int) -> DataFrame:
    """``run``, ``item_id`` and ``sums``, the sum of w x over the events that bought the item, the constant last.

    Sums combine before the shuffle, so an item that everyone buys is no hot key. A run may give all buyers
    of an item the weight 0, which the summarizer would refuse; it gets a weight that changes no sum.
    """
    rows = _with_weights(labels.select(EVENT, "item_id").distinct().join(by_event(vectors), EVENT), weights, runs)
    sums = [
        F.concat(
            vector_to_array(Summarizer.sum(F.col("vector"), F.greatest(F.col("w")[r], F.lit(1e-300)))), F.array(F.sum(F.col("w")[r]))
        ).alias(f"_s{r}")
        for r in range(runs)
    ]
    summed = rows.groupBy("item_id").agg(*sums)
    listed = F.posexplode(F.array(*[f"_s{r}" for r in range(runs)]))
    return summed.select("item_id", listed.alias("run", "sums"))


@dataclass(frozen=True)
class Scorer:
    """Fitted state: ``coefficients`` has ``run``, ``item_id``, ``block`` and ``coefficients`` (the constant last)."""

    coefficients: DataFrame
    blocks: int
    runs: int


def item_block(blocks: int) -> Column:
    return F.pmod(F.xxhash64("item_id"), F.lit(blocks)).cast("int")


def _per_block(matrix: DataFrame, blocks: int, kind: str) -> DataFrame:
    """The rows of a matrix of each run, once for every block, marked with ``kind``."""
    spread = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
    return matrix.select("run", spread, F.lit(kind).alias("kind"), F.col("row").cast("long").alias("row"), "sums")


def solve(
    squares: DataFrame,
    right: DataFrame,
    runs: int,
    ridge: float = RIDGE,
    items_per_block: int = ITEMS,
    teachers: Sequence[tuple[DataFrame, Scorer, float]] = (),
) -> Scorer:
    """Coefficients of every item of ``right`` (as ``label_moments`` gives it) and run.

    ``teachers`` are (cross moments, fitted teacher, factor): their linear scores are added to the targets
    with that factor, and the items are those that every teacher knows, bought or not. The right-hand sides
    of a block and the matrices of a run meet in one task; its size depends on the width of the vectors
    and on ``items_per_block``.
    """
    right = stage(right, "label-moments")
    known = [teacher.coefficients.select("item_id").distinct() for _, teacher, _ in teachers]
    items = known[0] if known else right.select("item_id").distinct()
    for others in known[1:]:
        items = items.join(others, "item_id", "left_semi")
    items = stage(items, "fitted-items")
    blocks = max(1, -(-items.count() // items_per_block))
    numbers = F.explode(F.sequence(F.lit(0), F.lit(runs - 1))).alias("run")
    sides = [items.select("item_id", numbers, item_block(blocks).alias("block"), F.lit("item").alias("kind"), F.lit(None).cast("array<double>").alias("sums"))]
    named = right.join(items, "item_id", "left_semi")
    sides.append(named.select("item_id", "run", item_block(blocks).alias("block"), F.lit("bought").alias("kind"), "sums"))
    matrices = [_per_block(squares, blocks, "square")]
    for n, (cross, teacher, _) in enumerate(teachers):
        matrices.append(_per_block(cross, blocks, f"cross{n}"))
        told = teacher.coefficients.join(items, "item_id", "left_semi")
        sides.append(told.select("item_id", "run", item_block(blocks).alias("block"), F.lit(f"teacher{n}").alias("kind"), F.col("coefficients").alias("sums")))
    left, rights = matrices[0], sides[0]
    for more in matrices[1:]:
        left = left.unionByName(more)
    for more in sides[1:]:
        rights = rights.unionByName(more)
    factors = [float(factor) for _, _, factor in teachers]

    def work(key, matrix: pd.DataFrame, given: pd.DataFrame) -> pd.DataFrame:
        if not len(matrix) or not len(given):
            return pd.DataFrame(columns=["item_id", "coefficients", "run", "block"])
        of = {kind: stacked(rows.sort_values("row")["sums"]) for kind, rows in matrix.groupby("kind")}
        square = of["square"]
        names = sorted(given["item_id"].unique())
        place = {name: i for i, name in enumerate(names)}
        side = np.zeros((len(square), len(names)))

        def columns(kind: str, height: int) -> np.ndarray:
            rows = given[given["kind"] == kind]
            out = np.zeros((height, len(names)))
            if len(rows):
                out[:, [place[i] for i in rows["item_id"]]] = stacked(rows["sums"]).T
            return out

        side += columns("bought", len(square))
        for n, factor in enumerate(factors):
            if f"cross{n}" in of:
                side += factor * of[f"cross{n}"] @ columns(f"teacher{n}", of[f"cross{n}"].shape[1])
        penalty = ridge * np.eye(len(square))
        penalty[-1, -1] = 1e-9
        found = np.linalg.solve(square + penalty, side)
        return pd.DataFrame({"item_id": names, "coefficients": list(found.T), "run": key[0], "block": key[1]})

    schema = "item_id string, coefficients array<double>, run int, block int"
    solved = left.groupBy("run", "block").cogroup(rights.groupBy("run", "block")).applyInPandas(work, schema)
    return Scorer(stage(solved, "coefficients"), blocks, runs)


def fit(
    vectors: DataFrame,
    labels: DataFrame,
    weights: Sequence[DataFrame | None] = (None,),
    ridge: float = RIDGE,
    items_per_block: int = ITEMS,
) -> Scorer:
    """One scorer for each run's weights, all from one reading of ``vectors(event, vector)``.

    Run r of the result (from 0) equals a fit with ``weights[r]`` alone. Events without a vector take no
    part; an event without a label counts as one that bought nothing.
    """
    w = stage(weighted(vectors, weights), "run-weights") if any(table is not None for table in weights) else None
    runs = len(weights)
    return solve(square_moments(vectors, w, runs), label_moments(vectors, labels, w, runs), runs, ridge, items_per_block)


def linear(score: np.ndarray) -> np.ndarray:
    return score


def rising(score: np.ndarray) -> np.ndarray:
    """The linear score on (0, 1), order kept: the logistic curve that touches it at one half."""
    return 1 / (1 + np.exp(-4 * (np.clip(score, -20, 20) - 0.5)))


SCORES = pa.schema([("run", pa.int32()), (EVENT, pa.int64()), ("item_id", pa.string()), ("score", pa.float64())])


def score(
    scorer: Scorer, features: DataFrame, wanted: DataFrame, runs: Sequence[int], link=rising, events_per_task: int = EVENTS
) -> DataFrame:
    """``run``, event, item and ``score`` of the pairs in ``wanted(event, item)``; ``runs`` names the scorer's runs in order.

    Pairs of an event without a vector, or of an item that the scorer does not know, have no row. A block of
    items meets a group of its events in one task, and only then the pairs that are wanted are written.
    """
    known = scorer.coefficients.select("item_id").distinct()
    pairs = wanted.select(EVENT, "item_id").distinct().join(known, "item_id", "left_semi")
    asked = pairs.groupBy(EVENT, item_block(scorer.blocks).alias("block")).agg(F.collect_set("item_id").alias("items"))
    groups = max(1, -(-features.count() // events_per_task))
    group = F.pmod(F.xxhash64(F.lit(7), EVENT), F.lit(groups)).cast("int").alias("group")
    left = asked.join(by_event(features.select(EVENT, F.col("vector").alias("x"))), EVENT).withColumn("group", group)
    spread = F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group")
    right = scorer.coefficients.select("run", "item_id", "block", "coefficients", spread)
    names = list(runs)

    def work(events: pa.Table, coefficients: pa.Table) -> pa.Table:
        out = []
        if events.num_rows and coefficients.num_rows:
            x, ids = read_vectors(events["x"]), events[EVENT].to_numpy()
            factors, run = listed(coefficients["coefficients"]), coefficients["run"].to_numpy()
            items = pd.Index(coefficients["item_id"].to_pandas())
            lists = events["items"].combine_chunks()
            wanted, ends = lists.flatten().to_pandas().to_numpy(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
            of = [(names[r], items[run == r], factors[run == r]) for r in np.unique(run)]
            for start, stop in slices(len(x)):
                place = np.repeat(np.arange(stop - start), np.diff(ends[start : stop + 1]))
                dense, asking = x.part(start, stop).matrix(), wanted[ends[start] : ends[stop]]
                for name, known, factor in of:
                    at = known.get_indexer(asking)
                    got = at >= 0
                    found = link((dense @ factor.T)[place[got], at[got]])
                    out.append(pa.table([np.full(len(found), name, np.int32), ids[start:stop][place[got]], pa.array(asking[got], pa.string()), found], schema=SCORES))
        return pa.concat_tables(out) if out else SCORES.empty_table()

    schema = f"run int, {EVENT} long, item_id string, score double"
    return left.groupBy("block", "group").cogroup(right.groupBy("block", "group")).applyInArrow(work, schema)
