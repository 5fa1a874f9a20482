"""Nearest reference events by an inverted file of cells, and what they lack in one modality read off them.

References lie in the cell of their nearest centre; centres come from a bounded sample, every reference gets
a cell. A question first visits its nearest cell, where its k-th best distance bounds what it still needs;
then it visits each other cell that may hold anything nearer by the triangle inequality. What a question visits
is joined with the blocks of those cells, so questions and references never meet as pairs, and each visit
hands on its k best. Inside a visit single precision, with a bound of its error, leaves out what cannot be among
them; the others are compared in double precision. The result is exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyweave.functions.products import Rows, slices
from tallyweave.functions.products import vectors as read_vectors
from tallyweave.schemas import EVENT
from tallyweave.state import stage

#: References of a cell and of a block, and questions that meet a block in one task, on average.
CELL, GROUP = 8192, 8192
#: Questions of a task that are compared with its block at once.
AT_ONCE = 128
#: At most so many centres, fitted on so many references each.
CENTRES, SAMPLE = 1024, 64
ROUNDS = 8
#: References of which one largest number is taken: the k-th of these numbers is no more than the k-th of all.
STRIPE = 64
#: Questions meet a block by their filled places alone where at most one place in so many is filled.
SPARSE = 8
#: A block is compared in double precision whole where more than one pair in so many is left.
LEFT = 8
#: Places of a cosine, and the distance that they may hide between vectors of length 1.
DIGITS, SLACK = 9, 1e-4


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum(0, (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * a @ b.T)


def _unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length 1; a zero row stays."""
    lengths = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, lengths, out=np.zeros_like(rows), where=lengths > 0)


def _means(rows: np.ndarray, count: int) -> np.ndarray:
    centres = rows[:count].copy()
    for _ in range(ROUNDS):
        near = _squares(rows, centres).argmin(axis=1)
        held = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, rows)
        centres = sums[held > 0] / held[held > 0, None]
    return centres


def centres(references: DataFrame) -> np.ndarray | None:
    """Centres from a sample of about ``CENTRES * SAMPLE`` references at the most, drawn by a hash of the event."""
    n = references.count()
    if not n:
        return None
    wanted = max(1, min(CENTRES, n // CELL))
    share = min(1.0, wanted * SAMPLE / n)
    drawn = references.where(F.pmod(F.xxhash64(F.lit(5), EVENT), F.lit(1 << 30)) < int(share * (1 << 30)) + 1)
    rows = drawn.select("x").orderBy(F.xxhash64(F.lit(6), EVENT)).toArrow()
    return _means(_unit(read_vectors(rows["x"], constant=False).matrix()), wanted) if rows.num_rows else None


def _units(column):
    """Unit vectors of an Arrow column, a slice at a time."""
    held = read_vectors(column, constant=False)
    for start, stop in slices(len(held)):
        yield _unit(held.part(start, stop).matrix())


def _placed(references: DataFrame, middle) -> DataFrame:
    """References with their ``cell`` and their distance from its centre."""

    def work(batches):
        for batch in batches:
            if batch.num_rows:
                far = [_squares(x, middle.value) for x in _units(batch.column("x"))]
                cell, away = [np.concatenate([f(one) for one in far]) for f in (lambda one: one.argmin(axis=1), lambda one: np.sqrt(one.min(axis=1)))]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(away)], [EVENT, "x", "cell", "away"])

    schema = T.StructType([*references.select(EVENT, "x").schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("away", T.DoubleType())])
    return references.select(EVENT, "x").mapInArrow(work, schema)


def _visits(questions: DataFrame, middle, cells) -> DataFrame:
    """The blocks that a question visits: those of its nearest cell, or of each that may hold a reference within ``reach``.

    Python lists the blocks of a question; its row is repeated for each of them by Spark alone. Where ``seen``
    names a block, the cell of that block has been visited and is left out.
    """
    again = "seen" in questions.columns

    def work(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            held, least, most, first = cells.value
            reaches, start = batch.column("reach").to_numpy(), 0
            seen = np.searchsorted(first, batch.column("seen").to_numpy(), side="right") - 1 if again else None
            counts, found = [], []
            for x in _units(batch.column("x")):
                far = np.sqrt(_squares(x, middle.value))
                far[:, held == 0] = np.inf
                reach, begin = reaches[start : start + len(x), None], start
                start += len(x)
                with np.errstate(invalid="ignore"):
                    wanted = np.maximum(far - most, least - far) <= reach + SLACK
                new = np.flatnonzero(np.isnan(reach[:, 0]))
                wanted[new, far[new].argmin(axis=1)] = True
                if again:
                    wanted[np.arange(len(x)), seen[begin:start]] = False
                blocks = np.repeat(wanted & (held > 0), np.diff(first).astype(int), axis=1)
                counts.append(blocks.sum(axis=1))
                found.append(np.nonzero(blocks)[1])
            ends = np.concatenate([[0], np.cumsum(np.concatenate(counts))]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("question"), batch.column("x"), batch.column("reach"), lists], ["question", "x", "reach", "blocks"])

    rows = questions.select("question", "x", "reach", *(["seen"] if again else []))
    schema = T.StructType([*rows.schema.fields[:3], T.StructField("blocks", T.ArrayType(T.IntegerType()))])
    return rows.mapInArrow(work, schema)


def _best(near: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the k largest numbers of each row, of equal ones the first."""
    if near.shape[1] <= k:
        return tuple(i.ravel() for i in np.indices(near.shape))
    least = np.partition(near, -k, axis=1)[:, -k, None]
    above, even = near > least, near == least
    spare = k - above.sum(axis=1, keepdims=True)
    return np.nonzero(above | (even & (even.cumsum(axis=1) <= spare)))


def _first(row: np.ndarray, column: np.ndarray, near: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row the k largest numbers, of equal ones those of the first columns."""
    order = np.lexsort((column, -near, row))
    row, column, near = row[order], column[order], near[order]
    kept = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[kept], column[kept], near[kept]


class _Block:
    """The references of a block, in the order of their events, met by a few questions at a time."""

    def __init__(self, there: np.ndarray):
        self.there = there
        self.single = np.ascontiguousarray(there.T, dtype=np.float32)
        # products of unit vectors in single precision, the rounded inputs and sums included
        self.slack = (there.shape[1] + 8) * 2.0**-23 + 10.0**-DIGITS * 4
        self.numbers = bool(np.isfinite(there).all())

    def best(self, asking: Rows, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, column and cosine of the ``k`` nearest to each question; numbers below ``least`` are of no use and may be missing."""
        part, count = _unit(asking.matrix()), len(self.there)
        stripes = count // STRIPE
        if stripes >= k and self.numbers:
            few = len(asking.at) * SPARSE <= len(asking) * asking.width
            filled = [np.flatnonzero(x) for x in part] if few else None
            near = np.stack([x[at].astype(np.float32) @ self.single[at] for x, at in zip(part, filled, strict=True)]) if few else part.astype(np.float32) @ self.single
            tops = near[:, : stripes * STRIPE].reshape(len(near), STRIPE, stripes).max(axis=1)
            bound = np.maximum(np.partition(tops, -k, axis=1)[:, -k], least) - self.slack
            row, column = np.divmod(np.flatnonzero(near >= bound[:, None].astype(np.float32)), count)
            if len(row) * LEFT <= near.size:
                return _first(row, column, np.round(self._exact(part, row, column, filled), DIGITS) + 0.0, k)
        # rounded, so that equal angles tie however their last digits came about
        near = np.round(part @ self.there.T, DIGITS) + 0.0
        row, column = _best(near, k)
        return row, column, near[row, column]

    def _exact(self, part: np.ndarray, row: np.ndarray, column: np.ndarray, filled: list[np.ndarray] | None) -> np.ndarray:
        """Products of the pairs, which are in order of their rows."""
        if filled is None:
            cuts = range(0, len(row), AT_ONCE * 32)
            return np.concatenate([np.zeros(0), *[np.einsum("ij,ij->i", part[row[c : c + AT_ONCE * 32]], self.there[column[c : c + AT_ONCE * 32]]) for c in cuts]])
        ends = np.searchsorted(row, np.arange(len(part) + 1))
        return np.concatenate([self.there[np.ix_(column[a:b], at)] @ x[at] for x, at, a, b in zip(part, filled, ends, ends[1:], strict=False)])


FOUND = pa.schema([("question", pa.int64()), (EVENT, pa.int64()), ("cosine", pa.float64())])


def _met(asked: DataFrame, placed: DataFrame, k: int) -> DataFrame:
    """``question``, event and ``cosine``: of each visited block the k nearest to each question.

    ``asked`` are stored visits. What lies beyond a question's ``reach`` may be missing.
    """
    # the cosine at the reach; with none, or an endless one, everything counts
    least = F.when(F.col("reach") < 3, 1 - F.col("reach") * F.col("reach") / 2).otherwise(-2.0)
    each = asked.select("question", "x", least.alias("least"), F.explode("blocks").alias("block"))
    demand = each.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / GROUP).cast("int").alias("groups"))
    # a number for each block, whatever the questions
    demand = F.broadcast(stage(demand, "neighbour-demand"))
    keys = ["block", "group"]
    left = each.join(demand, "block").withColumn("group", F.pmod(F.xxhash64("question"), F.col("groups")).cast("int")).drop("groups")
    right = placed.join(demand, "block").withColumn("group", F.explode(F.sequence(F.lit(0), F.col("groups") - 1))).drop("groups")

    def work(asking: pa.Table, held: pa.Table) -> pa.Table:
        if not asking.num_rows or not held.num_rows:
            return FOUND.empty_table()
        held = held.sort_by(EVENT)
        block, ids = _Block(_unit(read_vectors(held["x"], constant=False).matrix())), held[EVENT].to_numpy()
        here, names, least = read_vectors(asking["x"], constant=False), asking["question"].to_numpy(), asking["least"].to_numpy()
        out = []
        for start in range(0, len(here), AT_ONCE):
            stop = min(len(here), start + AT_ONCE)
            row, column, near = block.best(here.part(start, stop), least[start:stop], k)
            out.append(pa.table([names[start + row], ids[column], near], schema=FOUND))
        return pa.concat_tables(out)

    schema = f"question long, {EVENT} long, cosine double"
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(work, schema)


def nearest(questions: DataFrame, references: DataFrame, k: int) -> DataFrame:
    """``question``, ``rank`` (from 1), event and ``cosine`` of the k references with the largest cosine.

    Both tables hold an event and ``x``, arrays or ML vectors of one length; a question's event becomes
    ``question``. Cosines are rounded to DIGITS places, ties go to the smaller event. A zero vector has
    cosine 0 with everything. With fewer references all are returned.
    """
    spark = questions.sparkSession
    schema = f"question long, rank int, {EVENT} long, cosine double"
    found = centres(references)
    if found is None:
        return spark.createDataFrame([], schema)
    middle = spark.sparkContext.broadcast(found)
    placed = stage(_placed(references, middle), "neighbour-cells")
    counted = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("held"), F.min("away").alias("least"), F.max("away").alias("most"))
    held, least, most = np.zeros((3, len(found)))
    for row in counted.collect():  # a row for each centre, CENTRES at most
        held[row["cell"]], least[row["cell"]], most[row["cell"]] = row["held"], row["least"], row["most"]
    # blocks are numbered through all cells
    parts = -(-held // CELL)
    first = np.concatenate([[0], np.cumsum(parts)]).astype(int)
    cells = spark.sparkContext.broadcast((held, least, most, first))
    numbers, sizes = F.array(*[F.lit(int(n)) for n in first]), F.array(*[F.lit(int(n)) for n in parts])
    block = F.get(numbers, F.col("cell")) + F.pmod(F.xxhash64(EVENT), F.get(sizes, F.col("cell"))).cast("int")
    blocks = placed.select(EVENT, "x", block.alias("block"))
    asked = questions.select(F.col(EVENT).alias("question"), "x")
    order = Window.partitionBy("question").orderBy(F.col("cosine").desc(), EVENT)
    visits = stage(_visits(asked.withColumn("reach", F.lit(float("nan"))), middle, cells), "neighbour-visits")
    first_near = _met(visits, blocks, k).withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k)
    near = stage(first_near, "neighbours-at-home")
    best = near.where(F.col("_n") == k).select("question", F.sqrt(2 - 2 * F.col("cosine")).alias("reach"))
    second = visits.select("question", "x", F.coalesce(F.get("blocks", F.lit(0)), F.lit(0)).alias("seen")).join(best.hint("merge"), "question", "left")
    second = second.withColumn("reach", F.coalesce("reach", F.lit(float("inf"))))
    others = _met(stage(_visits(second, middle, cells), "neighbour-visits"), blocks, k)
    ranked = near.drop("_n").unionByName(others).withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= k).select("question", "rank", EVENT, "cosine")


def imputed_embeddings(neighbours: DataFrame, references: DataFrame) -> DataFrame:
    """Event and ``embedding``: the mean of the ``embedding`` of the neighbours of each question, position by
    position without nulls. A question has the rows of its k neighbours alone."""
    met = neighbours.join(references.select(EVENT, "embedding"), EVENT)
    gathered = met.groupBy("question").agg(F.array_sort(F.collect_list(F.struct("rank", "embedding"))).alias("_e"))

    def mean(_, i):
        there = F.filter(F.transform("_e", lambda e: F.get(e["embedding"], i).cast("double")), lambda x: x.isNotNull())
        return F.try_divide(F.aggregate(there, F.lit(0.0), lambda a, x: a + x), F.size(there))

    return gathered.select(F.col("question").alias(EVENT), F.transform(F.get("_e", F.lit(0))["embedding"], mean).alias("embedding"))


def imputed_steps(neighbours: DataFrame, aged: DataFrame) -> DataFrame:
    """Sessions of the questions: of each age the features that at least half of the neighbours have there;
    steps without one are dropped, the others numbered from the earliest.

    ``aged`` has the references' steps: event, ``age``, ``features``, ``positions``. Each question has the
    rows of its k neighbours alone.
    """
    counts = neighbours.groupBy("question").agg(F.count(F.lit(1)).alias("_k"))
    hits = neighbours.join(aged, EVENT).select("question", "age", F.explode(F.arrays_zip("positions", "features")).alias("_f"))
    shared = hits.groupBy("question", "age", "_f.positions", "_f.features").agg(F.count(F.lit(1)).alias("_n")).join(counts, "question")
    kept = shared.where(F.col("_n") * 2 >= F.col("_k"))
    packed = kept.groupBy("question", "age").agg(F.array_sort(F.collect_list(F.struct("positions", "features"))).alias("_f"))
    order = F.row_number().over(Window.partitionBy("question").orderBy(F.col("age").desc()))
    return packed.select(F.col("question").alias(EVENT), order.alias("event_number"), F.col("_f.features").alias("features"), F.col("_f.positions").alias("positions"))
