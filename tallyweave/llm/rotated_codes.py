"""Nearest neighbours by randomly rotated one-bit codes, with error bounds that choose what is ranked exactly.

A vector x lies in the cell of its nearest centre c; centres come from a bounded sample, every vector gets
a cell. With a random rotation P, o = P'(x - c) / |x - c| is stored as the signs of its numbers, packed to
bits, and two correction scalars: |x - c| and f = <signs / sqrt(D), o>. For a query q and u = P'(q - c),
<signs / sqrt(D), u> / f estimates <o, u>; as the rotation is random, the estimate is off by more than

    SPREAD * |u| * sqrt(1 - f^2) / (f * sqrt(D - 1))

in about one pair of 80 at a SPREAD of 2.5, and then only matters for a pair near the edge. The product
with the signs is made of bits alone: u is rounded to eight bits, and each of its bit planes meets the
codes by an AND and a count of bits. What rounding adds is bounded for sure and added to the bound.

A search has two rounds. In the first a query visits its nearest cells, and the true distances of the best
estimates there give a distance within which k neighbours lie for sure. In the second it visits each cell
that may hold vectors within that distance (by the triangle inequality); every vector whose bound reaches
into it is compared in double precision, and what lies within it goes on to the ranking. No list is capped.

Equal vectors are one row with their least ids, so a vector of any number of copies costs one code. A cell
is dealt to blocks of about BLOCK codes, a block's queries to groups of about GROUP, so no task holds a
whole cell.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.state import stage

BLOCK = 4096
GROUP = 512
SPREAD = 2.5
PLANES = 8


@dataclass(frozen=True)
class Fit:
    """What the centres are fitted on: ``per_centre`` sampled vectors for each of ``centres`` at the most.

    Up to that bound there is a centre for each BLOCK vectors.
    """

    centres: int = 1024
    per_centre: int = 64
    rounds: int = 8


def usable(vector: str = "embedding") -> Column:
    """The vector is there, all its numbers are finite, and one is not zero."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce(v.isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def distance(a: Column, b: Column) -> Column:
    """Euclidean distance in double precision, summed from the first number to the last."""
    square = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.sqrt(F.aggregate(square, F.lit(0.0), lambda total, x: total + x))


# --- codes -----------------------------------------------------------------------------------


_ROTATIONS: dict[int, np.ndarray] = {}


def rotation(size: int) -> np.ndarray:
    """A random rotation of vectors of ``size`` numbers, filled up with zeros to whole words of 64 bits."""
    if size not in _ROTATIONS:
        width = -(-size // 64) * 64
        q, r = np.linalg.qr(np.random.default_rng(size).normal(size=(width, width)))
        _ROTATIONS.clear()
        _ROTATIONS[size] = (q * np.sign(np.diag(r)))[:size]
    return _ROTATIONS[size]


def coded(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed signs (words of 64 bits), length and f of each row, a vector less its centre."""
    turned = rows @ rotation(rows.shape[1])
    length = np.linalg.norm(turned, axis=1)
    bits = np.packbits(turned > 0, axis=1, bitorder="little").view("<u8")
    f = np.abs(turned).sum(axis=1) / (np.where(length > 0, length, 1) * np.sqrt(turned.shape[1]))
    return bits, length, np.where(length > 0, f, 1.0)


def estimates(
    queries: np.ndarray, codes: np.ndarray, length: np.ndarray, f: np.ndarray, spread: float = SPREAD
) -> tuple[np.ndarray, np.ndarray]:
    """Estimated squared distances, queries by codes, and how far off they may be; queries less the centre."""
    turned = queries @ rotation(queries.shape[1])
    width = turned.shape[1]
    low = turned.min(axis=1, keepdims=True)
    step = np.maximum((turned.max(axis=1, keepdims=True) - low) / ((1 << PLANES) - 1), 1e-300)
    whole = np.rint((turned - low) / step).astype(np.uint8)
    product = np.zeros((len(queries), len(codes)))
    for plane in range(PLANES):
        bits = np.packbits(whole >> plane & 1, axis=1, bitorder="little").view("<u8")
        for word in range(codes.shape[1]):
            product += np.bitwise_count(bits[:, word, None] & codes[None, :, word]).astype(np.float64) * (1 << plane)
    ones = np.bitwise_count(codes).sum(axis=1)
    # signs are 2 b - 1, and a number is low + step * whole
    product = 2 * (low * ones + step * product) - turned.sum(axis=1, keepdims=True)
    norm = np.linalg.norm(turned, axis=1, keepdims=True)
    inner = product / (np.sqrt(width) * f)
    off = spread * norm * np.sqrt(np.maximum(0, 1 - f * f)) / (f * np.sqrt(max(1, width - 1))) + np.sqrt(width) * step / 2 / f
    return length**2 + norm**2 - 2 * length * inner, 2 * length * off + 1e-9 * (length**2 + norm**2)


# --- cells -----------------------------------------------------------------------------------


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum(0, (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * a @ b.T)


def fitted_centres(rows: np.ndarray, count: int, rounds: int) -> np.ndarray:
    """``count`` centres at the most: the first rows, moved to the means of what lies nearest to them."""
    centres = rows[:count].copy()
    for _ in range(rounds):
        near = _squares(rows, centres).argmin(axis=1)
        held = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, rows)
        centres = sums[held > 0] / held[held > 0, None]
    return centres


def centres(classes: DataFrame, fit: Fit) -> dict[int, np.ndarray]:
    """Centres of the vectors of each size, from a sample of at most about ``centres * per_centre`` vectors."""
    n = classes.count()
    wanted = max(1, min(fit.centres, n // BLOCK))
    share = min(1.0, wanted * fit.per_centre / max(1, n))
    drawn = classes.where(F.pmod(F.xxhash64(F.lit(13), "embedding"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1)

    def make(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("h", ignore_index=True)
        rows = np.stack(frame["embedding"].to_numpy()).astype(float)
        found = fitted_centres(rows, max(1, len(rows) // fit.per_centre), fit.rounds)
        return pd.DataFrame({"size": frame["size"].iloc[0], "cell": np.arange(len(found)), "centre": list(found)})

    made = drawn.select("size", "h", "embedding").groupBy("size").applyInPandas(make, "size int, cell int, centre array<double>")
    rows = made.orderBy("size", "cell").collect()
    found: dict[int, list] = {}
    for row in rows:
        found.setdefault(row["size"], []).append(row["centre"])
    return {size: np.array(c) for size, c in found.items()}


def _centres_of(known: dict[int, np.ndarray], size: int) -> np.ndarray:
    return known.get(size, np.zeros((1, size)))


# --- index and search ------------------------------------------------------------------------


def _classes(vectors: DataFrame, k: int) -> DataFrame:
    """``rid``, ``h``, ``size``, ``embedding`` and ``ids``, the k + 1 least ids, of each different vector."""
    least = F.dense_rank().over(Window.partitionBy("h", "embedding").orderBy("vec_id"))
    few = vectors.withColumn("_rank", least).where(F.col("_rank") <= k + 1)
    found = few.groupBy("h", "embedding").agg(F.sort_array(F.collect_set("vec_id")).alias("ids"))
    return stage(found.select(F.monotonically_increasing_id().alias("rid"), "h", F.size("embedding").alias("size"), "embedding", "ids"), "ann-vectors")


def _codes(classes: DataFrame, known) -> DataFrame:
    """``rid``, ``least``, ``size``, ``cell``, ``code``, ``length``, ``f`` and ``embedding`` of every vector."""

    def work(frames):
        for frame in frames:
            for size, group in frame.groupby("size"):
                rows, middle = np.stack(group["embedding"].to_numpy()).astype(float), _centres_of(known.value, size)
                for at in range(0, len(rows), BLOCK):
                    part = rows[at : at + BLOCK]
                    cell = _squares(part, middle).argmin(axis=1)
                    code, length, f = coded(part - middle[cell])
                    yield pd.DataFrame({
                        "rid": group["rid"].iloc[at : at + BLOCK], "least": group["least"].iloc[at : at + BLOCK], "size": size, "cell": cell,
                        "code": [c.tobytes() for c in code], "length": length, "f": f, "embedding": group["embedding"].iloc[at : at + BLOCK],
                    })

    kind = dict(classes.dtypes)["embedding"]
    schema = f"rid long, least long, size int, cell int, code binary, length double, f double, embedding {kind}"
    return classes.select("rid", F.col("ids")[0].alias("least"), "size", "embedding").mapInPandas(work, schema)


def _visits(queries: DataFrame, known, cells, enough: int) -> DataFrame:
    """``query``, ``size``, ``cell``, ``part``, ``embedding`` and ``reach`` for the blocks that a query visits.

    Without a ``reach`` those of its nearest cells that hold ``enough`` vectors together; else those of all
    cells that may hold a vector within it.
    """

    def work(frames):
        for frame in frames:
            out = []
            for size, group in frame.groupby("size"):
                middle, (held, least, most, parts) = _centres_of(known.value, size), cells.value[size]
                rows = np.stack(group["embedding"].to_numpy()).astype(float)
                away = np.sqrt(_squares(rows, middle))
                for row, (query, vector, reach), far in zip(rows, group[["query", "embedding", "reach"]].itertuples(index=False), away, strict=True):
                    if np.isnan(reach):
                        order = np.argsort(far)
                        order = order[held[order] > 0]
                        chosen = order[: 1 + int(np.searchsorted(np.cumsum(held[order]), enough))]
                    else:
                        gap = np.maximum(far - most, least - far)
                        chosen = np.flatnonzero((held > 0) & (gap <= reach + 1e-6 * (1 + far)))
                    for cell in chosen.tolist():
                        out.append((query, size, cell, int(parts[cell]), vector, reach))
                    if len(out) >= 1 << 12:
                        yield pd.DataFrame(out, columns=names)
                        out = []
            if out:
                yield pd.DataFrame(out, columns=names)

    names = ["query", "size", "cell", "parts", "embedding", "reach"]
    schema = f"query long, size int, cell int, parts int, embedding {dict(queries.dtypes)['embedding']}, reach double"
    found = queries.select("query", "size", "embedding", "reach").mapInPandas(work, schema)
    return found.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")


def _met(visits: DataFrame, codes: DataFrame, known, k: int, spread: float) -> DataFrame:
    """``query``, ``rid``, ``least`` and ``score`` (the true distance) of pairs in the visited blocks.

    For visits without a ``reach`` the k nearest among the best estimates of each block; else what lies within
    it. Of a block the 2 k nearest go on at most: the k nearest of all are among them, with room for numbers
    that the last digits of a sum would set in another order.
    """
    block = ["size", "cell", "part"]
    asked = stage(visits, "ann-visits")
    demand = asked.groupBy(*block).agg(F.ceil(F.count("*") / GROUP).cast("int").alias("groups"))
    left = asked.join(demand, block).withColumn("group", F.pmod(F.xxhash64("query"), F.col("groups")).cast("int")).drop("groups")
    right = codes.join(demand, block).withColumn("group", F.explode(F.sequence(F.lit(0), F.col("groups") - 1))).drop("groups")

    def tile(key, asking: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query": [], "rid": [], "least": [], "score": []})
        if not len(asking) or not len(held):
            return empty
        middle = _centres_of(known.value, int(key[0]))[int(key[1])]
        code = np.frombuffer(b"".join(held["code"]), "<u8").reshape(len(held), -1)
        length, f, there = held["length"].to_numpy(), held["f"].to_numpy(), np.stack(held["embedding"].to_numpy()).astype(float)
        least = held["least"].to_numpy()
        here, reach, out = np.stack(asking["embedding"].to_numpy()).astype(float), asking["reach"].to_numpy(), []
        for at in range(0, len(here), 128):
            rows, limit = here[at : at + 128], reach[at : at + 128, None]
            guess, off = estimates(rows - middle, code, length, f, spread)
            first = np.isnan(limit[:, 0])
            wanted = guess - off <= np.square(limit) * (1 + 1e-9) + 1e-12  # false where there is no reach
            if first.any():
                few = min(4 * k, len(code))
                wanted[np.flatnonzero(first)[:, None], np.argpartition(guess[first], few - 1, axis=1)[:, :few]] = True
            i, j = np.nonzero(wanted)
            score = np.concatenate([
                np.sqrt(np.square(rows[i[x : x + BLOCK]] - there[j[x : x + BLOCK]]).sum(axis=1)) for x in range(0, len(i), BLOCK)
            ] or [np.empty(0)])
            order = np.lexsort((least[j], score, i))
            i, j, score = i[order], j[order], score[order]
            nth = np.arange(len(i)) - np.searchsorted(i, i)
            keep = np.where(first[i], nth < k, (nth < 2 * k) & (score <= limit[i, 0] * (1 + 1e-9) + 1e-12))
            found = held[["rid", "least"]].iloc[j[keep]]
            out.append(found.assign(query=asking["query"].to_numpy()[at + i[keep]], score=score[keep]))
        return pd.concat(out)[["query", "rid", "least", "score"]]

    keys = [*block, "group"]
    schema = "query long, rid long, least long, score double"
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(tile, schema)


def _exact(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """``query``, ``rid``, ``ids`` and ``score``, the true distance, of each pair."""
    other = classes.select("rid", "ids", F.col("embedding").alias("_there"))
    own = classes.select(F.col("rid").alias("query"), F.col("embedding").alias("_here"))
    met = pairs.select("query", "rid").join(other, "rid").join(own, "query")
    return met.select("query", "rid", "ids", distance(F.col("_here"), F.col("_there")).alias("score"))


def nearest(vectors: DataFrame, asking: Column, k: int = 10, fit: Fit = Fit(), spread: float = SPREAD) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id`` and ``score`` of the ``k`` nearest rows of each row that is ``asking``.

    ``vectors`` has ``vec_id`` and ``embedding``; ``asking`` is a condition on them. Nearest is least in
    Euclidean distance, ties go to the smaller id; with fewer candidates all are returned. A row is no
    candidate of a query with its own id. Rows without an id, and vectors that are null, empty, zero or hold
    a null or a number that is not finite, take no part; vectors of other sizes don't meet. A row that is
    repeated as it is counts once; if one id has several vectors, each is a candidate, and each asks, under
    the one id with ranks of its own. Other columns go; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    rows = vectors.where(F.col("vec_id").isNotNull() & usable()).select(
        "vec_id", "embedding", F.xxhash64("embedding").alias("h"), F.coalesce(asking, F.lit(False)).alias("_asks")
    )
    classes = _classes(rows.drop("_asks"), k)
    asked = rows.where("_asks").select("vec_id", "h", "embedding").distinct().join(classes.select("rid", "h", "embedding"), ["h", "embedding"])
    asked = stage(asked.select("vec_id", F.col("rid").alias("query")), "ann-queries")
    known = spark.sparkContext.broadcast(centres(classes, fit))
    coded_rows = stage(_codes(classes, known), "ann-codes")
    counted = coded_rows.groupBy("size", "cell").agg(
        F.count("*").alias("held"), F.min("length").alias("least"), F.max("length").alias("most")
    )
    by_cell: dict[int, tuple] = {}
    for row in counted.collect():  # a row for each centre, at most fit.centres of a size
        if row["size"] not in by_cell:
            by_cell[row["size"]] = tuple(np.zeros(len(_centres_of(known.value, row["size"]))) for _ in range(4))
        for table, value in zip(by_cell[row["size"]], (row["held"], row["least"], row["most"], -(-row["held"] // BLOCK)), strict=True):
            table[row["cell"]] = value
    cells = spark.sparkContext.broadcast(by_cell)
    sizes = counted.select("size", "cell", F.ceil(F.col("held") / BLOCK).alias("parts"))
    codes = coded_rows.join(F.broadcast(sizes), ["size", "cell"]).withColumn("part", F.pmod(F.xxhash64("rid"), F.col("parts")).cast("int")).drop("parts")

    wanted = asked.select("query").distinct().join(classes.select(F.col("rid").alias("query"), "size", "embedding"), "query")
    wanted = stage(wanted, "ann-asking")
    first = wanted.withColumn("reach", F.lit(float("nan")))
    tried = _met(_visits(first, known, cells, 20 * (k + 1)), codes, known, k + 1, spread)
    by_score = Window.partitionBy("query").orderBy("score", "least")
    # k + 1 different vectors hold k ids besides the query's own
    surely = stage(tried.withColumn("_n", F.row_number().over(by_score)).where(F.col("_n") <= k + 1), "ann-first")
    reach = surely.where(F.col("_n") == k + 1).select("query", F.col("score").alias("reach"))
    second = wanted.join(reach, "query", "left").withColumn("reach", F.coalesce("reach", F.lit(float("inf"))))
    within = _met(_visits(second, known, cells, 0), codes, known, k + 1, spread).select("query", "rid")
    # the first round's neighbours stay, should a bound have missed one of them
    pairs = stage(within.union(surely.select("query", "rid")).distinct(), "ann-pairs")
    exact = _exact(pairs, classes).withColumn("least", F.col("ids")[0])
    ranked = exact.withColumn("_n", F.row_number().over(by_score)).where(F.col("_n") <= k + 1)
    with_ids = F.transform("ids", lambda i: F.struct(F.col("score"), i.alias("vec_id")))
    lists = ranked.groupBy("query").agg(F.slice(F.sort_array(F.flatten(F.collect_list(with_ids))), 1, k + 1).alias("near"))
    answered = asked.join(lists, "query")
    others = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("vec_id")), 1, k)
    placed = answered.select(F.col("vec_id").alias("query_id"), F.posexplode(others).alias("_at", "_near"))
    return placed.select("query_id", (F.col("_at") + 1).cast("int").alias("rank"), "_near.vec_id", "_near.score")
