"""Near-duplicate vectors by products of int8 tiles with error bounds, then full precision where it matters.

Equal vectors of a label become one, with their number. The rest are cut into blocks of about BLOCK
vectors; two blocks of a label make a tile. In a tile every unit vector x is rounded to s * q with
int8 q, and e = |x - s q| is known. The product of the rounded vectors is exact, and the true cosine
differs from it by at most ea + eb + 3 ea eb; only pairs that may reach the threshold within this
bound are computed again from the original numbers in double precision.

A tile gives, for each vector, how many vectors it links to and one link to the least vector that it
reaches within the tile, never its pairs. Large labels are first cut into cells of a grid on a few
random orthonormal axes: the distance of unit vectors with cosine c is sqrt(2 - 2c) at most, and no
projection makes it longer, so vectors of cells that are not neighbours need no tile.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.llm.components import components
from tallyweave.state import stage

BLOCK = 1024
AXES = 4
#: A label gets one more axis each time it is this many times larger than a few blocks.
CELLS_PER_AXIS = 3.0


def usable(vector: str = "embedding", label: str = "label") -> Column:
    """Label and vector are there, all numbers are finite, and one is not zero."""
    v = F.col(vector)
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    whole = F.forall(v, lambda x: F.coalesce(number(x), F.lit(False)))
    return F.coalesce(F.col(label).isNotNull() & v.isNotNull() & whole & F.exists(v, lambda x: x != 0), F.lit(False))


def axes(dimensions: int, count: int) -> np.ndarray:
    """``count`` orthonormal axes, the same for all vectors of that many dimensions."""
    draw = np.random.default_rng(dimensions).normal(size=(dimensions, max(1, min(count, dimensions))))
    return np.linalg.qr(draw)[0]


def quantised(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 rows, their scales, and upper bounds of the length of what rounding took away."""
    scale = np.abs(unit).max(axis=1) / 127
    q = np.rint(unit / scale[:, None]).astype(np.int8)
    return q, scale, np.linalg.norm(unit - scale[:, None] * q, axis=1) + 1e-12


def near_pairs(a: np.ndarray, b: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) with cosine(a[i], b[j]) >= threshold in double precision."""
    norm_a, norm_b = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
    (qa, sa, ea), (qb, sb, eb) = quantised(a / norm_a[:, None]), quantised(b / norm_b[:, None])
    # integers below 2 ** 24 are exact in single precision, below 2 ** 53 in double
    kind = np.float32 if 127 * 127 * a.shape[1] < 1 << 24 else np.float64
    rounded = (qa.astype(kind) @ qb.astype(kind).T) * (sa[:, None] * sb).astype(np.float64)
    possible = rounded + (ea[:, None] + eb + 3 * ea[:, None] * eb) >= threshold - 1e-12
    rows, columns = np.nonzero(possible)
    keep = np.zeros(len(rows), bool)
    for at in range(0, len(rows), 1 << 15):
        i, j = rows[at : at + (1 << 15)], columns[at : at + (1 << 15)]
        keep[at : at + (1 << 15)] = np.einsum("ij,ij->i", a[i], b[j]) / (norm_a[i] * norm_b[j]) >= threshold
    return rows[keep], columns[keep]


def least_reached(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Of each of ``n`` places the least one it reaches over the pairs."""
    root = np.arange(n)
    while len(i):
        low = np.minimum(root[i], root[j])
        before = root.copy()
        np.minimum.at(root, root[i], low)
        np.minimum.at(root, root[j], low)
        root = root[root]
        if (root == before).all():
            break
    return root


def _classes(vectors: DataFrame) -> DataFrame:
    """``rid``, ``label``, ``size`` (dimensions), ``embedding``, ``copies``, ``least`` and two hashes; one row for equal vectors."""
    keys = ["label", "h1", "h2"]
    found = vectors.groupBy(*keys).agg(
        F.first("embedding").alias("embedding"), F.count("*").alias("copies"), F.min("vec_id").alias("least")
    )
    numbered = found.withColumn("rid", F.monotonically_increasing_id())
    return stage(numbered.withColumn("size", F.size("embedding")), "vectors")


def _blocks(classes: DataFrame, threshold: float, block: int) -> DataFrame:
    """``classes`` with ``cell`` and ``part``: together with label and size they name the block."""
    reach = math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-9
    sizes = classes.groupBy("label", "size").agg(F.count("*").alias("members"))

    def place(frames):
        for frame in frames:
            cells = []
            for vector, wanted in zip(frame["embedding"], frame["wanted"], strict=True):
                x = np.asarray(vector, float)
                x = x / np.linalg.norm(x)
                on = np.floor(x @ axes(len(x), AXES) / reach).astype(int)
                cells.append(on[: int(wanted)].tolist())
            yield frame.drop(columns="wanted").assign(cell=cells)

    times = F.log(F.col("members") / (4.0 * block)) / math.log(CELLS_PER_AXIS)
    wanted = F.least(F.lit(AXES), F.greatest(F.lit(0), F.floor(times).cast("int")))
    with_size = classes.join(sizes, ["label", "size"]).withColumn("wanted", wanted).drop("members")
    kinds = ", ".join(f"`{k}` {kind}" for k, kind in classes.dtypes)
    placed = stage(with_size.mapInPandas(place, f"{kinds}, cell array<int>"), "vector-cells")
    counts = placed.groupBy("label", "size", "cell").agg(F.ceil(F.count("*") / block).alias("parts"))
    return placed.join(counts, ["label", "size", "cell"]).withColumn("part", F.pmod(F.xxhash64("rid"), F.col("parts"))).drop("parts")


def links(classes: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """``rid``, ``links`` (how many vectors of other classes it is near to) and ``root``, from each tile."""
    blocked = stage(_blocks(classes, threshold, block), "vector-blocks")
    names = blocked.groupBy("label", "size", "cell", "part").agg(F.count("*").alias("members"))
    names = stage(names.withColumn("block", F.monotonically_increasing_id()), "vector-block-names")
    near = lambda a, b: F.forall(F.arrays_zip(a.alias("x"), b.alias("y")), lambda z: F.abs(z["x"] - z["y"]) <= 1)
    a, b = names.alias("a"), names.alias("b")
    tiles = a.join(b, ["label", "size"]).where(
        (F.col("a.block") < F.col("b.block")) | ((F.col("a.block") == F.col("b.block")) & (F.col("a.members") > 1))
    )
    tiles = tiles.where(near(F.col("a.cell"), F.col("b.cell"))).select(F.col("a.block").alias("one"), F.col("b.block").alias("two"))
    sides = tiles.select("one", "two", F.explode(F.array_distinct(F.array("one", "two"))).alias("block"))
    named = blocked.join(names.drop("members"), ["label", "size", "cell", "part"]).select("block", "rid", "copies", "embedding")
    dealt = sides.join(named, "block")

    def tile(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("rid", ignore_index=True)
        vectors = np.stack(frame["embedding"].to_numpy()).astype(float)
        first = np.flatnonzero(frame["block"].to_numpy() == frame["one"].to_numpy())
        second = np.flatnonzero(frame["block"].to_numpy() == frame["two"].to_numpy())
        i, j = near_pairs(vectors[first], vectors[second], threshold)
        i, j = first[i], second[j]
        if frame["one"].iloc[0] == frame["two"].iloc[0]:
            i, j = i[i < j], j[i < j]
        n, copies = len(frame), frame["copies"].to_numpy(float)
        count = np.bincount(i, copies[j], n) + np.bincount(j, copies[i], n)
        root = frame["rid"].to_numpy()[least_reached(n, i, j)]
        out = pd.DataFrame({"rid": frame["rid"], "links": count.astype(np.int64), "root": root})
        return out[out["links"] > 0]

    return dealt.groupBy("one", "two").applyInPandas(tile, "rid long, links long, root long")


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, block: int = BLOCK) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id``, ``kept`` for every row (``vec_id``, ``embedding``, ``label``).

    Rows are compared when their labels are equal and not null. A vector that is null, zero or empty or
    holds a null or non-finite number links with nothing, and vectors of other dimensions don't link
    with each other. Copies link with each other. A row that links with nothing is its own component;
    a component without an id has none, and such rows are not kept.
    """
    keyed = vectors.select(
        "vec_id",
        "label",
        "embedding",
        usable().alias("ok"),
        F.xxhash64(F.lit(1), "embedding").alias("h1"),
        F.xxhash64(F.lit(2), F.reverse("embedding")).alias("h2"),
    )
    good = keyed.where("ok").drop("ok")
    classes = _classes(good)
    found = stage(links(classes, threshold, block), "vector-links")
    counts = found.groupBy("rid").agg(F.sum("links").alias("links"))
    reached = components(found.select(F.col("rid").alias("u"), F.col("root").alias("v")))
    member = classes.select("rid", "label", "h1", "h2", "copies", "least").join(reached.withColumnRenamed("node", "rid"), "rid", "left")
    member = member.withColumn("component", F.coalesce("component", "rid")).join(counts, "rid", "left")
    ids = member.groupBy("component").agg(F.min("least").alias("component_id"))
    known = member.join(ids, "component").select(
        "label", "h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id"
    )
    linked = good.select("vec_id", "label", "h1", "h2").join(known, ["label", "h1", "h2"]).select("vec_id", "n_links", "component_id")
    alone = keyed.where("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
