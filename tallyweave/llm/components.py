"""Connected components of a graph in a table, by rounds of large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.state import stage


def _with_least(edges: DataFrame) -> DataFrame:
    """Each directed edge (u, v) with the least of u and all its v."""
    least = edges.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    return edges.join(least, "u")


def _pairs(edges: DataFrame, a: str, b: str) -> DataFrame:
    return edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component`` (the least node it reaches) for every node of an edge.

    ``edges`` has ``u`` and ``v`` of one orderable type, no nulls; loops and repeated edges do no
    harm. A large star sends a node's larger neighbours to its least one, a small star its smaller
    ones; both keep what is connected, and when neither changes an edge, every edge points at the
    least node of its component. Each round is written to the shared folder, so no plan grows with
    the rounds; a node with very many neighbours is a skewed join, never a collected list.
    """
    now = stage(_pairs(edges, "u", "v"), "edges")
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _pairs(_with_least(both).where("v > u"), "v", "m")
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        starred = _with_least(down)
        small = _pairs(
            starred.select("v", "m").unionByName(starred.select(F.col("u").alias("v"), "m")).where("v <> m"), "v", "m"
        )
        after = stage(small, "edges")
        changed = after.join(now, ["u", "v"], "left_anti").limit(1).count() + now.join(after, ["u", "v"], "left_anti").limit(1).count()
        now = after
        if not changed:
            break
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
