"""The trie of conversations by their turns: sorted shards, and a broadcast skeleton of what crosses them.

A turn is written as TOKEN characters of a SHA-256 of its role and text, a conversation as its turns in a
row: its path. Equal paths are one row with their number and least id. Paths are dealt to shards by
splitters, paths from a sample. A node (a beginning of paths) is a range of the sorted paths, so a node
whose range crosses from a shard to the next is a beginning of the splitter between them. The trie of all
splitters, the skeleton, is broadcast: at most SHARDS paths of SPLIT_DEPTH turns, whatever the input.

Each shard is sorted and read once, with the nodes of the present path held on a stack. A node that is not
in the skeleton is finished there. For nodes of the skeleton each shard gives what it has seen of them;
these parts add up by key, since each is a sum over members or over nodes that only that shard has:

- members, and the least of them;
- children and leaves outside the skeleton (a skeleton node without children in the skeleton lies in one
  shard, which thus sees whether it is a leaf);
- saved characters of the nodes outside the skeleton, and members times length for those in it.

The length of each skeleton node, to be taken off once, and its children in the skeleton are known from
the skeleton itself.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.state import stage

#: Characters of a turn: 132 bits of its hash in base 64.
TOKEN = 22
#: Turns of a splitter; different paths that share as many stay in one shard.
SPLIT_DEPTH = 16
SHARDS = 8192
#: Different paths that a shard is meant to hold, as long as SHARDS are enough.
SHARD_PATHS = 2_000
SAMPLED = 4
#: Ids of one list whose text is hashed at once.
ID_RANGE = 4096
NO_IDS = hashlib.sha256().hexdigest()


# --- conversations and paths -------------------------------------------------------------------


def turns(conversations: DataFrame) -> DataFrame:
    """``conv_id`` and ``turns``, its tokens and lengths in the order of turn (null first), role and text.

    Null roles and texts are empty; rows without a ``conv_id`` go. A conversation's turns, some 40 bytes
    each, are one value.
    """
    empty = F.lit("")
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text")
    )
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text"))
    whole = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    token = F.substring(F.base64(F.unhex(whole)), 1, TOKEN)
    one = F.struct(place.alias("at"), token.alias("token"), F.length("text").alias("size"))
    listed = rows.select("conv_id", one.alias("_one")).groupBy("conv_id").agg(F.sort_array(F.collect_list("_one")).alias("_all"))
    return listed.select("conv_id", F.transform("_all", lambda t: F.struct(t["token"].alias("token"), t["size"].alias("size"))).alias("turns"))


def branched(conversations: DataFrame, every: int = 100, most: int = 6) -> DataFrame:
    """Conversations (as ``turns`` gives them) that share their first turns with others.

    Of conversation c the first h turns, h = crc32(c as text) % ``most``, are replaced by the first h of
    conversation ``c - c % every``: all of it if it has fewer, none if there is none.
    """
    heads = conversations.where(F.pmod("conv_id", F.lit(every)) == 0).select(
        F.col("conv_id").alias("_base"), F.slice("turns", 1, most - 1).alias("_head")
    )
    h = (F.crc32(F.col("conv_id").cast("string")) % most).cast("int")
    met = conversations.withColumn("_base", F.col("conv_id") - F.pmod("conv_id", F.lit(every))).join(heads, "_base", "left")
    head = F.coalesce(F.when(h > 0, F.slice("_head", F.lit(1), h)), F.filter("turns", lambda t: F.lit(False)))
    return met.select("conv_id", F.concat(head, F.slice("turns", h + 1, F.greatest(F.size("turns"), F.lit(1)))).alias("turns"))


def _hash_ids(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of ``path``, ``sizes``, ``n``, ``least`` and ``ids`` in the order of path and ids, one row for each path."""
    now = None
    for frame in frames:
        out = []
        for path, sizes, n, least, ids in frame[["path", "sizes", "n", "least", "ids"]].itertuples(index=False):
            if now is not None and now[0] == path:
                now[2] += n
                now[4].update(b"," + ids.encode())
                continue
            if now is not None:
                out.append((*now[:4], now[4].hexdigest()))
            now = [path, sizes, n, least, hashlib.sha256(ids.encode())]
        if out:
            yield pd.DataFrame(out, columns=["path", "sizes", "n", "least", "ends"])
    if now is not None:
        yield pd.DataFrame([(*now[:4], now[4].hexdigest())], columns=["path", "sizes", "n", "least", "ends"])


def paths(conversations: DataFrame) -> DataFrame:
    """``path``, ``sizes``, ``n``, ``least`` and ``ends`` of each different sequence of turns.

    ``ends`` is the SHA-256 of the ids that have just these turns, ascending, joined by commas. The ids of
    a path are joined range by range, in any number of tasks; one task then reads the joined ranges of a
    path in order and hashes them as they come, since a SHA-256 can't be made in parts.
    """
    each = conversations.select(
        "conv_id",
        F.array_join(F.col("turns.token"), "").alias("path"),
        F.col("turns.size").alias("sizes"),
        F.floor(F.col("conv_id") / ID_RANGE).alias("range"),
    )
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda i: i.cast("string")), ",")
    ranges = each.groupBy("path", "range").agg(
        F.first("sizes").alias("sizes"), F.count("*").alias("n"), F.min("conv_id").alias("least"), ids.alias("ids")
    )
    dealt = ranges.repartition("path").sortWithinPartitions("path", "range").drop("range")
    return stage(dealt.mapInPandas(_hash_ids, "path string, sizes array<int>, n long, least long, ends string"), "trie-paths")


# --- skeleton ----------------------------------------------------------------------------------


@dataclass(frozen=True)
class Skeleton:
    """Splitters in order, and of each node of their trie its number of children and the lengths at and below it."""

    splitters: list[str]
    children: dict[str, int]
    lengths: dict[str, int]


def skeleton(splitters: list[tuple[str, list[int]]]) -> Skeleton:
    """``splitters``: paths with the lengths of their turns, both of any number of turns."""
    own: dict[str, int] = {"": 0}
    for path, sizes in splitters:
        for depth in range(1, len(path) // TOKEN + 1):
            own[path[: depth * TOKEN]] = sizes[depth - 1]
    children, lengths = dict.fromkeys(own, 0), dict(own)
    for node in sorted(own, key=len, reverse=True):
        if node:
            children[node[:-TOKEN]] += 1
            lengths[node[:-TOKEN]] += lengths[node]
    return Skeleton(sorted({p for p, _ in splitters}), children, lengths)


def splitters(found: DataFrame, shards: int) -> list[tuple[str, list[int]]]:
    """Borders of about ``shards`` ranges of equal size: every SAMPLED-th of a sample that holds SAMPLED paths a shard."""
    n = found.count()
    if shards < 2 or not n:
        return []
    share = min(1.0, SAMPLED * shards / n)
    drawn = found.where(F.pmod(F.xxhash64(F.lit(11), "path"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1)
    cut = drawn.select(F.substring("path", 1, SPLIT_DEPTH * TOKEN).alias("path"), F.slice("sizes", 1, SPLIT_DEPTH).alias("sizes"))
    rows = sorted((r["path"], list(r["sizes"])) for r in cut.collect())
    step = max(1, len(rows) // shards)
    return [row for row in rows[step::step] if row[0]]


def _shard(path: Column, borders: list[str]) -> Column:
    """Which range of the splitters a path lies in."""

    @F.pandas_udf("int")
    def find(values: pd.Series) -> pd.Series:
        return pd.Series([bisect_right(borders, v) for v in values])

    return find(path)


# --- shards ------------------------------------------------------------------------------------

#: What a shard says: finished nodes, whose parent is known or lies in the skeleton (``above``), and parts of skeleton nodes (``node``).
PARTS = (
    "node string, above string, conv_id long, depth long, parent long, n_convs long, n_children long, n_leaves long, "
    "saved long, ends string"
)
PART_NAMES = [c.split()[0] for c in PARTS.split(", ")]


class _Frame:
    """A node on the way to the present path."""

    __slots__ = ("children", "ends", "held", "key", "leaves", "least", "n", "pending", "saved", "size")

    def __init__(self, key: str, size: int, held: bool):
        self.key, self.size, self.held = key, size, held  # held: of the skeleton
        self.n = self.children = self.leaves = self.saved = 0
        self.least: int | None = None
        self.ends, self.pending = NO_IDS, []


def _close(frame: _Frame, above: _Frame | None, inner: dict[str, int]) -> Iterator[tuple]:
    """Finish a node: what it gives to the node above it, and the rows that are now known."""
    if not frame.children and not (frame.held and inner[frame.key]):
        frame.leaves = 1
    # a skeleton node has members in other shards too; its own length is taken off once, at the end
    frame.saved += frame.size * (frame.n if frame.held else frame.n - 1)
    if above is not None:
        above.n += frame.n
        above.least = frame.least if above.least is None else min(above.least, frame.least)
        above.leaves += frame.leaves
        above.saved += frame.saved
    if frame.held:
        yield frame.key, None, frame.least, len(frame.key) // TOKEN, None, frame.n, frame.children, frame.leaves, frame.saved, frame.ends
        return
    row = [None, None, frame.least, len(frame.key) // TOKEN, None, frame.n, frame.children, frame.leaves, frame.saved, frame.ends]
    for child in frame.pending:
        child[4] = frame.least
        yield tuple(child)
    above.children += 1
    if above.held:
        row[1] = above.key
        yield tuple(row)
    else:
        above.pending.append(row)


def _parts(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=PART_NAMES).astype({"parent": "Int64"})


def _walk(known):
    """A function on the sorted paths of a task, which may hold many shards: rows of PARTS."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        inner: dict[str, int] = known.value
        stack: list[_Frame] = []
        shard = None
        for frame in frames:
            out: list[tuple] = []
            for this, path, sizes, n, least, ends in frame[["shard", "path", "sizes", "n", "least", "ends"]].itertuples(index=False):
                if this != shard:
                    while stack:
                        top = stack.pop()
                        out.extend(_close(top, stack[-1] if stack else None, inner))
                    shard, stack = this, [_Frame("", 0, True)]
                while not path.startswith(stack[-1].key):
                    top = stack.pop()
                    out.extend(_close(top, stack[-1], inner))
                for depth in range(len(stack), len(path) // TOKEN + 1):
                    key = path[: depth * TOKEN]
                    stack.append(_Frame(key, int(sizes[depth - 1]), stack[-1].held and key in inner))
                top = stack[-1]
                top.n += n
                top.least = least if top.least is None else min(top.least, least)
                top.ends = ends
            if out:
                yield _parts(out)
        out = []
        while stack:
            top = stack.pop()
            out.extend(_close(top, stack[-1] if stack else None, inner))
        if out:
            yield _parts(out)

    return run


def trie(conversations: DataFrame, shards: int | None = None) -> DataFrame:
    """A row for each node of the trie of ``conversations`` (``conv_id``, ``turns`` as ``turns`` gives them).

    ``conv_id`` (the least member), ``depth``, ``parent_conv_id`` (of the root: null), ``n_convs``,
    ``n_children``, ``n_leaves`` (childless nodes at and below it), ``saved_tokens`` (summed at and below it,
    members but one times the characters of the node's turn) and ``ends_sha256`` (see ``paths``).

    The root is the beginning of all, those without turns too. Equal turns are equal roles and texts, null
    being empty; repeated rows are repeated turns. Turns with one number follow by role, then text. Rows
    without a ``conv_id`` and other columns go, and an empty table has no node.
    """
    spark = conversations.sparkSession
    found = paths(conversations)
    if shards is None:
        shards = min(SHARDS, -(-found.count() // SHARD_PATHS))
    known = skeleton(splitters(found, shards))
    dealt = found.withColumn("shard", _shard(F.col("path"), known.splitters)).repartition("shard").sortWithinPartitions("shard", "path")
    inner = spark.sparkContext.broadcast(known.children)
    parts = stage(dealt.mapInPandas(_walk(inner), PARTS), "trie-parts")
    fixed = spark.createDataFrame([(k, known.children[k], known.lengths[k]) for k in known.children], "node string, _inner long, _own long")
    ends = F.coalesce(F.max(F.when(F.col("ends") != NO_IDS, F.col("ends"))), F.lit(NO_IDS))
    summed = parts.where(F.col("node").isNotNull()).groupBy("node").agg(
        F.min("conv_id").alias("conv_id"),
        F.min("depth").alias("depth"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved")],
        ends.alias("ends"),
    )
    whole = stage(
        summed.join(fixed, "node")
        .withColumn("n_children", F.col("n_children") + F.col("_inner"))
        .withColumn("saved", F.col("saved") - F.col("_own"))
        .drop("_inner", "_own"),
        "trie-skeleton",
    )
    above = F.when(F.col("node") != "", F.expr(f"substring(node, 1, length(node) - {TOKEN})"))
    names = ["conv_id", "depth", "above", "parent", "n_convs", "n_children", "n_leaves", "saved", "ends"]
    rows = parts.where(F.col("node").isNull()).select(*names).unionByName(
        whole.withColumn("above", above).withColumn("parent", F.lit(None).cast("long")).select(*names)
    )
    uppers = whole.select(F.col("node").alias("above"), F.col("conv_id").alias("_parent"))
    return rows.join(uppers, "above", "left").select(
        "conv_id",
        "depth",
        F.coalesce("parent", "_parent").alias("parent_conv_id"),
        "n_convs",
        "n_children",
        "n_leaves",
        F.col("saved").alias("saved_tokens"),
        F.col("ends").alias("ends_sha256"),
    )
