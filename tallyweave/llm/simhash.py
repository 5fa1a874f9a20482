"""SimHash near-duplicates by covering locality-sensitive hashing.

Every bit position gets a non-zero vector of radius + 1 bits. For each non-zero vector v the mask of
v holds the positions whose vector has an odd number of bits in common with v. Two fingerprints that
differ in at most ``radius`` positions have some v that is orthogonal to the vectors of all these
positions, so under that mask they are equal: every pair within the radius meets in some table.

Fingerprints are made distinct first, so copies of a text weigh nothing. In a table's bucket of up
to BUCKET fingerprints all pairs are compared as columns, in one of up to CROWD as an array in a task,
which gives links to the least fingerprint reached instead of pairs. A larger bucket is handled
exactly without pairs: its fingerprints differ only outside the mask, so each one is sent to every
fingerprint within ``radius / 2`` flips of it there, and those that meet at such a centre are linked
to the least of them. Two fingerprints within the radius always share a centre, and those that share
one are within the radius.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.llm.common import texts_of
from tallyweave.llm.components import components
from tallyweave.state import stage

BITS = 64
BUCKET = 32
CROWD = 4096
#: Texts of a bucket that all meet at first; in a larger one each meets the least and the nearest before the others.
FEW = 4
#: Texts of a bucket whose pairs are made by their fingerprints; those of a larger one of several groups meet by their shingles.
MIXED = 16


def fingerprint(text: str, words: int = 3, seed: int = 42) -> int:
    """The SimHash of a whole text: a bit is 1 if set in over half the hashes of its word shingles."""
    return int(_of_raw(text.encode(), words, seed))


def _of_raw(raw: bytes, width: int, seed: int) -> np.uint64:
    words = raw.lower().split()  # bytes: A-Z and ASCII white space alone
    if not words:
        return np.uint64(0)
    line, n = b" ".join(words), max(1, len(words) - width + 1)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[:n].tolist()
    stops = ends[min(width, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(line[a:b], seed) for a, b in zip(starts, stops, strict=True)), np.uint64, n)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, 1 << 16):
        part = hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > n, bitorder="little").view("<u8")[0]


def fingerprints(documents: DataFrame, words: int = 3, seed: int = 42, *extra: str) -> DataFrame:
    """``doc_id``, ``extra`` columns and ``fp`` (64 bits as a signed long) of every whole text; one narrow pass.

    Null, empty and blank texts have the fingerprint zero.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = np.array([_of_raw(t.encode(), words, seed) for t in frame["text"]], np.uint64)
            yield frame[["doc_id", *extra]].assign(fp=found.view(np.int64))

    chosen = texts_of(documents, *extra)
    kinds = ", ".join(f"`{k}` {kind}" for k, kind in chosen.dtypes if k != "text")
    return chosen.mapInPandas(run, f"{kinds}, fp long")


def masks(radius: int) -> list[int]:
    """The masks of the tables as signed longs: 2 ** (radius + 1) - 1 of them."""
    size = 1 << (radius + 1)
    vectors = [1 + i % (size - 1) for i in range(BITS)]
    unsigned = [
        sum(1 << i for i, vector in enumerate(vectors) if (vector & v).bit_count() % 2) for v in range(1, size)
    ]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in unsigned]


def _crowd_links(radius: int):
    """A function on one bucket: each fingerprint with the least one it reaches within the bucket."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        fps = np.sort(frame["fp"].to_numpy())
        bits = fps.view(np.uint64)  # of signed numbers, the bits of the absolute value are counted
        root = np.arange(len(fps))
        rows, columns = [], []
        for at in range(0, len(fps), 256):
            near = np.bitwise_count(bits[at : at + 256, None] ^ bits) <= radius
            i, j = np.nonzero(near)
            rows.append(i + at)
            columns.append(j)
        i, j = np.concatenate(rows), np.concatenate(columns)
        while True:
            before = root.copy()
            np.minimum.at(root, i, root[j])
            root = root[root]
            if (root == before).all():
                break
        linked = root < np.arange(len(fps))
        return pd.DataFrame({"u": fps[root[linked]], "v": fps[linked]})

    return run


def _per_seed(run, own: list[str]):
    """``run`` on one bucket, its result with the bucket's seed where there are several."""
    return (lambda frame: run(frame).assign(seed=frame["seed"].iloc[0])) if own else run


def _centres(tables: list[int], radius: int, own: list[str]):
    """A function on ``t`` and ``fp``: every centre within reach of a fingerprint outside its table's mask."""
    half, odd = radius // 2, radius % 2
    flips = []
    for mask in tables:
        free = [i for i in range(BITS) if not (mask >> i) & 1]
        near = [sum(1 << i for i in c) for size in range(half + odd + 1) for c in combinations(free, size)]
        flips.append(np.array(near, np.uint64).view(np.int64))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for (t, *seed), fps in frame.groupby(["t", *own])["fp"]:
                inner = np.bitwise_count(flips[t].view(np.uint64)) <= half
                for at in range(0, len(fps), 256):
                    part = fps.to_numpy()[at : at + 256]
                    yield pd.DataFrame(
                        {
                            **dict(zip(own, seed, strict=True)),
                            "c": (part[:, None] ^ flips[t]).ravel(),
                            "inner": np.tile(inner, len(part)),
                            "fp": np.repeat(part, len(flips[t])),
                        }
                    )

    return run


def _crowd_pairs(radius: int):
    """A function on one bucket: each fingerprint with the least and with the nearest other one within the radius."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        fps = np.sort(frame["fp"].to_numpy())
        bits, out = fps.view(np.uint64), []
        for at in range(0, len(fps), 256):
            apart = np.bitwise_count(bits[at : at + 256, None] ^ bits).astype(np.int16)
            rows = np.arange(len(apart))
            apart[rows, rows + at] = BITS + 1
            for other in ((apart <= radius).argmax(axis=1), apart.argmin(axis=1)):
                near = apart[rows, other] <= radius
                out.append(np.stack([fps[rows[near] + at], fps[other[near]]], axis=1))
        pairs = np.sort(np.concatenate(out), axis=1)
        return pd.DataFrame(np.unique(pairs, axis=0), columns=["u", "v"])

    return run


def _dealt(named: DataFrame, radius: int) -> DataFrame:
    """Every row of ``named`` once for each table ``t``, with its fingerprint's ``key`` there.

    Buckets are told by windows over the key: each row is shuffled once, where counts that are joined back
    would shuffle it twice.
    """
    at = [F.struct(F.lit(k).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for k, m in enumerate(masks(radius))]
    return named.select(*named.columns, F.explode(F.array(*at)).alias("b")).select(*named.columns, "b.*")


def links(distinct: DataFrame, radius: int = 2, bucket: int = BUCKET, crowd: int = CROWD, near_only: bool = False) -> DataFrame:
    """Links (``u`` < ``v``) that connect exactly what pairs within the radius connect.

    With ``near_only`` every link is itself a pair within the radius: in a bucket of more than ``bucket``
    fingerprints each is then linked to the least and to the nearest within the radius.

    ``distinct`` has ``fp``, each value once, or each once for a ``seed`` (int) that its links then carry:
    fingerprints of several seeds need no passes of their own. Radius 0 to 4; the centres of large buckets take
    radius / 2 flips, rounded down, and for an odd radius pairs that differ by it are found from
    either side: a fingerprint is also sent to the centres one flip further.
    """
    if not 0 <= radius <= 4:
        raise ValueError("radius 0 to 4")
    tables, own = masks(radius), [c for c in distinct.columns if c == "seed"]
    bucketed, kind = [*own, "t", "key"], "seed int, " if own else ""
    dealt = _dealt(distinct, radius)
    crowded = stage(dealt.withColumn("n", F.count("*").over(Window.partitionBy(*bucketed))).where("n > 1"), "simhash-buckets")

    # buckets of bounded size: all pairs, the arrays hold at most `bucket` values
    small = crowded.where(F.col("n") <= bucket).groupBy(*bucketed).agg(F.sort_array(F.collect_list("fp")).alias("fps"))
    pairs = (
        small.select(*own, "fps", F.posexplode("fps").alias("i", "u"))
        .select(*own, "u", F.explode(F.slice("fps", F.col("i") + 2, bucket)).alias("v"))
        .where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= radius)
    )

    # larger ones, still bounded: one task each
    middle = crowded.where((F.col("n") > bucket) & (F.col("n") <= crowd)).select(*bucketed, "fp")
    found = (_crowd_pairs if near_only else _crowd_links)(radius)
    reached = middle.groupBy(*bucketed).applyInPandas(_per_seed(found, own), f"{kind}u long, v long")

    # the others: what meets at a centre is linked to the least of it
    large = crowded.where(F.col("n") > crowd)
    centres = large.select(*own, "t", "fp").mapInPandas(_centres(tables, radius, own), f"{kind}c long, inner boolean, fp long")
    least = centres.groupBy(*own, "c").agg(F.min(F.when(F.col("inner"), F.col("fp"))).alias("m"))
    met = centres.join(least, [*own, "c"]).where("m is not null and fp <> m").select(*own, F.least("fp", "m").alias("u"), F.greatest("fp", "m").alias("v"))
    return pairs.unionByName(reached).unionByName(met).distinct()


def near_duplicates(documents: DataFrame, radius: int = 2, words: int = 3, seed: int = 42) -> DataFrame:
    """``doc_id``, ``fp`` and ``component_id``, the least doc_id that links reach.

    One row per row of ``documents``. Texts without a word share the fingerprint zero and so are
    linked. Rows with a null doc_id take part; a component without any id has a null component_id.
    """
    return grouped(stage(fingerprints(documents, words, seed), "simhash"), radius)


def grouped(marked: DataFrame, radius: int = 2, group: str | None = None) -> DataFrame:
    """``marked`` (``doc_id``, ``fp`` and any more) with ``component_id``, and in ``group`` the least fingerprint reached."""
    distinct = stage(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    reached = components(links(distinct.select("fp"), radius)).withColumnRenamed("node", "fp")
    named = distinct.join(reached, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    ids = named.groupBy("component").agg(F.min("least").alias("component_id"))
    of_fp = named.join(ids, "component").select("fp", "component_id", *([F.col("component").alias(group)] if group else []))
    return marked.join(of_fp, "fp", "left")


def one_of_each(documents: DataFrame, radius: int = 2, words: int = 3, seed: int = 42) -> DataFrame:
    """One row of each group of near-duplicates, with all its columns.

    It is the row with the least id (null last), then with the least hash of its text; of rows that
    agree in both any one stays, as they hold the same text. Columns that start with ``_near_`` go.
    """
    plain = documents.drop("_near_id", "_near_hash")
    marked = stage(_marked(plain, words, seed), "simhash")
    named = grouped(marked.select("doc_id", "fp", "_near_hash"), radius, "_near_group")
    rank = F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "_near_hash")
    least = named.groupBy("_near_group").agg(F.min(rank).alias("k"))
    kept = least.select(F.col("k.doc_id").alias("_near_id"), F.col("k._near_hash").alias("_near_of"))
    hashed = plain.withColumn("_near_hash", _text_hash())
    same = F.col("doc_id").eqNullSafe(F.col("_near_id")) & (F.col("_near_hash") == F.col("_near_of"))
    chosen = hashed.join(kept, same).drop("_near_id", "_near_of")
    return chosen.dropDuplicates(["doc_id", "_near_hash"]).drop("_near_hash")


# ---- groups of texts with similar shingles


def word_set_fingerprints(raw: bytes, seeds: int) -> np.ndarray:
    """``seeds`` SimHashes of the set of a text's different words, each with hashes of its own."""
    words = set(raw.lower().split())
    if not words:
        return np.zeros(seeds, np.uint64)
    first = np.fromiter((xxhash.xxh64_intdigest(w, 42) for w in words), np.uint64, len(words))
    out = np.zeros(seeds, np.uint64)
    for seed in range(seeds):
        mixed = first ^ np.uint64((seed * 0x9E3779B97F4A7C15) & ((1 << 64) - 1))
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            mixed = (mixed ^ (mixed >> np.uint64(shift))) * np.uint64(factor)
        mixed ^= mixed >> np.uint64(31)
        ones = np.zeros(BITS, np.int64)
        for at in range(0, len(mixed), 1 << 16):
            part = mixed[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
            ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[seed] = np.packbits(2 * ones > len(mixed), bitorder="little").view("<u8")[0]
    return out


def shingles(text: str, width: int) -> set[bytes]:
    """Different shingles of a text's words, A-Z lower-cased; of fewer words the whole sequence."""
    words = text.encode().lower().split()
    return {b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def jaccard(a: set, b: set) -> float:
    """Shared part of two sets; two empty ones are equal."""
    return len(a & b) / len(a | b) if a or b else 1.0


def candidate_pairs(classes: DataFrame, seeds: int, radius: int) -> DataFrame:
    """``u`` < ``v``: those pairs of ``classes(tid, fps)`` within ``radius`` under any of the seeds that meet first.

    Texts of one fingerprint meet the least of them, which also stands for them before other fingerprints. In a
    bucket of more than FEW fingerprints each meets the least and the nearest within the radius, so these pairs
    grow with the texts of a group, not with its pairs. ``remaining_pairs`` has what they leave open.
    """
    own = classes.select("tid", F.posexplode(F.slice("fps", 1, seeds)).alias("seed", "fp"))
    least = stage(own.groupBy("seed", "fp").agg(F.min("tid").alias("least")), "similar-fingerprints")
    equal = own.join(least, ["seed", "fp"]).where("tid <> least").select(F.col("least").alias("u"), F.col("tid").alias("v"))
    near = links(least.select("seed", "fp"), radius, bucket=FEW, near_only=True)
    one, two = (least.select("seed", F.col("fp").alias(c), F.col("least").alias(f"_{c}")) for c in ("u", "v"))
    met = near.join(one, ["seed", "u"]).join(two, ["seed", "v"]).select(F.least("_u", "_v").alias("u"), F.greatest("_u", "_v").alias("v"))
    return stage(equal.unionByName(met).distinct(), "similar-candidates")


def _crowd_apart(radius: int):
    """A function on one bucket of ``fp``, ``low``, ``high``: all pairs within the radius that are not of one group."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("fp")
        fps, low, high = (frame[c].to_numpy() for c in ("fp", "low", "high"))
        bits, out = fps.view(np.uint64), []
        for at in range(0, len(fps), 256):
            part = slice(at, at + 256)
            near = np.bitwise_count(bits[part, None] ^ bits) <= radius
            near &= (np.minimum(low[part, None], low) < np.maximum(high[part, None], high)) & (fps[part, None] < fps)
            i, j = np.nonzero(near)
            out.append(np.stack([fps[i + at], fps[j]], axis=1))
        return pd.DataFrame(np.concatenate(out), columns=["u", "v"])

    return run


def mixed_buckets(named: DataFrame, radius: int) -> DataFrame:
    """The rows of ``named`` in each bucket that holds more than one group, with the bucket's size ``n``.

    The size is the number of fingerprints, or of ``texts`` where ``named`` counts them. A bucket that holds a
    single group is left before any pairs are made.
    """
    bucket = Window.partitionBy(*(c for c in ("seed", "t", "key") if c != "seed" or c in named.columns))
    size = F.sum("texts") if "texts" in named.columns else F.count("*")
    told = _dealt(named, radius).withColumns({"n": size.over(bucket), "_low": F.min("low").over(bucket), "_high": F.max("high").over(bucket)})
    return stage(told.where("_low < _high").drop("_low", "_high"), "simhash-mixed-buckets")


def _apart(pairs: DataFrame, own: list[str], radius: int) -> DataFrame:
    """Those of ``pairs``, structs ``u`` and ``v``, that are within the radius and span more than one group."""
    near = F.bit_count(F.col("u.fp").bitwiseXOR(F.col("v.fp"))) <= radius
    return pairs.where(near & (F.least("u.low", "v.low") < F.greatest("u.high", "v.high"))).select(*own, F.col("u.fp").alias("u"), F.col("v.fp").alias("v"))


def _few_apart(mixed: DataFrame, radius: int, bucket: int) -> DataFrame:
    """Pairs within the radius of more than one group, from buckets of up to ``bucket``."""
    own = [c for c in mixed.columns if c == "seed"]
    members = F.sort_array(F.collect_list(F.struct("fp", "low", "high"))).alias("all")
    small = mixed.where(F.col("n") <= bucket).groupBy(*own, "t", "key").agg(members)
    pairs = small.select(*own, "all", F.posexplode("all").alias("i", "u")).select(*own, "u", F.explode(F.slice("all", F.col("i") + 2, bucket)).alias("v"))
    return _apart(pairs, own, radius)


def links_apart(named: DataFrame, radius: int, bucket: int = BUCKET, crowd: int = CROWD) -> DataFrame:
    """All pairs ``u`` < ``v`` within the radius of ``named(fp, low, high)``, or of each ``seed``, that span more than one group.

    ``low`` and ``high`` are the least and the greatest group of the texts of a fingerprint. A bucket, or a
    centre of a larger one, that holds a single group has no such pair and is left before any are made.
    """
    tables, own = masks(radius), [c for c in named.columns if c == "seed"]
    bucketed, kind = [*own, "t", "key"], "seed int, " if own else ""
    crowded = mixed_buckets(named, radius)
    middle = crowded.where((F.col("n") > bucket) & (F.col("n") <= crowd)).select(*bucketed, "fp", "low", "high")
    reached = middle.groupBy(*bucketed).applyInPandas(_per_seed(_crowd_apart(radius), own), f"{kind}u long, v long")

    large = crowded.where(F.col("n") > crowd).select(*own, "t", "fp")
    centres = large.mapInPandas(_centres(tables, radius, own), f"{kind}c long, inner boolean, fp long")
    centres = centres.select(*own, "c", "fp").distinct().join(named, [*own, "fp"])
    held = centres.groupBy(*own, "c").agg((F.min("low") < F.max("high")).alias("mixed")).where("mixed").select(*own, "c")
    at = stage(centres.join(held, [*own, "c"]).select(*own, "c", F.struct("fp", "low", "high").alias("u")), "simhash-mixed-centres")
    met = at.join(at.withColumnRenamed("u", "v"), [*own, "c"]).where("u.fp < v.fp")

    return _few_apart(crowded, radius, bucket).unionByName(reached).unionByName(_apart(met, own, radius)).distinct()


def prefix_pairs(texts: DataFrame, similarity: float, width: int, seeds: int, radius: int) -> DataFrame:
    """``u`` < ``v``: of ``texts(tid, of, fps, text)`` those pairs within the radius under any seed, of different
    groups ``of``, that may have shingle sets of the given Jaccard similarity. No such pair is left out.

    Shingles are ordered by how few of these texts have them. Of two sets as similar as that the smaller one,
    of n shingles, shares one of its first n - ceil(2s / (1 + s) n) + 1 with the first m - ceil(s m) + 1 of the larger
    one's m; and from the first that both have, what is left of either must suffice for the overlap. A crowd of
    texts that differ in more than that meets in few pairs; those near the threshold still meet.
    """

    def listed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in range(len(frame)):
                found = shingles(frame["text"].iloc[row], width) or {b""}
                hashes = np.array([xxhash.xxh64_intdigest(s) for s in found], np.uint64).view(np.int64)
                yield pd.DataFrame({"tid": frame["tid"].iloc[row], "n": len(found), "h": hashes})

    whole = texts.select("tid", F.coalesce("text", F.lit("")).alias("text"))
    rows = stage(whole.mapInPandas(listed, "tid long, n int, h long"), "similar-shingles")
    counted = rows.withColumn("df", F.count("*").over(Window.partitionBy("h")))
    placed = counted.withColumn("i", F.row_number().over(Window.partitionBy("tid").orderBy("df", "h")))
    slack, both = 1e-9, similarity / (1 + similarity)
    probe = F.col("n") - F.ceil(similarity * F.col("n") - slack) + 1
    held = placed.where((F.col("i") <= probe) & (F.col("df") > 1)).join(texts.select("tid", "of", "fps"), "tid")
    held = stage(held, "similar-prefixes")
    first = held.where(F.col("i") <= F.col("n") - F.ceil(2 * both * F.col("n") - slack) + 1)
    u, v = first.alias("u"), held.alias("v")
    smaller = F.struct("u.n", "u.tid") < F.struct("v.n", "v.tid")
    left = 1 + F.least(F.col("u.n") - F.col("u.i"), F.col("v.n") - F.col("v.i"))
    enough = (F.col("u.n") >= similarity * F.col("v.n") - slack) & (left >= both * (F.col("u.n") + F.col("v.n")) - slack)
    near = F.lit(False)
    for seed in range(seeds):
        near |= F.bit_count(F.col("u.fps")[seed].bitwiseXOR(F.col("v.fps")[seed])) <= radius
    met = u.join(v, (F.col("u.h") == F.col("v.h")) & smaller & (F.col("u.of") != F.col("v.of")) & enough & near)
    return met.select(F.least("u.tid", "v.tid").alias("u"), F.greatest("u.tid", "v.tid").alias("v")).distinct()


def remaining_pairs(
    classes: DataFrame, compared: DataFrame, linked: DataFrame, seeds: int, radius: int,
    read: Callable[[DataFrame], DataFrame], similarity: float, width: int,
) -> DataFrame:
    """``u`` < ``v``: the pairs within ``radius`` under any seed that are neither ``compared`` nor of one group.

    ``linked(node, component)`` are the groups found so far. A pair of one group needs no comparison, so the
    groups that these pairs complete are those of all pairs within the radius. A bucket of up to MIXED texts gives
    all such pairs. Texts of larger ones, which ``read`` gives for their ids, meet by their shingles, so
    pairs that cannot reach the similarity are not made.
    """
    named = classes.select("tid", "fps").join(linked.withColumnRenamed("node", "tid"), "tid", "left")
    named = stage(named.select("tid", "fps", F.coalesce("component", "tid").alias("of")), "similar-named")
    own = named.select("tid", "of", F.posexplode(F.slice("fps", 1, seeds)).alias("seed", "fp"))
    groups = F.min("of").alias("low"), F.max("of").alias("high"), F.count("*").alias("texts")
    spans = stage(own.groupBy("seed", "fp").agg(*groups), "similar-spans")
    mixed = mixed_buckets(spans, radius)
    # a fingerprint of several groups is in a mixed bucket of every table
    few = mixed.where((F.col("n") <= MIXED) & (F.col("low") < F.col("high")))
    equal = few.select("seed", F.col("fp").alias("u"), F.col("fp").alias("v"))
    near = equal.unionByName(_few_apart(mixed, radius, MIXED)).distinct()
    one, two = (own.select("seed", F.col("fp").alias(c), F.col("tid").alias(f"_{c}"), F.col("of").alias(f"_of_{c}")) for c in ("u", "v"))
    met = near.join(one, ["seed", "u"]).join(two, ["seed", "v"]).where("_of_u <> _of_v")
    every = met.select(F.least("_u", "_v").alias("u"), F.greatest("_u", "_v").alias("v"))

    crowds = mixed.where(F.col("n") > MIXED).select("seed", "fp").distinct()
    crowd = stage(own.join(crowds, ["seed", "fp"], "left_semi").select("tid").distinct(), "similar-crowds")
    texts = stage(named.join(read(crowd), "tid"), "similar-crowd-texts")
    every = every.unionByName(prefix_pairs(texts, similarity, width, seeds, radius)).distinct()
    return stage(every.join(compared, ["u", "v"], "left_anti"), "similar-remaining")


def similar_pairs(candidates: DataFrame, texts: DataFrame, similarity: float, width: int) -> DataFrame:
    """The ``candidates`` whose whole texts (``tid``, ``text``) have shingle sets of that Jaccard similarity."""
    both = candidates.join(texts.select(F.col("tid").alias("u"), F.col("text").alias("a")), "u")
    both = both.join(texts.select(F.col("tid").alias("v"), F.col("text").alias("b")), "v")

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            kept = [jaccard(shingles(a, width), shingles(b, width)) >= similarity for a, b in zip(frame["a"], frame["b"], strict=True)]
            yield frame.loc[kept, ["u", "v"]]

    return both.select("u", "v", "a", "b").mapInPandas(compare, "u long, v long")


def one_of_similar(documents: DataFrame, similarity: float = 0.8, width: int = 5, seeds: int = 3, radius: int = 4) -> DataFrame:
    """One row of each group of texts linked by a shingle similarity of ``similarity`` or more, with all its columns.

    An edit of one word changes ``width`` shingles, so texts that are similar by shingles are far closer by
    their sets of words: candidates are pairs within ``radius`` bits under any of ``seeds`` fingerprints of
    these sets, and each candidate is compared whole, unless earlier comparisons have linked it.

    The row kept is that with the least id (null last), then with the least hashes of its text; of rows that
    agree in all any one stays, as they hold the same text. Null texts are empty and, like texts without a
    word, equal. Columns that start with ``_near_`` go.
    """
    plain = documents.drop("_near_id", "_near_h1", "_near_h2")
    h1, h2 = _text_hash(), F.xxhash64(F.lit(1), F.coalesce("text", F.lit("")))
    keyed = texts_of(plain).withColumns({"h1": h1, "h2": h2})

    def marks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            fps = [word_set_fingerprints(t.encode(), seeds).view(np.int64) for t in frame["text"]]
            yield frame[["doc_id", "h1", "h2"]].assign(fps=fps)

    kind = dict(keyed.dtypes)["doc_id"]
    marked = stage(keyed.mapInPandas(marks, f"doc_id {kind}, h1 long, h2 long, fps array<long>"), "similar-marks")
    rank = F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "h1", "h2")
    found = marked.groupBy("h1", "h2").agg(F.first("fps").alias("fps"), F.min(rank).alias("best"))
    classes = stage(found.withColumn("tid", F.monotonically_increasing_id()), "similar-classes")

    def read(ids: DataFrame) -> DataFrame:
        wanted = classes.join(ids, "tid", "left_semi").select("tid", "h1", "h2", F.col("best.doc_id").alias("_first"))
        met = keyed.join(wanted, ["h1", "h2"]).where(F.col("doc_id").eqNullSafe(F.col("_first")))
        return met.select("tid", "text").dropDuplicates(["tid"])

    def similar(pairs: DataFrame) -> DataFrame:
        texts = stage(read(pairs.select(F.col("u").alias("tid")).union(pairs.select("v")).distinct()), "similar-texts")
        return stage(similar_pairs(pairs, texts, similarity, width), "similar-pairs")

    candidates = candidate_pairs(classes, seeds, radius)
    first = similar(candidates)
    linked = components(first)
    rest = remaining_pairs(classes, candidates, linked, seeds, radius, read, similarity, width)
    linked = components(first.unionByName(similar(rest)))
    grouped_ = classes.select("tid", "best").join(linked.withColumnRenamed("node", "tid"), "tid", "left")
    kept = grouped_.groupBy(F.coalesce("component", "tid").alias("_group")).agg(F.min("best").alias("k"))
    kept = kept.select(F.col("k.doc_id").alias("_near_id"), F.col("k.h1").alias("_near_h1"), F.col("k.h2").alias("_near_h2"))
    hashed = plain.withColumns({"_near_one": h1, "_near_two": h2})
    same = F.col("doc_id").eqNullSafe(F.col("_near_id")) & (F.col("_near_one") == F.col("_near_h1")) & (F.col("_near_two") == F.col("_near_h2"))
    chosen = hashed.join(kept, same).drop("_near_id", "_near_h1", "_near_h2")
    return chosen.dropDuplicates(["doc_id", "_near_one", "_near_two"]).drop("_near_one", "_near_two")


def _text_hash() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def _marked(documents: DataFrame, words: int, seed: int) -> DataFrame:
    hashed = documents.withColumn("_near_hash", _text_hash())
    return fingerprints(hashed, words, seed, "_near_hash")


def as_hex(fp: str) -> Column:
    """A signed long as 16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))
