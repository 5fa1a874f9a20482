"""URL filters: rules by host and path, and the ratio of two character language models for all other URLs.

A smoothed variable-order Markov model is counted for the URLs that rules accept and another for those
that rules reject. The probability of a byte mixes the orders from 0 up: an order weighs as much as its
context was seen, so a rare context leaves the word to the shorter ones,

    p_k = (n(context, byte) + strength p_(k-1)) / (n(context) + strength).

A URL's score is the difference of the two log-likelihoods divided by its length. A fifth of the ruled
URLs, by the hash of the URL, is kept from the counts; on them the threshold is chosen that judges both
kinds best.

Counts are tables with a key for each n-gram, its bytes side by side, so none share a key and the model
grows with the URLs. URLs are cut into blocks; the distinct n-grams of all blocks meet the tables in joins,
and each block adds up its own from a sorted array. Nothing of it passes through the driver or a broadcast
but the histogram of held-out scores, BINS numbers for either kind.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.llm.common import hash_share
from tallyweave.state import stage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of an n-gram: the longest context and what follows it.
ORDERS = 5
#: Marks around a URL, bytes that UTF-8 never uses, and how many bytes can follow a context.
START, END, FOLLOWERS = 0xFF, 0xFE, 255
#: URLs whose n-grams are listed together.
BLOCK = 8192
BINS = 4096
RANGE = 8.0


@dataclass(frozen=True)
class Rule:
    """``text`` is a host, then a path that starts with a slash; it fits the host and its subdomains."""

    verdict: str
    text: str

    def fits(self, host: Column, path: Column) -> Column:
        name, _, rest = self.text.partition("/")
        return ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{rest}")


@dataclass(frozen=True)
class Settings:
    """``strength``: how often a context must be seen to weigh as much as all shorter ones."""

    strength: float = 4.0
    held: float = 0.2
    seed: int = 9


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty without ``://`` or for null."""
    host = F.regexp_extract(_after(url), "^([^/?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """From the host's end up to ``?``, ``#`` or the end; empty without ``://`` or for null."""
    return F.coalesce(F.regexp_extract(_after(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def _after(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def ruled(pages: DataFrame, rules: list[Rule], url: str = "url") -> DataFrame:
    """``pages`` with ``host``, ``path`` and ``rule``: the text of the longest rule that fits, else null.

    The rules are part of the plan, so their number is for the author of a rule list, not for data.
    Columns of these names are replaced. Of rules with one text the first counts.
    """
    placed = pages.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    longest = sorted(rules, key=lambda r: -len(r.text))
    fitting = [F.when(r.fits(F.col("host"), F.col("path")), F.lit(r.text)) for r in longest]
    return placed.withColumn("rule", F.coalesce(*fitting, F.lit(None).cast("string")))


# ---- the language models


def grams(urls: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Key of the n-gram that ends at each byte and at the end of each URL; the URL's number."""
    opening, end = bytes([START]) * (ORDERS - 1), bytes([END])
    line = np.frombuffer(opening + (end + opening).join([u.encode() for u in urls]) + end, np.uint8).astype(np.int64)
    keys = np.zeros(len(line) - ORDERS + 1, np.int64)
    for i in range(ORDERS):
        keys = keys << 8 | line[i : i + len(keys)]
    last = line[ORDERS - 1 :]
    owner = np.cumsum(last == END) - (last == END)
    kept = last != START
    return keys[kept], owner[kept]


def counted(urls: DataFrame) -> DataFrame:
    """``gram``, ``good`` and ``bad``: how often the longest n-grams occur in ``url`` by ``accepted``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            good = frame["accepted"].to_numpy(bool)
            keys, owner = grams(frame["url"].tolist()) if len(frame) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            found, place = np.unique(keys, return_inverse=True)
            both = [np.bincount(place[good[owner] == kind], minlength=len(found)) for kind in (True, False)]
            yield pd.DataFrame({"gram": found, "good": both[0], "bad": both[1]})

    partial = urls.select("url", "accepted").mapInPandas(run, "gram long, good long, bad long")
    return partial.groupBy("gram").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))


def log_ratios(wanted: DataFrame, counts: DataFrame, strength: float) -> DataFrame:
    """``gram`` and ``ratio``: the log of p(last byte | others) when accepted less that when rejected.

    ``wanted`` has each ``gram`` once. From the shortest context up each order's counts of the n-gram and of
    its context join; what is not there was never seen.
    """
    rows = wanted.select("gram").withColumns({"p1": F.lit(1.0 / FOLLOWERS), "p0": F.lit(1.0 / FOLLOWERS)})
    for k in range(1, ORDERS + 1):
        key = F.col("gram").bitwiseAND((1 << (8 * k)) - 1)
        tail = counts.groupBy(key.alias("key")).agg(F.sum("good").alias("n1"), F.sum("bad").alias("n0"))
        tail = stage(tail, "url-ngrams")
        head = tail.groupBy(F.shiftright("key", 8).alias("context")).agg(F.sum("n1").alias("t1"), F.sum("n0").alias("t0"))
        rows = rows.withColumns({"key": key, "context": F.shiftright(key, 8)})
        # keys of one and two bytes have few values: their tables have 65,536 rows at most and go to each task
        rows = rows.join(F.broadcast(tail) if k <= 2 else tail, "key", "left")
        rows = rows.join(F.broadcast(head) if k <= 3 else head, "context", "left")
        mixed = {
            f"p{i}": (F.coalesce(f"n{i}", F.lit(0)) + strength * F.col(f"p{i}")) / (F.coalesce(f"t{i}", F.lit(0)) + strength) for i in (1, 0)
        }
        rows = rows.select("gram", *[p.alias(name) for name, p in mixed.items()])
    return rows.select("gram", (F.log("p1") - F.log("p0")).alias("ratio"))


def _blocks(rows: DataFrame) -> DataFrame:
    """``rows`` with ``block``, and in the first row of each block its distinct n-grams, sorted and compressed."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block = TaskContext.get().partitionId() << 32
        for frame in frames:
            for at in range(0, len(frame), BLOCK):
                part = frame.iloc[at : at + BLOCK]
                found = np.unique(grams(part["url"].tolist())[0])
                yield part.assign(block=block, grams=[zlib.compress(found.tobytes(), 1)] + [None] * (len(part) - 1))
                block += 1

    kinds = ", ".join(f"`{k}` {kind}" for k, kind in rows.dtypes)
    return rows.mapInPandas(run, f"{kinds}, block long, grams binary")


def _listed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for block, found in zip(frame["block"], frame["grams"], strict=True):
            yield pd.DataFrame({"block": block, "gram": np.frombuffer(zlib.decompress(found), np.int64)})


def _added_up(rows: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
    """The URLs of a block with their scores, from the block's n-grams with theirs."""
    known = known.sort_values("gram")
    keys, owner = grams(rows["url"].tolist())
    found = known["ratio"].to_numpy()[np.searchsorted(known["gram"].to_numpy(), keys)]
    return rows.drop(columns=["block", "grams"]).assign(score=np.bincount(owner, found) / np.bincount(owner))


def scored(rows: DataFrame, urls: DataFrame, settings: Settings) -> DataFrame:
    """``rows`` (with ``url``, not null) and their ``score`` per byte under the counts of ``urls(url, accepted)``."""
    counts = stage(counted(urls), "url-counts")
    blocks = stage(_blocks(rows), "url-blocks")
    lists = stage(blocks.where("grams is not null").select("block", "grams").mapInPandas(_listed, "block long, gram long"), "url-lists")
    ratios = log_ratios(lists.select("gram").distinct(), counts, settings.strength)
    known = lists.join(ratios, "gram").select("block", "gram", "ratio")
    kinds = ", ".join(f"`{k}` {kind}" for k, kind in rows.dtypes)
    pairs = blocks.groupBy("block").cogroup(known.groupBy("block"))
    return pairs.applyInPandas(_added_up, f"{kinds}, score double")


def threshold(held: DataFrame) -> float:
    """The score that judges ``held(score, accepted)`` best, from a histogram of BINS bins."""
    at = F.floor((F.col("score") + RANGE) / (2 * RANGE) * BINS).cast("long")
    placed = held.select(F.greatest(F.lit(0), F.least(F.lit(BINS - 1), at)).alias("bin"), "accepted")
    rows = placed.groupBy("bin").agg(F.count_if("accepted").alias("good"), F.count_if(~F.col("accepted")).alias("bad")).collect()
    good, bad = np.zeros(BINS), np.zeros(BINS)
    for row in rows:
        good[row["bin"]], bad[row["bin"]] = row["good"], row["bad"]
    return _threshold(good, bad)


def _threshold(good: np.ndarray, bad: np.ndarray) -> float:
    """The lower edge of the bin that judges both kinds best; the middle of those that do equally well."""
    if not good.sum() or not bad.sum():
        return float("-inf")
    lost = np.concatenate([[0], np.cumsum(good)]) / good.sum()
    passed = 1 - np.concatenate([[0], np.cumsum(bad)]) / bad.sum()
    best = np.flatnonzero(np.isclose(lost + passed, (lost + passed).min()))
    return float(-RANGE + 2 * RANGE * best[len(best) // 2] / BINS)


def judged(pages: DataFrame, rules: list[Rule], settings: Settings = Settings()) -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule``, ``score`` (null under a rule) and ``verdict`` of every row.

    A URL without a rule is allowed if its score reaches the threshold; without ruled URLs of both kinds all
    are. A null or empty URL has no likelihood; it is scored like an empty one. URLs of any length are scored
    whole, and equal URLs alike. Repeated rows and null ids are rows like others; other columns go, and an
    empty table gives none.
    """
    placed = ruled(pages.select("page_id", "url"), rules)
    verdicts = {r.text: r.verdict for r in reversed(rules)}
    by_rule = F.coalesce(*[F.when(F.col("rule") == t, F.lit(v)) for t, v in verdicts.items()], F.lit(None).cast("string"))
    known = placed.withColumn("verdict", by_rule).withColumn("url", F.coalesce("url", F.lit("")))
    held = F.col("verdict").isNotNull() & (hash_share("url", seed=settings.seed) < settings.held)
    told = known.where(F.col("verdict").isNotNull() & ~held).select("url", (F.col("verdict") == "allow").alias("accepted"))
    found = stage(scored(known.where(F.col("verdict").isNull() | held), told, settings), "url-scores")
    least = threshold(found.where("verdict is not null").select("score", (F.col("verdict") == "allow").alias("accepted")))
    columns = ["page_id", "host", "path", "rule"]
    by_score = F.when(F.col("score") >= F.lit(least), "allow").otherwise("block")
    open_ = found.where("verdict is null").select(*columns, by_score.alias("verdict"), "score")
    fixed = known.where("verdict is not null").select(*columns, "verdict", F.lit(None).cast("double").alias("score"))
    return open_.unionByName(fixed)
