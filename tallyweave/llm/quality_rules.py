"""Quality rules: counts of a text's words, symbols and repeats, and bands of n-gram perplexity by language.

The language model is a modified Kneser-Ney model of the UTF-8 bytes of words, order 5, one for each
language. Every task counts the n-grams of all words of its texts, Spark adds the counts, and the
smoothed probabilities stay a table with a key for each n-gram: its bytes side by side, so no two n-grams
share a key whatever the script. START and END are bytes that UTF-8 never uses. Texts are cut into blocks;
the distinct n-grams of a block's words meet the table in a join and come back to the block, which adds
them up for each text from sorted arrays. Nothing of it passes through the driver or a broadcast.

The bands come from the different texts that pass the base rules. Their centre is the median, over a
language's sources, of each source's median log-perplexity, and their width REACH times the median, over
the sources, of each source's median distance from that centre. A source counts once, however large it is,
and either median holds while less than half of what it is taken of is junk.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.llm.common import texts_of
from tallyweave.state import stage

ORDER = 5
CODE_BITS = 8
#: Marks around a word: bytes that no UTF-8 text holds.
START, END = 0xFF, 0xFE
#: Texts, and about as many characters, whose words are listed together.
BLOCK, BLOCK_CHARS = 8192, 1 << 25
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\v\f\r"


@dataclass(frozen=True)
class Settings:
    """``reach``: median distances that a band holds on either side; ``least``: the least such distance that counts."""

    reach: float = 9.0
    least: float = 0.01
    min_words: int = 50
    max_repeat_percent: int = 50


# ---- counts of one text


def repeated_words(words: list[bytes], window: int = 3) -> int:
    """Words in windows that the text holds twice or more, the first such window included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    hashes = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    keys = np.zeros(n, np.uint64)
    for i in range(window):
        keys = (keys ^ hashes[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        keys ^= keys >> np.uint64(31)
    ordered = np.sort(keys)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    opens = np.isin(keys, twice).astype(np.int64)
    covered = np.zeros(len(words) + 1, np.int64)
    covered[:n] += opens
    covered[window : window + n] -= opens
    return int((np.cumsum(covered[:-1]) > 0).sum())


def base_counts(text: str, raw: bytes, words: list[bytes]) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    lines = [line for line in raw.split(b"\n") if line.strip()]
    return (
        len(words),
        len(text) - sum(map(text.count, BLANKS)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
    )


# ---- n-grams


def slot_of(lang: str | None) -> int:
    """The key of a language: 64 bits of a hash of its name. Null is a language of its own."""
    if lang is None:
        return 0
    return int.from_bytes(blake2b(lang.encode(), digest_size=8).digest(), "little", signed=True)


def grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Key of the n-gram that ends at each byte and at the end of each word; the word's number."""
    opening, end = bytes([START]) * (ORDER - 1), bytes([END])
    line = opening + (end + opening).join(words) + end
    codes = np.frombuffer(line, np.uint8).astype(np.int64)
    keys = np.zeros(len(codes) - ORDER + 1, np.int64)
    for i in range(ORDER):
        keys = keys << CODE_BITS | codes[i : i + len(keys)]
    last = codes[ORDER - 1 :]
    word = np.cumsum(last == END) - (last == END)
    kept = last != START
    return keys[kept], word[kept]


def counted(documents: DataFrame) -> DataFrame:
    """``slot``, ``gram``, ``n`` over all words of all texts; tasks add up before the shuffle."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for frame in frames:
            for slot, texts in frame["text"].groupby(frame["lang"].map(slot_of, na_action=None)):
                for at in range(0, len(texts), 512):
                    often: Counter[bytes] = Counter()
                    for text in texts.iloc[at : at + 512]:
                        often.update(text.encode().split())
                    if often:
                        keys, word = grams(list(often))
                        weights = np.fromiter(often.values(), np.int64, len(often))[word]
                        held[slot] = _added(held.get(slot), keys, weights)
        for slot, (keys, n) in held.items():
            yield pd.DataFrame({"slot": slot, "gram": keys, "n": n})

    chosen = texts_of(documents, F.col("lang").cast("string").alias("lang")).select("text", "lang")
    partial = chosen.mapInPandas(run, "slot long, gram long, n long")
    return partial.groupBy("slot", "gram").agg(F.sum("n").alias("n"))


def _added(old: tuple[np.ndarray, np.ndarray] | None, keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if old is not None:
        keys, n = np.concatenate([old[0], keys]), np.concatenate([old[1], n])
    found, place = np.unique(keys, return_inverse=True)
    return found, np.bincount(place, n, len(found)).astype(np.int64)


def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


# ---- the model as a table


def discounts(sizes: DataFrame) -> DataFrame:
    """``sizes`` with modified Kneser-Ney discounts ``d1``, ``d2``, ``d3`` from the counts of counts ``n1`` to ``n4``.

    Where these give none that lies between 0 and the count, the discount is 0.5, 1 or 1.5.
    """
    n1, n2, n3, n4 = (F.col(f"n{i}").cast("double") for i in (1, 2, 3, 4))
    y = n1 / (n1 + 2 * n2)
    whole = (n1 > 0) & (n2 > 0) & (n3 > 0) & (n4 > 0)
    for i, (found, usual) in enumerate(((1 - 2 * y * n2 / n1, 0.5), (2 - 3 * y * n3 / n2, 1.0), (3 - 4 * y * n4 / n3, 1.5)), 1):
        told = F.when(whole, F.when((found > 0) & (found < i), found))
        sizes = sizes.withColumn(f"d{i}", F.coalesce(told, F.lit(usual)))
    return sizes


def smoothed(count: DataFrame) -> DataFrame:
    """``slot``, ``gram``, ``logp``: interpolated modified Kneser-Ney for every n-gram of the highest order.

    ``count`` is a staged table of ``slot``, ``gram``, ``n``. A lower order counts the bytes seen before an
    n-gram; n-grams at a word's start, before which there is none, keep their plain counts. A context has
    at most 256 n-grams, so no group of a window grows with the corpus. Discounts are a row for each order
    and language, in a table.
    """
    tables = {ORDER: count.select("slot", "gram", F.col("n").alias("raw"), F.col("n").alias("c"))}
    for k in range(ORDER - 1, 0, -1):
        key = F.col("gram").bitwiseAND(F.lit((1 << (k * CODE_BITS)) - 1)).alias("gram")
        found = tables[k + 1].groupBy("slot", key).agg(F.sum("raw").alias("raw"), F.count("*").alias("before"))
        opens = F.shiftright("gram", (k - 1) * CODE_BITS) == START
        tables[k] = stage(found.select("slot", "gram", "raw", F.when(opens, F.col("raw")).otherwise(F.col("before")).alias("c")), "ngrams")
    sums = [F.sum((F.col("c") == i).cast("long")).alias(f"n{i}") for i in (1, 2, 3, 4)]
    sizes = [t.groupBy("slot").agg(F.count("*").alias("size"), *sums).withColumn("k", F.lit(k)) for k, t in tables.items()]
    cuts = stage(discounts(reduce(DataFrame.unionByName, sizes)), "discounts").drop("n1", "n2", "n3", "n4")
    first = cuts.where("k = 1").select("slot", (1 / (F.col("size") + 1)).alias("first"))
    lower = None
    for k in range(1, ORDER + 1):
        by_slot = cuts.where(F.col("k") == k).drop("k", "size")
        context = Window.partitionBy("slot", F.shiftright("gram", CODE_BITS))
        kinds = [F.sum(wanted.cast("long")).over(context) for wanted in (F.col("c") == 1, F.col("c") == 2, F.col("c") > 2)]
        left = F.col("d1") * kinds[0] + F.col("d2") * kinds[1] + F.col("d3") * kinds[2]
        cut = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
        total = F.sum("c").over(context)
        known = tables[k].join(by_slot, "slot").select("slot", "gram", ((F.col("c") - cut) / total).alias("own"), (left / total).alias("left"))
        if k == 1:
            lower = known.join(first, "slot").select("slot", "gram", (F.col("own") + F.col("left") * F.col("first")).alias("p"))
        else:
            suffix = F.col("gram").bitwiseAND(F.lit((1 << ((k - 1) * CODE_BITS)) - 1))
            below = lower.select("slot", F.col("gram").alias("suffix"), F.col("p").alias("below"))
            joined = known.withColumn("suffix", suffix).join(below, ["slot", "suffix"])
            lower = joined.select("slot", "gram", (F.col("own") + F.col("left") * F.col("below")).alias("p"))
    return lower.select("slot", "gram", F.log("p").cast("float").alias("logp"))


# ---- scores by a join

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _blocks(documents: DataFrame) -> DataFrame:
    """Every whole text with its counts and its words as places in its block's list of distinct words.

    A block has up to BLOCK texts of one task, up to about BLOCK_CHARS characters. Its first row
    has the list: ``words``, one a line, and ``slots``, the language of each.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block = TaskContext.get().partitionId() << 32
        for frame in frames:
            langs, texts = frame["lang"].tolist(), frame["text"].tolist()
            slots, at = [slot_of(lang) for lang in langs], 0
            while at < len(texts):
                end, chars = at, 0
                while end < len(texts) and end - at < BLOCK and chars < BLOCK_CHARS:
                    chars += len(texts[end])
                    end += 1
                place: dict[tuple[int, bytes], int] = {}
                rows, used, sizes = [], [], []
                for text, slot in zip(texts[at:end], slots[at:end], strict=True):
                    raw = text.encode()
                    words = raw.split()
                    rows.append(base_counts(text, raw, words))
                    sizes.append(sum(map(len, words)) + len(words))
                    used.append(np.array([place.setdefault((slot, w), len(place)) for w in words], np.int64))
                out = pd.DataFrame(rows, columns=COUNTS)
                out["n_bytes"] = sizes
                out.insert(0, "text_key", frame["text_key"].to_numpy()[at:end])
                out.insert(0, "source", frame["source"].tolist()[at:end])
                out.insert(0, "lang", langs[at:end])
                out.insert(0, "doc_id", frame["doc_id"].to_numpy()[at:end])
                often = np.zeros(len(place), np.int64)
                for u in used:
                    np.add.at(often, u, 1)
                order = np.argsort(-often, kind="stable")  # common words first: small places
                rank = np.empty(len(place), np.int64)
                rank[order] = np.arange(len(place))
                out["places"] = pd.Series([_written(rank[u]) for u in used], dtype=object)
                listed, none = list(place), [None] * (end - at - 1)
                listed = [listed[i] for i in order.tolist()]
                out["words"] = pd.Series([zlib.compress(b"\n".join(w for _, w in listed), 1), *none], dtype=object)
                out["slots"] = pd.Series([zlib.compress(np.array([s for s, _ in listed], np.int64).tobytes(), 1), *none], dtype=object)
                out["block"] = block
                yield out
                at, block = end, block + 1

    source = F.col("source").cast("string") if "source" in documents.columns else F.lit(None).cast("string")
    chosen = texts_of(documents, F.col("lang").cast("string").alias("lang"), source.alias("source")).withColumn("text_key", F.xxhash64("text"))
    counts = ", ".join(f"{c} long" for c in COUNTS)
    columns = f"lang string, source string, text_key long, {counts}, n_bytes long, places binary, words binary, slots binary, block long"
    return chosen.mapInPandas(run, f"doc_id {dict(chosen.dtypes)['doc_id']}, {columns}")


def _written(places: np.ndarray) -> bytes:
    """Places in any order, as compressed steps from one to the next larger."""
    steps = np.diff(np.sort(places), prepend=0).astype("<u4")
    return zlib.compress(steps.view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def _read(written: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(written), np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64))


def _words_of(words: bytes, slots: bytes) -> Iterator[tuple[int, np.ndarray, list[bytes]]]:
    """Each language of a block: its slot, the places of its words, the words."""
    slot_of_word = np.frombuffer(zlib.decompress(slots), np.int64)
    listed = zlib.decompress(words).split(b"\n") if len(slot_of_word) else []
    for slot in np.unique(slot_of_word).tolist():
        places = np.flatnonzero(slot_of_word == slot)
        yield slot, places, [listed[i] for i in places.tolist()]


def _wanted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The distinct n-grams of every block."""
    for frame in frames:
        for block, words, slots in zip(frame["block"], frame["words"], frame["slots"], strict=True):
            for slot, _, found in _words_of(words, slots):
                yield pd.DataFrame({"block": block, "slot": slot, "gram": np.unique(grams(found)[0])})


def _totals(texts: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
    """The texts of one block with their perplexities, from the block's n-grams with theirs."""
    first = texts.loc[texts["words"].notna()].iloc[0]
    size = len(zlib.decompress(first["slots"])) // 8
    scores = np.zeros(size)
    for slot, places, words in _words_of(first["words"], first["slots"]):
        mine = known[known["slot"] == slot].sort_values("gram")
        keys, word = grams(words)
        at, hit = _find(mine["gram"].to_numpy(), keys)
        if not hit.all():
            raise ValueError("a text has n-grams that were not counted")
        scores[places] = np.bincount(word, mine["logp"].to_numpy(float)[at], len(words))
    totals = [scores[_read(p)].sum() for p in texts["places"]]
    out = texts[["doc_id", "lang", "source", "text_key", *COUNTS]].copy()
    out["log_perplexity"] = [-t / n if n else None for t, n in zip(totals, texts["n_bytes"], strict=True)]
    return out


def measured(documents: DataFrame) -> DataFrame:
    """``doc_id``, ``lang``, ``source``, ``text_key``, the five counts and ``log_perplexity`` of every whole text.

    The log-perplexity is per byte, ends of words included, and null without a word.

    The model is that of all these texts (``lang``, null is a language of its own). It stays a table:
    each block's distinct n-grams meet it in a join, whatever its size.
    """
    model = smoothed(stage(counted(documents), "ngrams"))
    blocks = stage(_blocks(documents), "quality-blocks")
    lists = blocks.where("words is not null").select("block", "words", "slots")
    known = lists.mapInPandas(_wanted, "block long, slot long, gram long").join(model, ["slot", "gram"])
    kind = dict(blocks.dtypes)["doc_id"]
    counts = ", ".join(f"{c} long" for c in COUNTS)
    pairs = blocks.groupBy("block").cogroup(known.select("block", "slot", "gram", "logp").groupBy("block"))
    return pairs.applyInPandas(_totals, f"doc_id {kind}, lang string, source string, text_key long, {counts}, log_perplexity double")


def bands(rows: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``lang``, ``lowest``, ``highest``: the log-perplexities that a language's texts may have.

    From the rows that passed the base rules, equal texts of a source counting once.
    """
    median = lambda c: F.percentile_approx(c, 0.5, 1000)
    known = rows.where("log_perplexity is not null and not base_failed")
    single = stage(known.groupBy("lang", "source", "text_key").agg(F.min("log_perplexity").alias("x")), "perplexities")
    centres = single.groupBy("lang", "source").agg(median("x").alias("x")).groupBy("lang").agg(median("x").alias("centre"))
    met = single.join(centres.withColumnRenamed("lang", "_lang"), F.col("lang").eqNullSafe(F.col("_lang")))
    away = met.groupBy("lang", "source").agg(median(F.abs(F.col("x") - F.col("centre"))).alias("away"), F.first("centre").alias("centre"))
    wide = away.groupBy("lang").agg(median("away").alias("away"), F.first("centre").alias("centre"))
    reach = F.greatest(F.col("away"), F.lit(settings.least)) * settings.reach
    return wide.select("lang", (F.col("centre") - reach).alias("lowest"), (F.col("centre") + reach).alias("highest"))


def judged(documents: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row per document: the counts, ``log_perplexity``, ``base_failed``, ``in_band`` and ``kept``.

    Null text counts as empty. A text without a word fails the base rules; its perplexity is null and
    it is out of every band, as are all texts of a language none of which passes the base rules. Any
    character of any script is taken as its bytes. Texts of any length are counted whole; a perplexity on
    the edge of a band is inside. Repeated rows and null ids are rows like others; ``source`` may be
    missing or null, which is a source of its own, and other columns go. An empty table gives none.
    """
    failed = (F.col("n_words") < settings.min_words) | (
        100 * F.col("n_repeat_words") > settings.max_repeat_percent * F.col("n_words")
    )
    rows = stage(measured(documents).withColumn("base_failed", failed), "quality-rules")
    limits = bands(rows, settings).withColumnRenamed("lang", "band_lang")
    joined = rows.join(limits, F.col("lang").eqNullSafe(F.col("band_lang")), "left").drop("band_lang", "text_key")
    inside = F.coalesce(F.col("log_perplexity").between(F.col("lowest"), F.col("highest")), F.lit(False))
    return joined.withColumn("in_band", inside).withColumn("kept", ~F.col("base_failed") & F.col("in_band"))
