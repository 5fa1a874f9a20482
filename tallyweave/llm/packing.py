"""Packing tokenized texts into training sequences under several limits at once.

A text is cut into pieces of the sequence length and a rest. The rests are packed as vectors (tokens,
segments, loss-bearing tokens, each as a share of its limit): a sequence is opened, and as long as
anything fits it takes the piece whose vector has the largest dot product with the room that is left.
Pieces are dealt evenly to shards of about SHARD pieces, so the work and the memory of a task are
bounded and the few half-full sequences at a shard's end weigh little. Only counts and checksums are
kept of a piece, never its ids.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from string import punctuation
from unicodedata import is_normalized

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.state import stage

SHARD = 2048
REMEMBERED = 400_000
#: Above it, letters may change with their surroundings in lower case or normal form.
LATIN_END = "\u0250"


@dataclass(frozen=True)
class Limits:
    """What a sequence holds at most. ``segments``: pieces; ``loss``: tokens that bear loss."""

    tokens: int = 4096
    segments: int = 256
    loss: int = 4096


#: Bytes as the characters that byte-level vocabularies write them with: printable ones as they are.
SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
AS_SHOWN = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in SHOWN)}


class WordIds:
    """Ids of texts by a lower-casing byte-level tokenizer that drops white space, remembered by word.

    The tokenizer's pieces never cross white space, so a text's ids are those of its parts between
    single spaces and line ends, one after another. A part that is a word of Latin letters, with or
    without ASCII signs after it, needs no normal form and no search for pieces: its lower case goes to
    the tokenizer's model as it is, and the signs are one piece. All other parts go through the whole tokenizer.
    """

    def __init__(self, tokenizer: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        whole = Tokenizer.from_str(tokenizer)
        self.encode, self.merge = whole.encode_batch_fast, whole.model.tokenize
        self.parts: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def word(self, word: str) -> bytes:
        """Ids of one lower-case word of Latin letters, or of a run of ASCII signs."""
        shown = word if word.isascii() else word.encode().decode("latin-1").translate(AS_SHOWN)
        ids = self.words[word] = array("I", [t.id for t in self.merge(shown)]).tobytes()
        return ids

    def learn(self, parts: set[str]) -> None:
        """Encode the parts that are not remembered. The parts met first stay: the common ones are met early."""
        new = parts.difference(self.parts)
        for memory in (self.parts, self.words):
            if len(memory) + len(new) > REMEMBERED:
                for old in list(memory)[REMEMBERED // 2 :]:
                    del memory[old]
                new = parts.difference(self.parts)
        others, known, words = [], self.parts, self.words
        for part in new:
            word = part.rstrip(punctuation)
            if word.isalpha() and (word.isascii() or max(word) < LATIN_END):
                lowered = word.lower()
                if lowered.isascii() or (lowered.isalpha() and is_normalized("NFC", lowered)):
                    ids = words.get(lowered) or self.word(lowered)
                    if len(word) < len(part):
                        signs = part[len(word) :]
                        ids += words.get(signs) or self.word(signs)
                    known[part] = ids
                    continue
            others.append(part)
        for start in range(0, len(others), 4096):
            group = others[start : start + 4096]
            for part, found in zip(group, self.encode(group, add_special_tokens=False), strict=True):
                known[part] = array("I", found.ids).tobytes()

    def batch(self, texts: pd.Series) -> Iterator[bytes]:
        cut: list[list[str]] = []
        waiting: set[str] = set()
        for text in texts:
            cut.append(text.replace("\n", " ").split(" "))
            waiting.update(cut[-1])
            if len(waiting) > REMEMBERED // 4:
                yield from self._known(cut, waiting)
                cut, waiting = [], set()
        yield from self._known(cut, waiting)

    def _known(self, cut: list[list[str]], waiting: set[str]) -> Iterator[bytes]:
        self.learn(waiting)
        known = self.parts.__getitem__
        for parts in cut:
            yield b"".join(map(known, parts))


def pieces(
    texts: DataFrame, tokenizer: str, keys: list[str], end_id: int, limits: Limits, bears_loss: Column | None = None
) -> DataFrame:
    """Pieces of every whole text: the keys, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``loss_tokens``.

    ``texts`` has the keys and ``text``; null counts as empty. ``tokenizer`` is the tokenizer's file as
    a string. Every text ends with ``end_id``, so an empty one is a piece of length 1. All tokens but
    the first of a piece bear loss; none do where ``bears_loss`` is false or null.
    """
    shared = texts.sparkSession.sparkContext.broadcast(tokenizer)
    loss = F.lit(True) if bears_loss is None else F.coalesce(bears_loss, F.lit(False))
    chosen = texts.select(*keys, F.coalesce("text", F.lit("")).alias("text"), loss.alias("bears_loss"))
    size = limits.tokens
    tail = np.array([end_id], "<u4").tobytes()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = WordIds(shared.value)
        for frame in frames:
            row, start, length, crc, total = [], [], [], [], []
            for i, ids in enumerate(encoder.batch(frame["text"])):
                ids += tail
                n = len(ids) // 4
                for at in range(0, n, size):
                    piece = ids[4 * at : 4 * (at + size)]
                    row.append(i)
                    start.append(at)
                    length.append(len(piece) // 4)
                    crc.append(zlib.crc32(piece))
                    total.append(n)
            out = frame[[*keys, "bears_loss"]].iloc[row].reset_index(drop=True)
            out = out.assign(start=start, length=length, ids_crc32=crc, doc_tokens=total)
            out["loss_tokens"] = np.where(out.pop("bears_loss"), out["length"] - 1, 0)
            yield out

    kinds = ", ".join(f"`{k}` {kind}" for k, kind in chosen.dtypes if k in keys)
    columns = "start long, length long, ids_crc32 long, doc_tokens long, loss_tokens long"
    return chosen.mapInPandas(run, f"{kinds}, {columns}")


def place(shares: np.ndarray) -> list[list[int]]:
    """Vector bin packing of rows, each a share of the limits: the rows of each sequence, in order."""
    order = np.argsort(-shares[:, 0], kind="stable")
    left = shares[order]
    bins: list[list[int]] = []
    while len(order):
        room, taken = np.ones(shares.shape[1]), []
        fits = np.arange(len(order))
        while len(fits):
            best = fits[np.argmax(left[fits] @ room)]
            taken.append(int(best))
            room = room - left[best]
            fits = fits[(left[fits] <= room + 1e-12).all(axis=1) & (fits != best)]
        bins.append(order[taken].tolist())
        keep = np.ones(len(order), bool)
        keep[taken] = False
        order, left = order[keep], left[keep]
    return bins


def pack(examples: DataFrame, limits: Limits = Limits(), shard: int = SHARD) -> DataFrame:
    """``examples`` (``length``, ``loss_tokens``, any keys) with ``sequence_id`` and ``offset``.

    Every row is placed once, whole. A row beyond a limit by itself raises. Offsets of a sequence
    leave no gap. Rows are staged once with a number of their own, so that a retried task deals and
    places them alike; repeated rows and null keys are rows like others. An empty table gives an
    empty table.
    """
    staged = stage(examples.withColumn("_row", F.monotonically_increasing_id()), "packing")
    shards = -(-staged.count() // shard)
    if not shards:
        return staged.drop("_row").withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")})
    caps = np.array([limits.tokens, limits.segments, limits.loss], float)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("_row", ignore_index=True)
        wanted = np.column_stack([frame["length"], np.ones(len(frame)), frame["loss_tokens"]])
        if (wanted > caps).any():
            raise ValueError("an example is larger than a sequence")
        full = np.flatnonzero(frame["length"].to_numpy() == limits.tokens)
        rest = np.flatnonzero(frame["length"].to_numpy() < limits.tokens)
        bins = [[i] for i in full] + [rest[b].tolist() for b in place(wanted[rest] / caps)]
        rows = [i for b in bins for i in b]
        out = frame.iloc[rows].reset_index(drop=True)
        number = np.repeat(np.arange(len(bins)), [len(b) for b in bins])
        before = out["length"].cumsum() - out["length"]
        out["sequence_id"] = out["_shard"] * (1 << 32) + number
        out["offset"] = before - before.groupby(number).transform("first")
        return out.drop(columns=["_row", "_shard"])

    dealt = staged.withColumn("_shard", F.col("_row") % shards)
    kinds = ", ".join(f"`{k}` {kind}" for k, kind in examples.dtypes)
    return dealt.groupBy("_shard").applyInPandas(run, f"{kinds}, sequence_id long, offset long")
