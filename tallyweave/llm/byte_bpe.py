"""Byte-level BPE encoding and decoding with a segment tree per piece.

The leaves of a piece's tree are its byte positions. A live leaf holds the rank of the pair that
starts there, followed by the position, so the root names the leftmost pair of minimum rank. A merge
changes three leaves (the pair, its right half, the live neighbour on the left) and the nodes above
them. Short pieces are merged side by side, one merge of each piece a round, as rows of one array;
long pieces get a tree of their own. Pieces that are tokens already need no merge.

Texts are cut before every single space that follows something else than white space. No match of
the piece pattern crosses such a place, so the parts can be encoded and remembered one by one. What
a task remembers is bounded; beyond the bound it starts afresh, which changes the time, not the ids.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.llm.common import Shared, texts_of

NONE = np.int64(1 << 62)
PLACE_BITS = 24
REMEMBERED = 200_000
SIDE_BY_SIDE = 256
#: The usual pattern of rank files, whose matches of a space and letters need no search.
WORDS_WITH_SPACE = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Vocabulary:
    """Ranks of byte strings, and every pair of tokens whose bytes together are a token.

    ``lines`` are those of a rank file: the bytes in base64, then the rank.
    """

    def __init__(self, lines: Iterable[bytes], pattern: str):
        self.pattern = pattern
        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        left_right, merged = [], []
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if left is not None and right is not None:
                    left_right.append(left << 32 | right)
                    merged.append(rank)
        order = np.argsort(np.array(left_right, np.int64))
        self.pairs = np.array(left_right, np.int64)[order]
        self.merged = np.array(merged, np.int64)[order]
        self.bytes_of = {rank: token for token, rank in self.ranks.items()}
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)

    @classmethod
    def read(cls, path: str, pattern: str) -> Vocabulary:
        with open(path, "rb") as file:
            return cls(file, pattern)

    def join(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ranks of the joined tokens, NONE where they make no token."""
        wanted = left << 32 | right
        at = np.minimum(np.searchsorted(self.pairs, wanted), len(self.pairs) - 1)
        return np.where(self.pairs[at] == wanted, self.merged[at], NONE)


def merge_side_by_side(pieces: list[bytes], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of pieces of 2 to SIDE_BY_SIDE bytes, end to end, and how many each piece has.

    Each round makes one merge in every unfinished piece. Arrays are flat: row ``i`` of the tree
    starts at ``2 * width * i``, row ``i`` of the places at ``(width + 1) * i``.
    """
    n = len(pieces)
    lengths = np.array([len(p) for p in pieces])
    width = 1 << (int(lengths.max()) - 1).bit_length()
    step = width + 1
    alive = (np.arange(step) < lengths[:, None]).ravel()
    token = np.zeros(n * step, np.int64)
    token[alive] = vocabulary.single[np.frombuffer(b"".join(pieces), np.uint8)]
    after = np.tile(np.arange(1, step + 1), n)
    before = np.tile(np.arange(-1, width), n)
    first = (np.arange(n) * step)[:, None] + np.arange(width)
    rank = np.where(np.arange(width) < lengths[:, None] - 1, vocabulary.join(token[first], token[first + 1]), NONE)
    levels = [np.where(rank < NONE, rank << PLACE_BITS | np.arange(width), NONE)]
    while levels[-1].shape[1] > 1:
        levels.append(np.minimum(levels[-1][:, ::2], levels[-1][:, 1::2]))
    tree = np.concatenate([np.full((n, 1), NONE), *levels[::-1]], axis=1).ravel()

    def put(rows: np.ndarray, places: np.ndarray, values: np.ndarray) -> None:
        node, root = places + width, rows * (2 * width)
        tree[root + node] = values
        for _ in range(width.bit_length() - 1):
            values = np.minimum(values, tree[root + (node ^ 1)])
            node = node >> 1
            tree[root + node] = values

    def pair_at(rows: np.ndarray, places: np.ndarray, following: np.ndarray, ends: np.ndarray) -> np.ndarray:
        here = rows * step
        found = vocabulary.join(token[here + places], token[here + np.minimum(following, width)])
        return np.where((following < ends) & (found < NONE), found << PLACE_BITS | places, NONE)

    todo = np.arange(n)
    while True:
        root = tree[todo * (2 * width) + 1]
        more = root < NONE
        todo, root = todo[more], root[more]
        if not len(todo):
            break
        ends, here = lengths[todo], todo * step
        left = root & ((1 << PLACE_BITS) - 1)
        gone = after[here + left]
        following = after[here + gone]
        token[here + left] = root >> PLACE_BITS
        alive[here + gone] = False
        after[here + left] = following
        before[here + np.minimum(following, width)] = left
        put(todo, gone, np.full(len(todo), NONE))
        put(todo, left, pair_at(todo, left, following, ends))
        previous = before[here + left]
        inner = np.flatnonzero(previous >= 0)
        if len(inner):
            rows, previous = todo[inner], previous[inner]
            put(rows, previous, pair_at(rows, previous, left[inner], ends[inner]))
    return token[alive], alive.reshape(n, step).sum(axis=1)


def merge_alone(piece: bytes, vocabulary: Vocabulary) -> list[int]:
    """Token ids of one long piece, with plain lists for the tree."""
    n = len(piece)
    width, none = 1 << (n - 1).bit_length(), int(NONE)
    token = vocabulary.single[np.frombuffer(piece, np.uint8)]
    first = vocabulary.join(token[:-1], token[1:])
    leaves = np.full(width, NONE)
    leaves[: n - 1] = np.where(first < NONE, first << 32 | np.arange(n - 1), NONE)
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append(np.minimum(levels[-1][::2], levels[-1][1::2]))
    tree = [none, *np.concatenate(levels[::-1]).tolist()]
    token = token.tolist()
    after, before = list(range(1, n + 1)), list(range(-1, n))
    ranks, bytes_of = vocabulary.ranks, vocabulary.bytes_of

    def put(place: int, value: int) -> None:
        node = place + width
        tree[node] = value
        while node > 1:
            node >>= 1
            a, b = tree[2 * node], tree[2 * node + 1]
            least = a if a < b else b
            if tree[node] == least:
                break
            tree[node] = least

    def pair_at(place: int, following: int) -> int:
        if following >= n:
            return none
        rank = ranks.get(bytes_of[token[place]] + bytes_of[token[following]])
        return none if rank is None else rank << 32 | place

    while tree[1] < none:
        left, rank = tree[1] & 0xFFFFFFFF, tree[1] >> 32
        gone = after[left]
        following = after[gone]
        token[left], token[gone] = rank, -1
        after[left] = following
        before[following] = left
        put(gone, none)
        put(left, pair_at(left, following))
        if before[left] >= 0:
            put(before[left], pair_at(before[left], left))
    return [t for t in token if t >= 0]


class Encoder:
    """Encodes texts with a bounded memory of parts and pieces, as little-endian unsigned 32-bit ids."""

    def __init__(self, vocabulary: Vocabulary, remembered: int = REMEMBERED):
        self.vocabulary, self.remembered = vocabulary, remembered
        self.split = regex.compile(vocabulary.pattern).findall
        self.words = vocabulary.pattern == WORDS_WITH_SPACE
        self.pieces: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def cut(self, text: str) -> list[str]:
        """The text cut before single spaces; together the parts are the text."""
        if "  " in text or any(c + " " in text for c in "\n\t\r\f\v"):
            return regex.findall(r"\s*\S+|\s+", text)
        if not text.isascii() and regex.search(r"\s ", text):
            return regex.findall(r"\s*\S+|\s+", text)
        first, *rest = text.split(" ")
        return ([first] if first else []) + [" " + part for part in rest]

    def pieces_of(self, part: str) -> list[str]:
        """The matches of the pattern. A space, letters and one stop are two matches, without asking the pattern."""
        if self.words:
            if part[1:].isalpha() and (part[0] == " " or part[0].isalpha()):
                return [part]
            if part[-1] in ".,;:!?" and part[1:-1].isalpha() and (part[0] == " " or part[0].isalpha()):
                return [part[:-1], part[-1]]
        return self.split(part)

    def learn(self, parts: set[str]) -> None:
        """Encode the parts that are not remembered. The parts met first stay: the common ones are met early."""
        new = [p for p in parts if p not in self.parts]
        for memory in (self.parts, self.pieces):
            if len(memory) + len(new) > self.remembered:
                for old in list(memory)[self.remembered // 2 :]:
                    del memory[old]
                new = [p for p in parts if p not in self.parts]
        cut = [self.pieces_of(part) for part in new]
        ranks, waiting = self.vocabulary.ranks, []
        for piece in {p for pieces in cut for p in pieces if p not in self.pieces}:
            raw = piece.encode()
            if raw in ranks:
                self.pieces[piece] = np.array([ranks[raw]], "<u4").tobytes()
            elif len(raw) > SIDE_BY_SIDE:
                self.pieces[piece] = np.array(merge_alone(raw, self.vocabulary), "<u4").tobytes()
            else:
                waiting.append((raw, piece))
        waiting.sort(key=lambda w: len(w[0]))
        start = 0
        while start < len(waiting):
            width = 1 << (len(waiting[start][0]) - 1).bit_length()
            end = min(len(waiting), start + (1 << 18) // width)
            while len(waiting[end - 1][0]) > width:
                end -= 1
            ids, counts = merge_side_by_side([raw for raw, _ in waiting[start:end]], self.vocabulary)
            flat, stops = ids.astype("<u4").tobytes(), (4 * np.cumsum(counts)).tolist()
            for (_, piece), begin, stop in zip(waiting[start:end], [0, *stops], stops, strict=False):
                self.pieces[piece] = flat[begin:stop]
            start = end
        for part, pieces in zip(new, cut, strict=True):
            self.parts[part] = self.pieces[part] if len(pieces) == 1 else b"".join([self.pieces[p] for p in pieces])

    def batch(self, texts: Iterable[str]) -> Iterator[bytes]:
        """The ids of each text."""
        cut: list[list[str]] = []
        waiting: set[str] = set()
        for text in texts:
            cut.append(self.cut(text))
            waiting.update(cut[-1])
            if len(waiting) > self.remembered // 4:
                yield from self._known(cut, waiting)
                cut, waiting = [], set()
        yield from self._known(cut, waiting)

    def _known(self, cut: list[list[str]], waiting: set[str]) -> Iterator[bytes]:
        self.learn(waiting)
        known = self.parts.__getitem__
        for parts in cut:
            yield b"".join(map(known, parts))


class Decoder:
    """The bytes of ids, gathered from all tokens laid end to end."""

    def __init__(self, vocabulary: Vocabulary):
        size = max(vocabulary.bytes_of) + 1
        tokens = [vocabulary.bytes_of.get(i, b"") for i in range(size)]
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)
        self.length = np.array([len(t) for t in tokens])
        self.start = np.cumsum(self.length) - self.length

    def __call__(self, ids: np.ndarray) -> bytes:
        if len(ids) and not 0 <= ids.min() <= ids.max() < len(self.length):
            raise ValueError("an id that no token has")
        lengths = self.length[ids]
        if not lengths.all():
            raise ValueError("an id that no token has")
        shift = self.start[ids] - (np.cumsum(lengths) - lengths)
        return self.flat[np.repeat(shift, lengths) + np.arange(lengths.sum())].tobytes()


def _shared(documents: DataFrame, path: str, pattern: str):
    return Shared(documents.sparkSession, Vocabulary.read(path, pattern))


def encode(documents: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id`` and ``ids`` (array of int) of every whole text. Null and empty texts have no ids.

    One narrow pass, no shuffle. The vocabulary is broadcast; its size is that of the rank file.
    """
    shared = _shared(documents, path, pattern)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = Encoder(shared.value)
        for frame in frames:
            ids = [np.frombuffer(i, "<u4").astype(np.int32) for i in encoder.batch(frame["text"])]
            yield pd.DataFrame({"doc_id": frame["doc_id"], "ids": pd.Series(ids, frame.index, dtype=object)})

    return _with_id(documents, run, "ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id`` and ``bytes`` for arrays of ids. Null ids give empty bytes; an unknown id raises."""
    shared = _shared(encoded, path, pattern)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        decoder = Decoder(shared.value)
        for frame in frames:
            out = [b"" if ids is None else decoder(np.asarray(ids, np.int64)) for ids in frame["ids"]]
            yield pd.DataFrame({"doc_id": frame["doc_id"], "bytes": pd.Series(out, frame.index, dtype=object)})

    chosen = encoded.select("doc_id", "ids")
    return chosen.mapInPandas(run, f"doc_id {dict(chosen.dtypes)['doc_id']}, bytes binary")


def round_trip(documents: DataFrame, path: str, pattern: str) -> DataFrame:
    """Digests of the ids of every whole text and of the bytes that they decode to.

    Columns: ``doc_id``, ``n_tokens``, ``ids_sha256``, ``decoded_sha256``. Null text counts as empty,
    rows are kept as they are, repeated or with a null id; other columns are ignored.
    """
    shared = _shared(documents, path, pattern)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, decoder = Encoder(shared.value), Decoder(shared.value)
        for frame in frames:
            rows = [
                (
                    len(ids) // 4,
                    hashlib.sha256(ids).hexdigest(),
                    hashlib.sha256(decoder(np.frombuffer(ids, "<u4"))).hexdigest(),
                )
                for ids in encoder.batch(frame["text"])
            ]
            out = pd.DataFrame(rows, frame.index, ["n_tokens", "ids_sha256", "decoded_sha256"])
            out.insert(0, "doc_id", frame["doc_id"])
            yield out

    return _with_id(documents, run, "n_tokens long, ids_sha256 string, decoded_sha256 string")


def _with_id(documents: DataFrame, run, columns: str) -> DataFrame:
    chosen = texts_of(documents)
    return chosen.mapInPandas(run, f"doc_id {dict(chosen.dtypes)['doc_id']}, {columns}")


def n_tokens(encoded: DataFrame) -> DataFrame:
    """``doc_id`` and the number of ids."""
    return encoded.select("doc_id", F.size(F.coalesce("ids", F.array().cast("array<int>"))).cast("long").alias("n_tokens"))
