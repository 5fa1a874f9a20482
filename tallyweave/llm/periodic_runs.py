"""Periodic runs of words: longest common extensions from a difference cover, asked on a harmonic grid.

A run is a stretch of words with smallest period q, at least ``max(MIN_LENGTH, 2 q)`` words long, that
no neighbouring word extends. A run with period p holds at least ``g = max(p, MIN_LENGTH - p)``
consecutive places t with word t equal to word t + p, so one of them is a multiple of g. For every p
those multiples are compared; where they agree, the longest common extension of t and t + p to the
right and to the left tells where the run begins and ends.

An extension is found by comparing word after word until both places lie in a difference cover of
``COVER_PERIOD``: of any two places some shift below the period takes both into the cover. Only
suffixes that start in the cover are sorted. Neighbours in that order know their common prefix, and a
sparse table gives its minimum over any range, which is the rest of the extension. Extensions that end
within the first words never need the order, so it is made for the texts alone that have longer ones.

A task works on a number of texts at once, laid side by side in one array with marks between them that
equal nothing else. Memory is bounded by WORDS words at a time, or by the longest single text.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tallyweave.llm.common import texts_of

MIN_LENGTH = 12
#: Of any two numbers some shift below COVER_PERIOD takes both into COVER, modulo COVER_PERIOD.
COVER_PERIOD = 13
COVER = (0, 1, 3, 9)
#: Words that a task lays side by side.
WORDS = 200_000


def _shifts() -> np.ndarray:
    """For residues (a, b) the least shift that takes both into the cover."""
    inside = np.isin(np.arange(2 * COVER_PERIOD) % COVER_PERIOD, COVER)
    table = np.zeros((COVER_PERIOD, COVER_PERIOD), np.int64)
    for a in range(COVER_PERIOD):
        for b in range(COVER_PERIOD):
            table[a, b] = next(s for s in range(COVER_PERIOD) if inside[a + s] and inside[b + s])
    return table


SHIFTS = _shifts()


class Extensions:
    """Longest common extension to the right of two places of an array.

    The array ends with COVER_PERIOD numbers that no two compared places reach together.
    """

    def __init__(self, words: np.ndarray):
        self.words = words
        self.place: np.ndarray | None = None

    def _order(self) -> None:
        """Sort the suffixes of the cover and lay the sparse table over their common prefixes."""
        v, words, n = COVER_PERIOD, self.words, len(self.words)
        starts = np.flatnonzero(np.isin(np.arange(n - v + 1) % v, COVER))
        # v words in few whole numbers, as many words in each as have room, the first one most significant
        bits = max(1, int(words.max()).bit_length())
        room = max(1, 62 // bits)
        columns = []
        for i in range(0, v, room):
            packed = words[starts + i]
            for k in range(i + 1, min(v, i + room)):
                packed = packed << bits | words[starts + k]
            columns.append(packed)
        order = np.lexsort(columns[::-1])
        fresh = np.ones(len(order), bool)
        fresh[1:] = np.logical_or.reduce([c[order[1:]] != c[order[:-1]] for c in columns])
        rank = np.empty(len(order), np.int64)
        rank[order] = np.cumsum(fresh) - 1
        self.at = np.full(n + v, len(starts), np.int64)  # place of a start among the starts; the last one stands for none
        self.at[starts] = np.arange(len(starts))
        levels, width = [np.append(rank, -1)], v
        while rank.max(initial=0) + 1 < len(rank) and width < n:
            # the suffix that starts width words later lies in the same residue class
            later = levels[-1][self.at[np.minimum(starts + width, n)]] + 1
            pair = rank * (len(rank) + 2) + later
            order = np.argsort(pair)
            rank = np.empty(len(order), np.int64)
            rank[order] = np.cumsum(np.append(True, np.diff(pair[order]) != 0)) - 1
            levels.append(np.append(rank, -1))
            width *= 2
        # common prefix of neighbours: the largest blocks with equal ranks, then word by word
        left, right = starts[order[:-1]].copy(), starts[order[1:]].copy()
        common = np.zeros(len(left), np.int64)
        for level in range(len(levels) - 1, -1, -1):
            ranks, step = levels[level], v << level
            a, b = ranks[self.at[left]], ranks[self.at[right]]
            same = (a == b) & (a >= 0)
            for x in (left, right, common):
                x[same] += step
        self.place = np.empty(len(starts), np.int64)
        self.place[order] = np.arange(len(order))
        self.sparse = [common + self._compared(left, right, np.full(len(left), v))]
        step = 1
        while 2 * step <= len(common):
            last = self.sparse[-1]
            self.sparse.append(np.minimum(last[:-step], last[step:]))
            step *= 2

    def _compared(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many words agree from ``i`` and ``j`` on, ``most`` at the most."""
        found = np.zeros(len(i), np.int64)
        open_ = np.flatnonzero(most > 0)
        for step in range(int(most.max(initial=0))):
            a, b = i[open_] + step, j[open_] + step
            inside = (a < len(self.words)) & (b < len(self.words))
            same = inside.copy()
            same[inside] = self.words[a[inside]] == self.words[b[inside]]
            open_ = open_[same]
            found[open_] = step + 1
            open_ = open_[most[open_] > step + 1]
        return found

    def _least(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Least common prefix between the places a < b of the order."""
        level = np.floor(np.log2(b - a)).astype(np.int64)
        out = np.empty(len(a), np.int64)
        for k in np.unique(level):
            of, table = level == k, self.sparse[k]
            out[of] = np.minimum(table[a[of]], table[b[of] - (1 << k)])
        return out

    def few(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What comparing the words before the cover gives, and whether there may be more."""
        shift = SHIFTS[i % COVER_PERIOD, j % COVER_PERIOD]
        found = self._compared(i, j, shift)
        return found, found == shift

    def rest(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Common extension of places of the cover, from the order."""
        if self.place is None:
            self._order()
        a, b = self.place[self.at[i]], self.place[self.at[j]]
        return self._least(np.minimum(a, b), np.maximum(a, b))


def _laid(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts in one array with marks around each; the start of each text; the text of each place."""
    v = COVER_PERIOD
    top = max(int(t.max(initial=0)) for t in texts) + 1
    size = sum(map(len, texts)) + v * (len(texts) + 1)
    words, owner, starts, at = np.empty(size, np.int64), np.full(size, -1, np.int64), [], 0
    for k, text in enumerate(texts):
        words[at : at + v] = top + k
        at += v
        starts.append(at)
        words[at : at + len(text)], owner[at : at + len(text)] = text, k
        at += len(text)
    words[at:] = top + len(texts)
    return words, np.array(starts, np.int64), owner


def _grid(words: np.ndarray, owner: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places t and periods p with equal words t and t + p of one text, on the grid of each period.

    Texts are laid with the longest first, so that only a beginning of the array has texts of 2 p words.
    """
    ends = np.cumsum(lengths + COVER_PERIOD)
    places, periods = [], []
    for p in range(1, int(lengths[0]) // 2 + 1):
        fit = int(np.searchsorted(-lengths, -2 * p, side="right"))  # so many texts have 2 p words
        step, until = max(p, MIN_LENGTH - p), int(ends[fit - 1])
        first, second = words[0 : max(0, until - p) : step], words[p:until:step]
        found = np.flatnonzero(first == second) * step
        if len(found):
            found = found[(owner[found] >= 0) & (owner[found] == owner[found + p])]
            places.append(found)
            periods.append(np.full(len(found), p))
    if not places:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(places), np.concatenate(periods)


def _extended(words: np.ndarray, i: np.ndarray, j: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Common extension to the right of places i and j of one text."""
    plain = Extensions(words)
    found, more = plain.few(i, j)
    if not more.any():
        return found
    # only texts with longer extensions are ordered; the marks around them stay
    open_ = np.flatnonzero(more)
    wanted = np.zeros(int(owner.max()) + 1, bool)
    wanted[owner[i[open_]]] = True
    keep = np.append(wanted, False)[owner]
    marks = np.zeros(len(words), bool)
    edge = np.flatnonzero(keep & np.append(~keep[1:], True))
    for e in edge.tolist():
        marks[e + 1 : e + 1 + COVER_PERIOD] = True
    chosen = np.flatnonzero(keep | marks)
    moved = np.full(len(words), -1, np.int64)
    moved[chosen] = np.arange(len(chosen))
    # numbers of the chosen part, in the same order and without gaps
    _, small = np.unique(words[chosen], return_inverse=True)
    ordered = Extensions(small.astype(np.int64))
    a, b = moved[i[open_]], moved[j[open_]]
    shift = SHIFTS[a % COVER_PERIOD, b % COVER_PERIOD]
    again = ordered._compared(a, b, shift)
    whole = again == shift
    again[whole] += ordered.rest(a[whole] + shift[whole], b[whole] + shift[whole])
    found[open_] = again
    return found


def runs_of(texts: list[np.ndarray]) -> list[np.ndarray]:
    """Of each text (whole numbers for words) its runs: rows of start, length, period, by start, then period."""
    none = np.empty((0, 3), np.int64)
    out = [none] * len(texts)
    chosen = sorted((k for k, t in enumerate(texts) if len(t) >= MIN_LENGTH), key=lambda k: -len(texts[k]))
    if not chosen:
        return out
    words, starts, owner = _laid([texts[k] for k in chosen])
    lengths = np.array([len(texts[k]) for k in chosen], np.int64)
    t, p = _grid(words, owner, lengths)
    if not len(t):
        return out
    ahead = _extended(words, t, t + p, owner)
    last = len(words) - 1
    back = _extended(words[::-1], last - t, last - t - p, owner[::-1])  # counts t itself
    begin, end = t - back + 1, t + p + ahead
    good = end - begin >= np.maximum(MIN_LENGTH, 2 * p)
    begin, end, p = begin[good], end[good], p[good]
    # one stretch may be found from several places and with multiples of its period: the least period counts
    order = np.lexsort((p, end, begin))
    begin, end, p = begin[order], end[order], p[order]
    first = np.ones(len(begin), bool)
    first[1:] = (np.diff(begin) != 0) | (np.diff(end) != 0)
    begin, end, p = begin[first], end[first], p[first]
    text = owner[begin]
    found = np.stack([begin - starts[text], end - begin, p], axis=1)
    found, text = found[order := np.lexsort((p, found[:, 0], text))], text[order]
    cuts = np.searchsorted(text, np.arange(len(chosen) + 1))
    for place, k in enumerate(chosen):
        out[k] = found[cuts[place] : cuts[place + 1]]
    return out


def without_repeats(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of n words stay when each run keeps its first period alone."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(change[:-1]) == 0


Words = Callable[[int | None, list[bytes]], list[bytes]]


def as_they_are(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    return words


def looped(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """A tenth of the texts, told by their ids, go round in a loop from some word on."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def _described(words: list[bytes], runs: np.ndarray) -> tuple:
    """Number of runs, the longest one, the digest of all, and the digest of the collapsed text."""
    if not len(runs):
        return 0, None, None, None, hashlib.sha256().hexdigest(), hashlib.sha256(b" ".join(words)).hexdigest()
    start, length, period = runs[np.lexsort((runs[:, 2], runs[:, 0], -runs[:, 1]))[0]].tolist()
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs.tolist())
    stay = without_repeats(len(words), runs)
    collapsed = b" ".join([words[i] for i in np.flatnonzero(stay).tolist()])
    return len(runs), start, length, period, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(collapsed).hexdigest()


SCHEMA = (
    "doc_id long, n_words long, n_runs long, start long, length long, period long, runs_sha256 string, collapsed_sha256 string, "
    "runs array<struct<start: long, length: long, period: long>>"
)


def scanned(documents: DataFrame, words_of: Words = as_they_are) -> DataFrame:
    """Per document its runs, the longest one (ties: least start, then period) and the digests of SCHEMA.

    Words are what ASCII white space parts; ``words_of(doc_id, words)`` may change them first. Null text
    is empty; an empty text, and one without runs, has n_runs 0 and nulls for the longest. A null doc_id
    stays null, repeated rows give equal rows, other columns (``start`` or ``runs`` among them) go. A
    text of any length is worked on whole, in memory in proportion to its words; an empty table gives an
    empty result.
    """

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids: list[int | None] = []
        words: list[list[bytes]] = []
        held = 0

        def done() -> pd.DataFrame:
            known: dict[bytes, int] = {}
            numbers = [np.array([known.setdefault(w, len(known)) for w in text], np.int64) for text in words]
            found = runs_of(numbers)
            rows = [
                (i, len(text), *_described(text, runs), [{"start": s, "length": n, "period": q} for s, n, q in runs.tolist()])
                for i, text, runs in zip(ids, words, found, strict=True)
            ]
            names = [c.split()[0] for c in SCHEMA.split(", runs array")[0].split(", ")] + ["runs"]
            frame = pd.DataFrame(rows, columns=names)
            whole = ["doc_id", "n_words", "n_runs", "start", "length", "period"]
            return frame.astype({c: "Int64" for c in whole})

        for frame in frames:
            for doc_id, text in zip(frame["doc_id"].astype("Int64"), frame["text"], strict=True):
                key = None if doc_id is pd.NA else int(doc_id)
                ids.append(key)
                words.append(words_of(key, text.encode().split()))
                held += len(words[-1])
                if held >= WORDS:
                    yield done()
                    ids, words, held = [], [], 0
        if ids:
            yield done()

    return texts_of(documents).mapInPandas(work, SCHEMA)
