"""ML vectors of Arrow batches, and sums of products of their rows, for use inside tasks.

A vector comes to Python as it is stored, its size, places and values; it is spread over its whole width
only for the rows of one slice. A column that many rows of a slice fill is multiplied as a matrix; what
few rows fill is added pair by pair, so the work follows the filled places, not the square of the width.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Rows of a slice, and pairs of places that are added at once, on average.
SLICE, PAIRS = 1024, 1 << 20
#: Filled places that meet a matrix at once.
PLACES = 1 << 14
#: Pairs are sorted by their place, not counted over the whole matrix, where it has so many times their places.
SPARE = 32
#: A column is multiplied as a matrix where at least one row in so many fills it.
FILLED = 4


def listed(column) -> np.ndarray:
    """An Arrow column of number lists of one length as the rows of a matrix."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = np.asarray(lists.flatten(), dtype=float)
    return flat.reshape(len(lists), -1) if len(lists) else flat.reshape(0, 0)


@dataclass(frozen=True)
class Rows:
    """Filled places of vectors, row by row: row ``i`` has ``counts[i]`` of ``at`` and ``x``."""

    counts: np.ndarray
    at: np.ndarray
    x: np.ndarray
    width: int

    def __len__(self) -> int:
        return len(self.counts)

    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), self.counts)

    def part(self, start: int, stop: int) -> Rows:
        ends = np.concatenate([[0], np.cumsum(self.counts)])
        cut = slice(ends[start], ends[stop])
        return Rows(self.counts[start:stop], self.at[cut], self.x[cut], self.width)

    def matrix(self) -> np.ndarray:
        out = np.zeros((len(self), self.width))
        out[self.row(), self.at] = self.x
        return out

    def split(self) -> tuple[np.ndarray, np.ndarray, Rows]:
        """The columns that many rows fill, their values as a matrix, and the other places."""
        many = np.bincount(self.at[self.x != 0], minlength=self.width) * FILLED >= max(1, len(self))
        columns, on, row = np.flatnonzero(many), many[self.at], self.row()
        place = np.cumsum(many) - 1
        full = np.zeros((len(self), len(columns)))
        full[row[on], place[self.at[on]]] = self.x[on]
        rest = ~on & (self.x != 0)
        counts = np.bincount(row[rest], minlength=len(self))
        return columns, full, Rows(counts, self.at[rest], self.x[rest], self.width)


def vectors(column, constant: bool = True) -> Rows:
    """An Arrow column of ML vectors, none of them null, or of number lists; vectors get the constant 1 added last."""
    held = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not pa.types.is_struct(held.type):
        full = listed(held)
        return Rows(np.full(len(full), full.shape[1]), np.tile(np.arange(full.shape[1]), len(full)), full.ravel(), full.shape[1])
    values, indices = held.field("values"), held.field("indices")
    counts = np.asarray(pc.fill_null(pc.list_value_length(values), 0), dtype=np.int64)
    sparse = np.asarray(held.field("type")) == 0
    sizes = np.where(sparse, np.asarray(pc.fill_null(held.field("size"), 0)), counts)
    width = int(sizes.max()) if len(sizes) else 0
    starts = np.cumsum(counts) - counts
    at = np.arange(counts.sum()) - np.repeat(starts, counts)
    at[np.repeat(sparse, counts)] = np.asarray(indices.filter(pa.array(sparse)).flatten())
    x = np.asarray(values.flatten(), dtype=float)
    if not constant:
        return Rows(counts, at, x, width)
    ends = np.cumsum(counts)
    return Rows(counts + 1, np.insert(at, ends, width), np.insert(x, ends, 1.0), width + 1)


def slices(n: int) -> Iterator[tuple[int, int]]:
    for start in range(0, n, SLICE):
        yield start, min(n, start + SLICE)


def products(rows: Rows, matrix: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """Rows times a matrix from their filled places alone: ``start``, ``stop`` and the products of a slice of rows."""
    ends = np.cumsum(rows.counts)
    start = 0
    while start < len(rows):
        first = ends[start] - rows.counts[start]
        stop = max(start + 1, int(np.searchsorted(ends, first + PLACES, side="right")))
        part = rows.at[first : ends[stop - 1]], rows.x[first : ends[stop - 1]]
        filled = start + np.flatnonzero(rows.counts[start:stop])
        out = np.zeros((stop - start, matrix.shape[1]))
        if len(filled):
            out[filled - start] = np.add.reduceat(matrix[part[0]] * part[1][:, None], ends[filled] - rows.counts[filled] - first, axis=0)
        yield start, stop, out
        start = stop


def _by_columns(sparse: Rows, full: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The filled columns of ``sparse`` and, for each, the sum of its value times the row of ``full``."""
    order = np.argsort(sparse.at, kind="stable")
    columns, first = np.unique(sparse.at[order], return_index=True)
    made = sparse.x[order, None] * full[sparse.row()[order]]
    return columns, np.add.reduceat(made, first, axis=0)


def _add_pairs(total: np.ndarray, left: Rows, right: Rows, w: np.ndarray) -> None:
    """Add the products of the places of both that stand in the same row."""
    pairs = left.counts * right.counts
    ends = np.cumsum(pairs)
    cuts = np.unique(np.searchsorted(ends, np.arange(PAIRS, ends[-1] + PAIRS, PAIRS), side="left") + 1)
    start = 0
    for stop in np.minimum(cuts, len(pairs)):
        if stop <= start:
            continue
        a, b, row = left.part(start, stop), right.part(start, stop), w[start:stop]
        start = stop
        each = np.repeat(b.counts, a.counts)
        if not each.sum():
            continue
        first = np.repeat(np.repeat(np.cumsum(b.counts) - b.counts, a.counts), each)
        other = first + np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
        place = np.repeat(a.at, each) * total.shape[1] + b.at[other]
        made = np.repeat(a.x * row[a.row()], each) * b.x[other]
        places, inverse = np.unique(place, return_inverse=True) if total.size > SPARE * len(place) else (None, place)
        if places is None:
            total += np.bincount(place, made, total.size).reshape(total.shape)
        else:
            total.ravel()[places] += np.bincount(inverse, made)


def add_products(totals: np.ndarray, x: Rows, y: Rows | None, w: np.ndarray) -> None:
    """Add the sum of w x y' over the rows to ``totals``, a matrix for each column of ``w``; y is x where it is None."""
    for start, stop in slices(len(x)):
        one = x.part(start, stop).split()
        two = one if y is None else y.part(start, stop).split()
        for total, weight in zip(totals, w[start:stop].T, strict=True):
            _add_slice(total, one, two, weight, y is None)


def _add_slice(total: np.ndarray, one, two, w: np.ndarray, same: bool) -> None:
    (left, full, rest), (right, other_full, other_rest) = one, two
    total[np.ix_(left, right)] += (full * w[:, None]).T @ other_full
    if len(rest.at) and len(right):
        columns, made = _by_columns(rest, other_full * w[:, None])
        total[np.ix_(columns, right)] += made
        if same:
            total[np.ix_(right, columns)] += made.T
    if not same and len(other_rest.at) and len(left):
        columns, made = _by_columns(other_rest, full * w[:, None])
        total[np.ix_(left, columns)] += made.T
    if len(rest.at) and len(other_rest.at):
        _add_pairs(total, rest, other_rest, w)
