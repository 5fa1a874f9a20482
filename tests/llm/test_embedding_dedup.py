"""Near-duplicate vectors against all pairs."""

import math

import numpy as np
import pytest

from tallyweave.llm import embedding_dedup as ed


def plain(data, threshold):
    """(vec_id, n_links, component_id, kept) by comparing all pairs."""

    def ok(v, label):
        return label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)

    good = [ok(v, label) for _, v, label in data]
    root, links = list(range(len(data))), [0] * len(data)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (_, a, la) in enumerate(data):
        for j in range(i + 1, len(data)):
            _, b, lb = data[j]
            if good[i] and good[j] and la == lb and len(a) == len(b):
                x, y = np.array(a, float), np.array(b, float)
                if x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= threshold:
                    links[i] += 1
                    links[j] += 1
                    root[find(j)] = find(i)
    groups = {}
    for i, (vec, _, _) in enumerate(data):
        groups.setdefault(find(i), []).append(vec)
    out = []
    for i, (vec, _, _) in enumerate(data):
        ids = [v for v in groups[find(i)] if v is not None]
        least = min(ids) if ids else None
        out.append((vec, links[i], least, vec is not None and vec == least))
    return sorted(out, key=lambda r: tuple((v is not None, v) for v in r))


def made(n, dims, seed):
    draw = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        if rows and draw.random() < 0.5:
            base = np.array(rows[draw.integers(len(rows))][1])
            v = base + draw.normal(size=dims) * 0.19 / math.sqrt(dims) * np.linalg.norm(base) * draw.random()
        else:
            v = draw.normal(size=dims)
        rows.append((i, np.float32(v).astype(float).tolist(), int(draw.integers(3)) if i % 5 else 0))
    return rows


@pytest.mark.parametrize("block,dims", [(1024, 16), (16, 16), (8, 3)])
def test_equals_all_pairs(spark, rows, block, dims):
    data = made(220, dims, block)
    frame = spark.createDataFrame(data, "vec_id long, embedding array<float>, label int")
    assert rows(ed.near_duplicates(frame, 0.98, block)) == plain(data, 0.98)


def test_odd_rows(spark, rows):
    data = [
        (5, [1.0, 0.0], 1), (3, [2.0, 0.0], 1), (9, [1.0, 0.0], 1), (9, [1.0, 0.0], 1), (1, [1.0, 0.0], None),
        (2, None, 1), (4, [0.0, 0.0], 1), (6, [None, 1.0], 1), (7, [float("nan"), 1.0], 1), (8, [float("inf"), 1.0], 1),
        (10, [], 1), (11, [1.0, 0.0, 0.0], 1), (None, [0.0, 1.0], 1), (12, [0.0, 1.0], 2), (13, [-1.0, 0.0], 1),
    ]
    frame = spark.createDataFrame([(*r, "x") for r in data], "vec_id long, embedding array<float>, label int, rid string")
    assert rows(ed.near_duplicates(frame)) == plain(data, 0.98)
    assert ed.near_duplicates(frame.limit(0)).count() == 0


def test_bounds_hold():
    draw = np.random.default_rng(1)
    a = draw.normal(size=(200, 24))
    a /= np.linalg.norm(a, axis=1)[:, None]
    q, s, e = ed.quantised(a)
    exact, rounded = a @ a.T, (s[:, None] * q) @ (s[:, None] * q).T
    assert (np.abs(exact - rounded) <= e[:, None] + e + 3 * e[:, None] * e).all()
