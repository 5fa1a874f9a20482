"""Nearest neighbours by one-bit codes against all pairs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyweave.llm import rotated_codes as rc

SCHEMA = "vec_id long, embedding array<float>"


def apart(a, b):
    total = 0.0  # plain additions: sum() would compensate their rounding
    for x, y in zip(a, b, strict=True):
        total += (x - y) * (x - y)
    return math.sqrt(total)


def plain(data, k=10, every=100):
    def ok(i, v):
        return i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)

    good = sorted({(i, tuple(float(np.float32(x)) for x in v)) for i, v, *_ in data if ok(i, v)})
    out = []
    for q, a in good:
        if q % every:
            continue
        near = sorted((apart(a, b), i) for i, b in good if i != q and len(a) == len(b))
        out += [(q, rank, i, score) for rank, (score, i) in enumerate(near[:k], 1)]
    return sorted(out)


def made(n, dims, seed):
    draw = np.random.default_rng(seed)
    middles = draw.normal(size=(6, dims))
    out = []
    for i in range(n):
        v = middles[draw.integers(6)] + draw.normal(size=dims) * (0.05 if i % 2 else 0.8)
        out.append((i, np.float32(v).astype(float).tolist()))
    return out


@pytest.fixture
def small(monkeypatch):
    """Blocks and groups so small that each cell has several."""
    monkeypatch.setattr(rc, "BLOCK", 64)
    monkeypatch.setattr(rc, "GROUP", 3)


@pytest.mark.parametrize("dims", [3, 64, 100])
def test_finds_the_nearest(spark, rows, small, dims):
    data = made(900, dims, dims)
    found = rows(rc.nearest(spark.createDataFrame(data, SCHEMA), F.col("vec_id") % 20 == 0))
    want = plain(data, every=20)
    assert len(found) == len(want)
    assert len({r[:1] + r[2:] for r in found} & {r[:1] + r[2:] for r in want}) >= 0.98 * len(want)
    assert all(abs(a[3] - b[3]) < 0.1 for a, b in zip(found, want, strict=True))


def test_a_bound_wide_enough_gives_all(spark, rows, small):
    data = made(500, 40, 1)
    found = rc.nearest(spark.createDataFrame(data, SCHEMA), F.col("vec_id") % 25 == 0, spread=8.0)
    assert rows(found) == plain(data, every=25)


def test_one_vector_of_many_copies(spark, rows):
    data = made(300, 8, 2)
    data += [(i, [1.0] * 8) for i in range(300, 2300)] + [(i, [1.0] * 7 + [1.0 + i / 1e4]) for i in range(2300, 2400)]
    assert rows(rc.nearest(spark.createDataFrame(data, SCHEMA), F.col("vec_id") % 100 == 0)) == plain(data)


def test_odd_rows(spark, rows):
    data = [
        (0, [1.0, 0.0]), (0, [1.0, 0.0]), (100, [0.0, 1.0]), (5, [1.0, 0.0]), (3, [-1.0, 0.0]), (4, None), (6, [0.0, 0.0]), (7, [None, 1.0]),
        (8, [float("nan"), 1.0]), (9, [float("inf"), 0.0]), (10, []), (11, [1.0, 2.0, 3.0]), (200, [3.0, 2.0, 1.0]), (None, [1.0, 0.0]), (300, [0.0, 0.0]),
        (400, [2.0] * 70), (12, [0.5, 0.5]), (12, [0.5, -0.5]), (500, [9.0, 9.0]), (500, [9.0, -9.0]),
    ]
    frame = spark.createDataFrame([(*r, "x", 1) for r in data], SCHEMA + ", rid string, score int")
    found = rows(rc.nearest(frame, F.col("vec_id") % 100 == 0))
    assert found == plain(data)
    assert rc.nearest(frame.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    assert rc.nearest(frame, F.lit(None).cast("boolean")).count() == 0


def test_bounds_and_codes():
    draw = np.random.default_rng(5)
    rows, asked = draw.normal(size=(400, 70)), draw.normal(size=(30, 70))
    code, length, f = rc.coded(rows)
    assert code.shape == (400, 2) and np.allclose(length, np.linalg.norm(rows, axis=1))
    turn = rc.rotation(70)
    assert np.allclose(turn @ turn.T, np.eye(70))
    signs = np.unpackbits(code.view(np.uint8).reshape(400, -1), axis=1, bitorder="little") * 2.0 - 1
    assert np.allclose(f, (signs * (rows @ turn)).sum(axis=1) / length / np.sqrt(128))
    guess, off = rc.estimates(asked, code, length, f, 4.0)
    true = np.square(asked[:, None] - rows[None]).sum(axis=2)
    assert (np.abs(guess - true) <= off).mean() > 0.999
    # the product of bits is the product with the signs, up to rounding to eight bits
    exact = (asked @ turn) @ signs.T / (np.sqrt(128) * f)
    guess0, off0 = rc.estimates(asked, code, length, f, 0.0)
    assert (np.abs(guess0 - (length**2 + np.square(asked).sum(axis=1)[:, None] - 2 * length * exact)) <= off0 + 1e-9).all()
    code, length, f = rc.coded(np.zeros((1, 70)))
    assert length[0] == 0 and f[0] == 1


def test_recall_on_the_given_vectors(spark, folder):
    from tallyweave.llm import queries
    from tallyweave.llm.common import table

    data = [tuple(r) for r in table(spark, folder, "embeddings").select("vec_id", "embedding").collect()]
    found = {tuple(r)[:3] for r in queries.op13_nearest(spark, folder).collect()}
    want = {r[:3] for r in plain(data)}
    assert len(found & want) >= 0.9 * len(want) and len(found) == len(want)
