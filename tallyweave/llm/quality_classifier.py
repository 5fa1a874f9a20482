"""Quality scores: ridge regression on random Fourier features of document statistics, then isotonic calibration.

Fit: statistics of a bounded sample of labelled documents, standardised; cosines of random
projections approximate a Gaussian kernel; each partition sums its normal equations and the sums are
added. The sample is split by hash: one part fits the ridge, the other calibrates its output by
pooling adjacent violators over a grid of scores. Scoring is one narrow pass over the texts.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.llm.common import Shared, hash_share, pool_adjacent, texts_of
from tallyweave.state import stage

#: What the bytes of a text are counted as.
CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "digit": b"0123456789",
    "white": b" \t\n\v\f\r",
    "stop": b".,;:!?",
    "quote": b"'\"()-",
    "symbol": b"#*$%&|<>@^~=+_/\\[]{}`",
}
N_STATISTICS = 22
GRID = 2048


def statistics(text: str) -> list[float]:
    """Numbers that describe a whole text, whatever its language; all zero for a text without a word."""
    raw = text.encode()
    words = raw.split()
    n = len(words)
    if not n:
        return [0.0] * N_STATISTICS
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    size = len(raw)
    share = {name: counts[np.frombuffer(members, np.uint8)].sum() / size for name, members in CLASSES.items()}
    spread = counts[counts > 0] / size
    lengths = np.fromiter(map(len, words), np.float64, n)
    often = Counter(words)
    lines = [line for line in raw.split(b"\n") if line.strip()]
    ended = sum(line.rstrip()[-1:] in b".!?" for line in lines)
    return [
        math.log1p(n),
        lengths.mean(),
        lengths.std(),
        math.log(lengths.max()),
        *share.values(),
        1 - counts[:128].sum() / size,
        -float((spread * np.log(spread)).sum()),
        len(often) / math.sqrt(n),
        often.most_common(1)[0][1] / n,
        sum(map(eq, words, words[1:])) / n,
        math.log1p(len(lines)),
        1 - len(set(lines)) / len(lines),
        math.log1p(n / len(lines)),
        ended / len(lines),
        sum(w.isalpha() or not w.isascii() for w in words) / n,
        math.log1p(n / (1 + raw.count(b".") + raw.count(b"!") + raw.count(b"?"))),
    ]


@dataclass(frozen=True)
class Settings:
    """``sample``: labelled documents the fit reads at most, about; ``features``: random cosines."""

    sample: int = 40_000
    features: int = 256
    ridge: float = 1e-3
    width: float = 2.0
    parts: int = 16
    seed: int = 11


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    projection: np.ndarray
    shift: np.ndarray
    weights: np.ndarray
    calibrated: np.ndarray
    fitted: bool = True

    def features(self, numbers: np.ndarray) -> np.ndarray:
        standard = np.clip((numbers - self.mean) / self.scale, -8, 8)
        waves = np.cos(standard @ self.projection + self.shift) * math.sqrt(2 / len(self.shift))
        return np.hstack([waves, standard / 8, np.ones((len(numbers), 1))])

    def grid(self, numbers: np.ndarray) -> np.ndarray:
        """The place of the ridge output on the calibration grid."""
        return np.clip((self.features(numbers) @ self.weights + 0.5) / 2 * GRID, 0, GRID - 1).astype(int)

    def score(self, numbers: np.ndarray) -> np.ndarray:
        return self.calibrated[self.grid(numbers)]


def _numbers(texts: pd.Series) -> np.ndarray:
    return np.array([statistics(t) for t in texts], float).reshape(len(texts), N_STATISTICS)


def labelled(documents: DataFrame, labels: DataFrame, label: str, usable: Column, sample: int, seed: int) -> DataFrame:
    """``doc_id``, ``text``, ``y`` of about ``sample`` labelled documents, drawn by the hash of their id.

    ``usable`` is a condition on ``doc_id``. Documents and labels are thinned by the same hash before
    they meet, so the join moves no more than the sample. An id labelled twice counts with its mean.
    """
    known = labels.select("doc_id", F.col(label).cast("double").alias("y")).where(usable & F.col("y").isNotNull())
    known = known.groupBy("doc_id").agg(F.avg("y").alias("y"))
    total = known.count()
    drawn = hash_share("doc_id", seed=seed) < sample / max(1, total)
    return texts_of(documents).where(usable & drawn).join(known.where(drawn), "doc_id")


def fit(documents: DataFrame, labels: DataFrame, label: str = "quality", usable: Column | None = None, settings: Settings = Settings()) -> Model:
    """A model from the documents that have a label (0 or 1) and satisfy ``usable``.

    Without any labelled document every score is 0.5; with labels of one kind it is that kind.
    """
    usable = F.lit(True) if usable is None else usable
    rows = labelled(documents, labels, label, usable, settings.sample, settings.seed)
    calibrating = (hash_share("doc_id", seed=settings.seed + 1) < 0.3).alias("calibrating")

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame(
                {"x": list(_numbers(frame["text"])), "y": frame["y"], "calibrating": frame["calibrating"]}
            )

    measured = rows.select("text", "y", calibrating).mapInPandas(count, "x array<double>, y double, calibrating boolean")
    sample = stage(measured, "quality-sample").repartition(settings.parts)
    moments = sample.agg(
        F.count("*").alias("n"),
        *[F.avg(F.col("x")[i]).alias(f"m{i}") for i in range(N_STATISTICS)],
        *[F.stddev_pop(F.col("x")[i]).alias(f"s{i}") for i in range(N_STATISTICS)],
    ).first()
    draw = np.random.default_rng(settings.seed)
    projection = draw.normal(size=(N_STATISTICS, settings.features)) / (settings.width * math.sqrt(N_STATISTICS) / 2)
    shift = draw.uniform(0, 2 * math.pi, settings.features)
    if not moments["n"]:
        nothing = np.zeros(settings.features + N_STATISTICS + 1)
        return Model(np.zeros(N_STATISTICS), np.ones(N_STATISTICS), projection, shift, nothing, np.full(GRID, 0.5), False)
    mean = np.array([moments[f"m{i}"] for i in range(N_STATISTICS)])
    scale = np.array([moments[f"s{i}"] for i in range(N_STATISTICS)])
    blank = Model(mean, np.where(scale > 1e-9, scale, 1.0), projection, shift, np.zeros(0), np.zeros(0))

    size = settings.features + N_STATISTICS + 1

    def equations(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        left, right = np.zeros((size, size)), np.zeros(size)
        for frame in frames:
            if len(frame):
                z = blank.features(np.stack(frame["x"].to_numpy()))
                left += z.T @ z
                right += z.T @ frame["y"].to_numpy()
        yield pd.DataFrame({"left": [left.ravel()], "right": [right]})

    fitting = sample.where("not calibrating").select("x", "y")
    partial = fitting.mapInPandas(equations, "left array<double>, right array<double>").toPandas()
    left = np.sum(np.array(partial["left"].tolist()), axis=0).reshape(size, size)
    right = np.sum(np.array(partial["right"].tolist()), axis=0)
    weights = np.linalg.solve(left + settings.ridge * max(1.0, moments["n"]) * np.eye(size) / 10, right)
    ridge = Model(mean, blank.scale, projection, shift, weights, np.zeros(0))

    def placed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                yield pd.DataFrame({"place": ridge.grid(np.stack(frame["x"].to_numpy())), "y": frame["y"]})

    grid = sample.select("x", "y").where("calibrating").mapInPandas(placed, "place long, y double")
    sums = grid.groupBy("place").agg(F.count("*").alias("n"), F.avg("y").alias("y")).orderBy("place").toPandas()
    if not len(sums):
        return Model(mean, blank.scale, projection, shift, weights, np.clip(np.linspace(-0.5, 1.5, GRID), 0, 1))
    steps = pool_adjacent(sums["n"].to_numpy(float), sums["y"].to_numpy(float))
    curve = np.interp(np.arange(GRID), sums["place"].to_numpy(float), steps)
    return Model(mean, blank.scale, projection, shift, weights, np.clip(curve, 0, 1))


def scored(documents: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """All columns of ``documents`` and the score of the whole text; null counts as empty.

    The score depends on the text alone. A column of that name is replaced.
    """
    shared = Shared(documents.sparkSession, model)
    chosen = documents.drop(column)
    place = len(chosen.columns)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            scores = shared.value.score(_numbers(frame["text"].fillna("")))
            frame.insert(place, column, scores)
            yield frame

    kinds = ", ".join(f"`{k}` {kind}" for k, kind in chosen.dtypes)
    return chosen.mapInPandas(run, f"{kinds}, `{column}` double")
