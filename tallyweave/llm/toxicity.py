"""Toxicity scores: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the bag of its character n-grams with boundary marks, hashed to rows of an embedding table;
the vector of a span of words is the mean of its words' vectors, and a linear softmax over the two
labels scores it. A misspelt word shares most n-grams with the word it stands for. A document is as
toxic as its worst spans: training and scoring take a smooth maximum over spans, so two words in a
very long text still count. Embeddings and softmax are trained together on a bounded sample.

The difference of the two logits is linear in the embeddings, so scoring needs one number per row of
the table: the projection of its vector on the difference of the softmax weights.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.llm.common import Shared, hash_share, texts_of

GRAMS = (3, 4, 5, 6)
MARK = 0x20
SPREAD = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Settings:
    """``sample``: labelled documents of each label that the fit reads at most, about."""

    sample: int = 1_500
    rows: int = 1 << 18
    width: int = 8
    span: int = 2
    steps: int = 80
    rate: float = 0.02
    decay: float = 1e-5
    clean_weight: float = 0.6
    sharpness: float = 2.0
    seed: int = 5


@dataclass(frozen=True)
class Model:
    """``embedding`` (rows x width), ``softmax`` (width x 2), ``bias`` (2)."""

    embedding: np.ndarray
    softmax: np.ndarray
    bias: np.ndarray
    settings: Settings

    def lean(self) -> np.ndarray:
        """Each row's vector on the difference of the softmax weights; empty for a model that learnt nothing."""
        if not self.embedding.any():
            return np.zeros(0, np.float32)
        return (self.embedding @ (self.softmax[:, 1] - self.softmax[:, 0])).astype(np.float32)


def grams_of(text: str, rows: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Row of each n-gram, the word it is from, and the number of words. A word is told apart by white space."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.int32), np.zeros(0, np.int32), 0
    raw = np.frombuffer(" ".join(["", *words, ""]).encode(), np.uint8)
    blank = raw == MARK
    number = np.cumsum(blank) - 1  # of the word that a mark opens and its bytes
    found, owner = [], []
    hashed = np.zeros(len(raw), np.uint64)
    blanks = np.concatenate([[0], np.cumsum(blank)])
    for n in range(1, max(GRAMS) + 1):
        if len(raw) < n:
            break
        hashed = (hashed[: len(raw) - n + 1] * np.uint64(0x100000001B3)) ^ raw[n - 1 :].astype(np.uint64)
        if n in GRAMS:
            inner = blanks[n - 1 : len(raw)] - blanks[1 : len(raw) - n + 2]  # marks strictly inside
            at = np.flatnonzero((inner == 0) & ~((n == 2) & blank[: len(inner)]))
            value = hashed[at] * SPREAD + np.uint64(n)
            found.append(((value ^ (value >> np.uint64(29))) % np.uint64(rows)).astype(np.int32))
            owner.append(number[at].astype(np.int32))
    return np.concatenate(found), np.concatenate(owner), len(words)


def word_means(text: str, table: np.ndarray) -> np.ndarray:
    """Of each word, the mean of its n-grams' numbers in ``table``."""
    found, owner, n = grams_of(text, len(table))
    if not n:
        return np.zeros(0)
    sums = np.bincount(owner, table[found], n)
    return sums / np.maximum(1, np.bincount(owner, minlength=n))


def spans(values: np.ndarray, width: int) -> np.ndarray:
    """Means over spans of ``width`` words, each starting half a span after the last."""
    half = max(1, width // 2)
    starts = np.arange(0, max(1, len(values) - half), half)
    total = np.concatenate([[0.0], np.cumsum(values)])
    ends = np.minimum(starts + width, len(values))
    return (total[ends] - total[starts]) / width


def soft_max(values: np.ndarray, sharpness: float) -> float:
    top = values.max()
    return float(top + math.log(np.exp(sharpness * (values - top)).sum()) / sharpness)


class _Bags:
    """A sample's documents as sparse maps n-gram -> distinct word -> span -> document, and back."""

    def __init__(self, texts: list[str], settings: Settings):
        place: dict[str, int] = {}
        words, span_of, doc_of_span = [], [], []
        width, half, n_spans = settings.span, max(1, settings.span // 2), 0
        for doc, text in enumerate(texts):
            ids = np.array([place.setdefault(w, len(place)) for w in text.lower().split()], np.int32)
            if not len(ids):
                continue
            at = np.arange(0, max(1, len(ids) - half), half)[:, None] + np.arange(width)
            row, column = np.nonzero(at < len(ids))
            words.append(ids[at[row, column]])
            span_of.append((row + n_spans).astype(np.int32))
            doc_of_span.append(np.full(len(at), doc, np.int32))
            n_spans += len(at)
        nothing = np.zeros(0, np.int32)
        self.word = np.concatenate([nothing, *words])
        self.span = np.concatenate([nothing, *span_of])
        self.doc = np.concatenate([nothing, *doc_of_span])
        self.n_words, self.n_spans, self.width = len(place), n_spans, width
        # a few words at a time: hashing needs many times the memory of what it gives
        gram, owner, names = [], [], list(place)
        for at in range(0, len(names), 1 << 15):
            part, word, _ = grams_of(" ".join(names[at : at + (1 << 15)]), settings.rows)
            gram.append(part)
            owner.append(word + np.int32(at))
        self.gram = np.concatenate(gram) if gram else np.zeros(0, np.int32)
        self.owner = np.concatenate(owner) if owner else np.zeros(0, np.int32)
        self.size = np.maximum(1, np.bincount(self.owner, minlength=self.n_words))


def train(texts: list[str], labels: np.ndarray, settings: Settings = Settings()) -> Model:
    """Full-batch Adam on embeddings, softmax and bias together; label 0 weighs ``clean_weight`` of the loss.

    With two labels only the difference u of the softmax's columns acts on a vector, so forward pass
    and slopes need one number g per row of the table: the embedding's slope is the outer product of
    g and u, that of u is the embedding's transpose times g.

    Texts without a word are left out. With one label only, or none, the model leans to what there is.
    """
    draw = np.random.default_rng(settings.seed)
    embedding = draw.normal(0, 0.05, (settings.rows, settings.width))
    softmax = draw.normal(0, 0.5, (settings.width, 2))
    bias = np.zeros(2)
    bags = _Bags(texts, settings)
    there = np.bincount(bags.doc, minlength=len(texts)) > 0
    y = np.asarray(labels, float)
    kinds = [(there & (y == k)).sum() for k in (0, 1)]
    if not all(kinds):
        certain = 6.0 if kinds[1] else -6.0 if kinds[0] else 0.0
        return Model(np.zeros_like(embedding), softmax, np.array([0.0, certain]), settings)
    clean = settings.clean_weight
    weight = np.where(there, np.where(y == 1, (1 - clean) / kinds[1], clean / kinds[0]), 0.0)
    state = [[p, np.zeros_like(p), np.zeros_like(p)] for p in (embedding, softmax, bias)]
    sharp = settings.sharpness
    for step in range(1, settings.steps + 1):
        u = softmax[:, 1] - softmax[:, 0]
        lean = embedding @ u
        word = np.bincount(bags.owner, lean[bags.gram], bags.n_words) / bags.size
        z = np.bincount(bags.span, word[bags.word], bags.n_spans) / bags.width + bias[1] - bias[0]
        top = np.full(len(texts), -np.inf)
        np.maximum.at(top, bags.doc, z)
        share = np.exp(sharp * (z - top[bags.doc]))
        total = np.maximum(np.bincount(bags.doc, share, len(texts)), 1e-300)
        score = np.where(there, np.where(there, top, 0) + np.log(total) / sharp, 0)
        slope = (1 / (1 + np.exp(-np.clip(score, -30, 30))) - y) * weight
        dz = slope[bags.doc] * share / total[bags.doc]
        dword = np.bincount(bags.word, dz[bags.span], bags.n_words) / bags.width / bags.size
        g = np.bincount(bags.gram, dword[bags.owner], settings.rows)
        du, db = embedding.T @ g, dz.sum()
        slopes = (
            np.outer(g, u) + settings.decay * embedding,
            np.stack([-du, du], axis=1) + settings.decay * softmax,
            np.array([-db, db]),
        )
        for (p, first, second), d in zip(state, slopes, strict=True):
            first += 0.1 * (d - first)
            second += 0.01 * (d * d - second)
            p -= settings.rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return Model(embedding, softmax, bias, settings)


def fit(documents: DataFrame, labels: DataFrame, label: str = "toxic", usable: Column | None = None, settings: Settings = Settings()) -> Model:
    """A model from a sample of the documents that have a label (0 or 1) and satisfy ``usable``.

    The sample, about ``settings.sample`` documents of each label by the hash of their id, is trained
    on in one task; only the model comes to the driver.
    """
    usable = F.lit(True) if usable is None else usable
    known = labels.select("doc_id", F.col(label).cast("double").alias("y")).where(usable & F.col("y").isin(0.0, 1.0))
    known = known.groupBy("doc_id").agg(F.max("y").alias("y"))
    sizes = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    share = {y: settings.sample / max(1, sizes.get(y, 0)) for y in (0.0, 1.0)}
    drawn = hash_share("doc_id", seed=settings.seed)
    chosen = known.where(drawn < F.when(F.col("y") == 1, share[1.0]).otherwise(share[0.0]))
    near = texts_of(documents).where(usable & (drawn < max(share.values())))
    sample = near.join(chosen, "doc_id").select("text", "y").repartition(1)

    def learn(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        whole = pd.concat([*frames, pd.DataFrame({"text": pd.Series([], dtype=object), "y": pd.Series([], dtype=float)})])
        whole = whole.sort_values(["y", "text"])
        model = train(whole["text"].tolist(), whole["y"].to_numpy(float), settings)
        parts = (model.embedding.astype("<f4"), model.softmax.astype("<f8"), model.bias.astype("<f8"))
        yield pd.DataFrame([[p.tobytes() for p in parts]], columns=["embedding", "softmax", "bias"])

    made = sample.mapInPandas(learn, "embedding binary, softmax binary, bias binary").collect()
    if not made:
        return train([], np.zeros(0), settings)
    row = made[0]
    return Model(
        np.frombuffer(row["embedding"], "<f4").reshape(settings.rows, settings.width),
        np.frombuffer(row["softmax"], "<f8").reshape(settings.width, 2),
        np.frombuffer(row["bias"], "<f8"),
        settings,
    )


def score_text(text: str, lean: np.ndarray, bias: float, settings: Settings) -> float:
    """The softmax's share of label 1 at the smooth maximum over spans.

    Of the bias alone for a text without a word, and for a model that never saw both labels.
    """
    means = word_means(text, lean) if len(lean) else lean
    logit = bias + (soft_max(spans(means, settings.span), settings.sharpness) if len(means) else 0.0)
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, logit))))


def scored(documents: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """``doc_id`` and the score of every whole text (null counts as empty), one narrow pass."""
    shared = Shared(documents.sparkSession, (model.lean(), float(model.bias[1] - model.bias[0]), model.settings))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lean, bias, settings = shared.value
        for frame in frames:
            scores = [score_text(t, lean, bias, settings) for t in frame["text"]]
            yield pd.DataFrame({"doc_id": frame["doc_id"], column: np.array(scores, float)})

    chosen = texts_of(documents)
    return chosen.mapInPandas(run, f"doc_id {dict(chosen.dtypes)['doc_id']}, `{column}` double")
