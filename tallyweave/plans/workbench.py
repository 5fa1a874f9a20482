"""Tables and fitted state of one input folder, shared by the registered queries.

Split timelines, feature tables and fitted state (vocabularies, imputer statistics, anchors) are
written once and read back, as a training job leaves them for the jobs that apply them. The query
of an operator calls the operator itself; only what comes before it is read from here.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.functions.vectors import dense_entries, shifted, stage_vectors
from tallyweave.operators import anchors as A
from tallyweave.operators import encoder as E
from tallyweave.operators import features as FE
from tallyweave.operators.embeddings import conversation_embedding, conversation_sums, event_embedding
from tallyweave.operators.impute import fit_mean, fit_mode
from tallyweave.operators.labels import item_labels, item_popularity, masked_scores
from tallyweave.operators.ranking import catalogue
from tallyweave.operators.split import holdout, validation_split
from tallyweave.operators.timeline import event_type, keyword_timeline, restrict, timeline_actions
from tallyweave.schemas import EVENT
from tallyweave.sources.fixture import EMBEDDING_WIDTH, RUNS, Tables, tables
from tallyweave.state import stage

N_ANCHORS = A.N_ANCHORS
ACTION_KEYS = [EVENT, "session_id", "action_number"]
KEYWORD_KEYS = [EVENT, "conversation_id", "session_id", "number"]


class Workbench:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.t: Tables = tables(spark, folder)
        self._kept: dict[str, DataFrame] = {}
        self._state: dict[str, object] = {}

    def keep(self, label: str, make: Callable[[], DataFrame]) -> DataFrame:
        if label not in self._kept:
            self._kept[label] = stage(make(), label)
        return self._kept[label]

    def state(self, label: str, make: Callable[[], object]):
        """Fitted state, or a table that ``make`` stores by itself, made once."""
        if label not in self._state:
            self._state[label] = make()
        return self._state[label]

    def prepare(self) -> None:
        """Build every shared table now instead of on first use."""
        for part in ("train", "test"):
            for table in (
                self.timeline, self.types, self.labels, self.available, self.actions, self.session_steps,
                self.keywords, self.conversations, self.event_embeddings,
            ):
                table(part)
        for state in (
            self.validation_events, self.popularity, self.masked, self.session_vocabulary,
            self.intersection_vocabulary, self.keyword_vocabulary, self.embedding_means, self.session_modes,
            self.conversation_anchors, self.session_anchors,
        ):
            state()

    # --- timeline: part is train, test, or intersection (the intersection events of train) ----

    def timeline(self, part: str) -> DataFrame:
        if part == "intersection":
            chosen = self.types("train").where(F.col("event") == "intersection")
            return restrict(self.timeline("train"), chosen)
        return self.keep(f"timeline-{part}", lambda: holdout(self.t.users, test=part == "test"))

    def types(self, part: str) -> DataFrame:
        return self.keep(f"types-{part}", lambda: event_type(self.timeline(part)))

    def events(self, part: str) -> DataFrame:
        return self.types(part).select(EVENT)

    def validation_events(self) -> DataFrame:
        return self.keep(
            "validation", lambda: validation_split(self.events("train")).where("is_validation").select(EVENT)
        )

    # --- labels and scores -----------------------------------------------------------------

    def labels(self, part: str) -> DataFrame:
        if part == "intersection":
            return restrict(self.labels("train"), self.timeline(part))
        return self.keep(
            f"labels-{part}", lambda: item_labels(restrict(self.t.purchase_events, self.timeline(part)))
        )

    def available(self, part: str) -> DataFrame:
        return self.keep(f"available-{part}", lambda: restrict(self.t.post_filter, self.timeline(part)))

    def popularity(self) -> DataFrame:
        return self.keep("popularity", lambda: item_popularity(self.labels("train")))

    def catalogue(self) -> DataFrame:
        """Items of the train part, numbered in item order."""
        return self.state("catalogue", lambda: catalogue(self.labels("train").select("item_id")))

    def on_sale(self) -> DataFrame:
        """Items that are ever on sale, numbered in item order."""
        return self.state("on-sale", lambda: catalogue(self.t.post_filter.select("item_id")))

    def scores(self, part: str, model: int = 0, runs: tuple[int, ...] = RUNS) -> DataFrame:
        return restrict(self.t.scores(model, runs), self.timeline(part))

    def masked(self, part: str = "test") -> DataFrame:
        return self.keep(f"masked-{part}", lambda: masked_scores(self.scores(part), self.available(part)))

    # --- session and keyword features ------------------------------------------------------

    def actions(self, part: str) -> DataFrame:
        if part == "intersection":
            return restrict(self.actions("train"), self.timeline(part))
        return self.keep(f"actions-{part}", lambda: timeline_actions(self.timeline(part), self.t.sessions))

    def session_vocabulary(self) -> DataFrame:
        return self.keep(
            "vocabulary-session", lambda: FE.fit_vocabulary(self.actions("train"), "action_tags", ACTION_KEYS)
        )

    def intersection_vocabulary(self) -> DataFrame:
        return self.keep(
            "vocabulary-intersection",
            lambda: FE.fit_vocabulary(self.actions("intersection"), "action_tags", ACTION_KEYS),
        )

    def session_steps(self, part: str) -> DataFrame:
        return self.keep(
            f"steps-{part}",
            lambda: FE.encode_steps(self.actions(part), "action_tags", self.session_vocabulary(), ["session_id"]),
        )

    def keywords(self, part: str) -> DataFrame:
        def make() -> DataFrame:
            return keyword_timeline(
                self.timeline(part), self.t.sessions, self.t.conversations_keyword, keep_empty_events=part == "test"
            )

        return self.keep(f"keywords-{part}", make)

    def keyword_vocabulary(self) -> DataFrame:
        return self.keep(
            "vocabulary-keyword", lambda: FE.fit_vocabulary(self.keywords("train"), "keywords", KEYWORD_KEYS)
        )

    def width(self, vocabulary: DataFrame) -> int:
        return self.state(f"width-{id(vocabulary)}", lambda: int(vocabulary.agg(F.max("position")).first()[0]) + 1)

    # --- conversations ---------------------------------------------------------------------

    def sentence_sums(self) -> DataFrame:
        """Sums of all conversations of the timeline: the wide sentence table is read once, here."""
        return self.keep("sentence-sums", lambda: conversation_sums(self.t.conversations_embedding, self.t.users))

    def conversations(self, part: str) -> DataFrame:
        return self.keep(
            f"conversations-{part}",
            lambda: conversation_embedding(self.timeline(part), self.t.conversations_embedding, self.sentence_sums()),
        )

    def event_embeddings(self, part: str) -> DataFrame:
        if part == "intersection":
            return restrict(self.event_embeddings("train"), self.timeline(part))
        return self.keep(
            f"embeddings-{part}",
            lambda: event_embedding(self.timeline(part), self.t.conversations_embedding, self.sentence_sums()),
        )

    # --- imputers --------------------------------------------------------------------------

    def embedding_means(self) -> DataFrame:
        return self.keep("imputer-mean", lambda: fit_mean(self.event_embeddings("train")))

    def session_modes(self) -> DataFrame:
        return self.keep(
            "imputer-mode", lambda: fit_mode(self.session_steps("train"), self.session_vocabulary())
        )

    # --- anchors ---------------------------------------------------------------------------

    def anchor_quotas(self) -> DataFrame:
        return self.keep("anchor-quotas", lambda: A.anchor_quota(self.labels("train"), N_ANCHORS))

    def anchor_classes(self) -> DataFrame:
        def make() -> DataFrame:
            candidates = A.anchor_candidates(self.timeline("train"))
            return A.anchor_class(candidates, self.labels("train"), self.anchor_quotas())

        return self.keep("anchor-classes", make)

    def anchors(self) -> DataFrame:
        return self.keep("anchors", lambda: A.anchor_sample(self.anchor_classes(), N_ANCHORS))

    def n_anchors(self) -> int:
        return self.state("n-anchors", lambda: self.anchors().count())

    def conversation_anchors(self) -> DataFrame:
        return self.keep(
            "anchors-conversation",
            lambda: A.anchor_vectors(self.anchors(), self.conversations("train"), "embedding"),
        )

    def session_anchors(self) -> DataFrame:
        return self.keep(
            "anchors-session", lambda: A.anchor_vectors(self.anchors(), self.session_steps("train"), "positions")
        )

    def encoder(self, modality: str) -> DataFrame:
        """The learned projection of a modality's steps, fitted on the train part."""
        return self.keep(f"encoder-{modality}", lambda: E.fit(self.encoder_steps(modality, "train"), self.labels("train")))

    def encoder_entries(self, modality: str, part: str) -> DataFrame:
        """Steps of one modality by their filled places; a conversation without sentences has none."""
        if modality == "session":
            on = F.transform("positions", lambda p: F.struct(p.cast("int").alias("at"), F.lit(1.0).alias("x")))
            return self.session_steps(part).select(EVENT, "event_number", "session_id", on.alias("entries"))
        return self.conversations(part).select(
            EVENT, "event_number", "conversation_id", shifted(dense_entries(F.transform("embedding", lambda x: F.nanvl(F.coalesce(x, F.lit(0.0)), F.lit(0.0)))), 0).alias("entries")
        )

    def encoder_steps(self, modality: str, part: str) -> DataFrame:
        """Steps of one modality with their ``vector``; a conversation without sentences has a zero vector."""
        if modality == "session":
            width, label = self.width(self.session_vocabulary()), f"encoder-steps-session-{part}"
            return self.state(label, lambda: stage_vectors(self.encoder_entries(modality, part), width, label))
        zero = F.array_repeat(F.lit(0.0), EMBEDDING_WIDTH)
        whole = F.when(F.col("embedding").isNull(), zero).otherwise(F.transform("embedding", lambda x: F.coalesce(x, F.lit(0.0))))
        rows = self.conversations(part)
        return rows.select(EVENT, "event_number", "conversation_id", array_to_vector(whole).alias("vector"))

    def encoded(self, modality: str, part: str) -> DataFrame:
        """Steps of one modality with their projections, ``encoded``."""
        return self.keep(f"encoded-{modality}-{part}", lambda: E.encode(self.encoder_steps(modality, part), self.encoder(modality)))

    def encoded_anchors(self, modality: str) -> DataFrame:
        def make() -> DataFrame:
            own = restrict(self.encoder_steps(modality, "train"), self.anchors())
            return A.anchor_vectors(self.anchors(), E.encode(own, self.encoder(modality)), "encoded")

        return self.keep(f"anchors-encoded-{modality}", make)

    def encoded_relative(self, modality: str, part: str) -> DataFrame:
        """Cosines of the projected steps with the projected anchors."""
        return A.relative_representation(self.encoded(modality, part), self.encoded_anchors(modality), "encoded")

    def encoded_modality(self, modality: str, part: str) -> A.Modality:
        """Projected steps and anchors for the means of their cosines; no projection of a step is stored."""
        found = E.projection(self.encoder(modality))
        anchors = A.unit_anchors(self.encoded_anchors(modality)).T
        steps = E.scaled(self.encoder_entries(modality, part), found)
        return A.Modality(steps, found.weights @ anchors, -found.shift @ anchors, int(modality == "conversation"))

    def plain_modality(self, modality: str, part: str) -> A.Modality:
        """Steps and anchors as they are, for the means of their cosines."""
        if modality == "session":
            anchors = A.unit_anchors(self.session_anchors(), self.width(self.session_vocabulary()))
        else:
            anchors = A.unit_anchors(self.conversation_anchors())
        length = F.sqrt(F.aggregate("entries", F.lit(0.0), lambda total, e: total + e["x"] * e["x"]))
        scale = F.when(length > 0, 1 / length).otherwise(0.0)
        steps = self.encoder_entries(modality, part).withColumn("scale", scale)
        return A.Modality(steps, anchors.T, np.zeros(len(anchors)), int(modality == "conversation"))

    def relative_conversations(self, part: str) -> DataFrame:
        return A.relative_representation(self.conversations(part), self.conversation_anchors(), "embedding")

    def relative_sessions(self, part: str) -> DataFrame:
        return A.relative_representation(
            self.session_steps(part).drop("features"),
            self.session_anchors(),
            "positions",
            width=self.width(self.session_vocabulary()),
        )


_BENCHES: dict[tuple[str, str], Workbench] = {}


def workbench(spark: SparkSession, folder: str) -> Workbench:
    key = (spark.sparkContext.applicationId, folder.rstrip("/"))
    if key not in _BENCHES:
        _BENCHES[key] = Workbench(spark, folder)
    return _BENCHES[key]
