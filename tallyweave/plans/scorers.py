"""Inputs, fits and scores of the model families.

Each family is one multi-label ridge fit on a fixed-size event vector, with independent scores of the items;
sequence order is kept by pooling (any step, last step, halving sum), not by a recurrent net.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce, wraps

import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.functions.batches import stacked
from tallyweave.functions.vectors import dense_entries, entry, shifted, stage_vectors
from tallyweave.operators import anchors as A
from tallyweave.operators import context_tree as CT
from tallyweave.operators import features as FE
from tallyweave.operators import fusion, ridge
from tallyweave.operators import impute as I
from tallyweave.operators import neighbours as NB
from tallyweave.operators import timeline as TL
from tallyweave.operators.metrics import (
    evaluation_report,
    event_metrics,
    macro_auc,
    metrics_by_type,
    metrics_over_runs,
)
from tallyweave.operators.models import batch_score as score_batches
from tallyweave.operators.models import bootstrap_weights
from tallyweave.operators.pooling import pooled_entries, pooled_sessions
from tallyweave.operators.ranking import topk_sparse
from tallyweave.operators.split import validation_split
from tallyweave.operators.weights import distillation_weights, sample_weights
from tallyweave.plans.workbench import Workbench
from tallyweave.schemas import EVENT
from tallyweave.sources.fixture import EMBEDDING_WIDTH, RUNS
from tallyweave.state import stage

GENERATOR_RIDGE = 1.0
#: Intersection events that an imputed embedding, or session, is read off.
EMBEDDING_NEIGHBOURS, SESSION_NEIGHBOURS = 5, 2


# --- event vectors ---------------------------------------------------------------------------
# The vectors of a family and part are written once, whoever asks for them.


def _once(make):
    """``make(w, part)`` as a table that is stored on first use."""

    @wraps(make)
    def vectors(w: Workbench, part: str) -> DataFrame:
        return w.state(f"{make.__name__}-{part}", lambda: make(w, part))

    return vectors


@_once
def conversation_vectors(w: Workbench, part: str) -> DataFrame:
    rows = w.event_embeddings(part).where(F.col("embedding").isNotNull())
    return stage(rows.select(EVENT, array_to_vector("embedding").alias("vector")), f"conversation-vectors-{part}")


def _pooled(w: Workbench, steps: DataFrame, vocabulary: DataFrame, ties: tuple[str, ...]) -> DataFrame:
    return pooled_entries(steps, pooled_sessions(steps, ties), w.width(vocabulary))


def _pooled_sessions(w: Workbench, part: str) -> DataFrame:
    """Pooled steps of the sessions of a part, stored for the families that use them as they are."""
    return w.keep(f"pooled-{part}", lambda: _pooled(w, w.session_steps(part), w.session_vocabulary(), ("session_id",)))


@_once
def session_vectors(w: Workbench, part: str) -> DataFrame:
    return stage_vectors(_pooled_sessions(w, part), 3 * w.width(w.session_vocabulary()), f"session-vectors-{part}")


@_once
def keyword_vectors(w: Workbench, part: str) -> DataFrame:
    vocabulary = w.keyword_vocabulary()
    steps = w.keep(f"keyword-steps-{part}", lambda: FE.keyword_features(w.keywords(part), vocabulary))
    pooled = _pooled(w, steps, vocabulary, ("conversation_id", "session_id"))
    talk = steps.groupBy(EVENT).agg(F.avg("conversation_ind").alias("_talk"))
    size = 3 * w.width(vocabulary) + 1
    entries = F.concat(shifted(F.col("entries"), 0), entry(F.col("_talk"), size - 1))
    both = pooled.join(talk, EVENT).select(EVENT, entries.alias("entries"))
    return stage_vectors(both, size, f"keyword-vectors-{part}")


def _side_by_side(w: Workbench, talk: DataFrame, clicks: DataFrame, vocabulary: DataFrame, label: str) -> DataFrame:
    """Embeddings and pooled steps joined, zeros where one is missing, with an indicator."""
    size = EMBEDDING_WIDTH + 3 * w.width(vocabulary) + 1
    entries = F.concat(
        shifted(dense_entries(F.col("embedding")), 0),
        shifted(F.col("entries"), EMBEDDING_WIDTH),
        entry(F.col("embedding").isNotNull(), size - 1),
    )
    both = talk.join(clicks, EVENT, "full").select(EVENT, entries.alias("entries"))
    return stage_vectors(both, size, label)


@_once
def joint_vectors(w: Workbench, part: str) -> DataFrame:
    return _side_by_side(w, w.event_embeddings(part), _pooled_sessions(w, part), w.session_vocabulary(), f"joint-vectors-{part}")


@_once
def student_vectors(w: Workbench, part: str) -> DataFrame:
    """As ``joint_vectors``, with the vocabulary of the intersection events that the student learns from."""
    vocabulary = w.intersection_vocabulary()
    clicks = _pooled(w, _steps(w, part), vocabulary, ("session_id",))
    return _side_by_side(w, w.event_embeddings(part), clicks, vocabulary, f"student-vectors-{part}")


def _mean_relative(w: Workbench, part: str, modality, steps, label: str) -> DataFrame:
    """Mean relative representation of an event's steps, with the share of conversations last."""
    if w.n_anchors() <= A.ANCHOR_BLOCK:
        means = A.mean_cosines([modality(kind, part) for kind in ("conversation", "session")])
        return stage(means.select(EVENT, array_to_vector("mean").alias("vector")), label)
    each = A.relative_timeline(*steps())
    step = F.concat("relative", F.array(F.col("conversation_ind").cast("double")))
    return stage(each.groupBy(EVENT).agg(Summarizer.mean(array_to_vector(step)).alias("vector")), label)


@_once
def relative_vectors(w: Workbench, part: str) -> DataFrame:
    steps = lambda: (w.relative_conversations(part), w.relative_sessions(part))
    return _mean_relative(w, part, w.plain_modality, steps, f"relative-vectors-{part}")


@_once
def relative_encoded_vectors(w: Workbench, part: str) -> DataFrame:
    """As ``relative_vectors``, with the learned projections in front of the cosines."""
    steps = lambda: (w.encoded_relative("conversation", part), w.encoded_relative("session", part))
    return _mean_relative(w, part, w.encoded_modality, steps, f"relative-encoded-vectors-{part}")


def neutral_inputs(w: Workbench, part: str) -> tuple[DataFrame, DataFrame]:
    """Imputed embeddings by event, and imputed session slots: two tables keyed by event."""
    timeline = w.timeline(part)
    talk = I.impute_conversations(timeline, w.event_embeddings(part), w.embedding_means())
    steps = I.impute_sessions(timeline, w.session_steps(part), w.session_modes())
    return talk, FE.padded_slots(steps, ["session_id"])


@_once
def neutral_vectors(w: Workbench, part: str) -> DataFrame:
    timeline, vocabulary = w.timeline(part), w.session_vocabulary()
    talk = I.impute_conversations(timeline, w.event_embeddings(part), w.embedding_means())
    steps = I.impute_sessions(timeline, w.session_steps(part), w.session_modes())
    clicks = _pooled(w, steps, vocabulary, ("session_id",))
    return _side_by_side(w, talk, clicks, vocabulary, f"neutral-vectors-{part}")


# --- generated modality ----------------------------------------------------------------------


def _steps(w: Workbench, part: str) -> DataFrame:
    """Steps under the vocabulary fitted on intersection events."""
    return w.keep(
        f"generator-steps-{part}",
        lambda: FE.encode_steps(w.actions(part), "action_tags", w.intersection_vocabulary(), ["session_id"]),
    )


def _with_pooled(w: Workbench, part: str, made: DataFrame) -> DataFrame:
    """Pooled steps of the events with a session, stored once for all families, and those made for events without one."""
    vocabulary = w.intersection_vocabulary()
    own = w.keep(f"pooled-intersection-{part}", lambda: _pooled(w, _steps(w, part), vocabulary, ("session_id",)))
    return own.unionByName(_pooled(w, made, vocabulary, ()))


def _any_step(w: Workbench, part: str) -> DataFrame:
    """Features of an event in any of its steps, as one 0/1 vector."""
    single = _steps(w, part).select(EVENT, F.explode_outer("positions").alias("_at"))
    places = single.groupBy(EVENT).agg(F.collect_set("_at").alias("_on"))
    width = w.width(w.intersection_vocabulary())
    return places.select(EVENT, I.dense_ones(F.col("_on"), width).alias("x"))


def _embedded(w: Workbench, part: str) -> DataFrame:
    rows = w.event_embeddings(part).where(F.col("embedding").isNotNull())
    return rows.select(EVENT, F.col("embedding").alias("x"))


def conversation_pairs(w: Workbench) -> DataFrame:
    talk = _embedded(w, "intersection").withColumnRenamed("x", "y")
    return _any_step(w, "intersection").join(talk, EVENT)


def session_pairs(w: Workbench) -> DataFrame:
    """All steps of the intersection events with their event's embedding."""
    return I.step_pairs(_embedded(w, "intersection"), _steps(w, "intersection"), w.width(w.intersection_vocabulary()))


def conversation_generator(w: Workbench) -> DataFrame:
    return w.keep("generator-conversation", lambda: I.fit_generator(conversation_pairs(w), GENERATOR_RIDGE))


def session_generator(w: Workbench) -> DataFrame:
    return w.keep("generator-session", lambda: I.fit_discriminant(session_pairs(w), GENERATOR_RIDGE))


def length_generator(w: Workbench) -> DataFrame:
    pairs = I.length_pairs(_embedded(w, "intersection"), _steps(w, "intersection"))
    return w.keep("generator-length", lambda: I.fit_generator(pairs, GENERATOR_RIDGE))


def generated_conversations(w: Workbench, part: str) -> DataFrame:
    """Embeddings of events without a conversation, read off their sessions."""
    generator = conversation_generator(w)
    lacking = TL.missing_modality(w.timeline(part), "conversation")
    rows = _any_step(w, part).join(lacking, EVENT, "left_semi")
    return I.generate(rows, generator, [EVENT]).withColumnRenamed("y", "embedding")


def generated_sessions(w: Workbench, part: str) -> DataFrame:
    """Steps of events without a session, read off their conversations."""
    generator = session_generator(w)
    lacking = TL.missing_modality(w.timeline(part), "session")
    rows = _embedded(w, part).join(lacking, EVENT, "left_semi")
    longest = w.state("longest", lambda: _steps(w, "intersection").groupBy(EVENT).count().agg(F.max("count")).first()[0] or 1)
    return I.generate_steps(rows, generator, length_generator(w), longest, w.intersection_vocabulary())


@_once
def generated_vectors(w: Workbench, part: str) -> DataFrame:
    """Both modalities of every event, the missing one generated."""
    vocabulary = w.intersection_vocabulary()
    talk = _embedded(w, part).withColumnRenamed("x", "embedding").unionByName(generated_conversations(w, part))
    return _side_by_side(w, talk, _with_pooled(w, part, generated_sessions(w, part)), vocabulary, f"generated-vectors-{part}")


# --- missing modality from the nearest intersection events ------------------------------------


def _lacking(w: Workbench, part: str, modality: str) -> DataFrame:
    return TL.missing_modality(w.timeline(part), modality)


def _step_sets(w: Workbench, part: str) -> DataFrame:
    """The places that an event fills in any of its steps, in order."""
    single = _steps(w, part).select(EVENT, F.explode_outer("positions").alias("_at"))
    return single.groupBy(EVENT).agg(F.array_sort(F.collect_set("_at")).alias("on"))


def _set_vectors(w: Workbench, sets: DataFrame, label: str) -> DataFrame:
    """Step sets as 0/1 vectors ``x``, stored by their places."""
    ones = F.transform("on", lambda p: F.struct(p.cast("int").alias("at"), F.lit(1.0).alias("x")))
    return stage_vectors(sets.select(EVENT, ones.alias("entries")), w.width(w.intersection_vocabulary()), label).withColumnRenamed("vector", "x")


def conversation_questions(w: Workbench, part: str) -> DataFrame:
    """Events without a conversation with their step set, and ``question``, the smallest event that has the same."""

    def make() -> DataFrame:
        sets = stage(_step_sets(w, part).join(_lacking(w, part, "conversation"), EVENT, "left_semi"), f"step-sets-{part}")
        named = sets.groupBy("on").agg(F.min(EVENT).alias("question"))
        return sets.hint("merge").join(named, "on").select(EVENT, "question", "on")

    return w.keep(f"questions-conversation-{part}", make)


def conversation_neighbours(w: Workbench, part: str) -> DataFrame:
    """For each ``question`` of the events without a conversation the intersection events with the most similar sessions."""

    def make() -> DataFrame:
        told = _embedded(w, "intersection").select(EVENT)
        asking = conversation_questions(w, part).where(F.col("question") == F.col(EVENT))
        references = _step_sets(w, "intersection").join(told, EVENT, "left_semi")
        return NB.nearest(
            _set_vectors(w, asking, f"question-sets-{part}"), _set_vectors(w, references, "reference-sets"), EMBEDDING_NEIGHBOURS
        )

    return w.keep(f"neighbours-conversation-{part}", make)


def session_neighbours(w: Workbench, part: str) -> DataFrame:
    """For events without a session the intersection events with the most similar conversations."""

    def make() -> DataFrame:
        questions = _embedded(w, part).join(_lacking(w, part, "session"), EVENT, "left_semi")
        return NB.nearest(questions, _embedded(w, "intersection"), SESSION_NEIGHBOURS)

    return w.keep(f"neighbours-session-{part}", make)


def neighbour_embeddings(w: Workbench, part: str) -> DataFrame:
    references = _embedded(w, "intersection").withColumnRenamed("x", "embedding")
    of = NB.imputed_embeddings(conversation_neighbours(w, part), references).withColumnRenamed(EVENT, "question")
    return conversation_questions(w, part).join(of.hint("merge"), "question").select(EVENT, "embedding")


def neighbour_steps(w: Workbench, part: str) -> DataFrame:
    aged = w.keep("aged-intersection", lambda: FE.with_ages(_steps(w, "intersection"), ["session_id"]).select(EVENT, "age", "features", "positions"))
    return NB.imputed_steps(session_neighbours(w, part), aged)


@_once
def neighbour_vectors(w: Workbench, part: str) -> DataFrame:
    """Both modalities of every event, the missing one from its nearest intersection events."""
    talk = _embedded(w, part).withColumnRenamed("x", "embedding").unionByName(neighbour_embeddings(w, part))
    return _side_by_side(w, talk, _with_pooled(w, part, neighbour_steps(w, part)), w.intersection_vocabulary(), f"neighbour-vectors-{part}")


# --- fits and scores -------------------------------------------------------------------------
# Scores are sparse: of the items on sale alone, all others count as 0.


def _weights(w: Workbench, vectors) -> DataFrame | None:
    """Extra weights of a family's training events."""
    return sample_weights(w.types("train")) if vectors is joint_vectors else None


def _run_weights(w: Workbench, extra: DataFrame | None, runs: Sequence[int]) -> list[DataFrame | None]:
    """Weights of the training events in each run: the family's, times the draws of the run."""

    def of(run: int) -> DataFrame | None:
        if run == 1:
            return extra
        drawn = bootstrap_weights(w.events("train"), run)
        if extra is None:
            return drawn
        both = drawn.join(extra.select(EVENT, F.col("weight").alias("_w")), EVENT)
        return both.select(EVENT, (F.col("weight") * F.col("_w")).alias("weight"))

    return [of(run) for run in runs]


def _model(w: Workbench, vectors, runs: Sequence[int] = (1,)) -> ridge.Scorer:
    """The scorers of all runs, fitted on the train part together and shared by the queries that use them."""

    def make() -> ridge.Scorer:
        return ridge.fit(vectors(w, "train"), w.labels("train"), _run_weights(w, _weights(w, vectors), runs))

    return w.state(f"model-{vectors.__name__}-{tuple(runs)}", make)


def _scores(w: Workbench, vectors, runs: Sequence[int] = (1,)) -> DataFrame:
    def make() -> DataFrame:
        return ridge.score(_model(w, vectors, runs), vectors(w, "test"), w.available("test"), runs)

    return w.keep(f"scores-{vectors.__name__}-{len(runs)}", make)


def _student(w: Workbench, runs: Sequence[int] = (1,)) -> ridge.Scorer:
    """The student on intersection events, taught by the linear scores of the conversation and session scorers."""

    def make() -> ridge.Scorer:
        teachers = [(conversation_vectors, "alpha"), (session_vectors, "beta")]
        shares = distillation_weights(w.types("train")).first()
        own = student_vectors(w, "intersection")
        for vectors, _ in teachers:
            own = TL.restrict(own, vectors(w, "train"))
        weights = ridge.weighted(own, _run_weights(w, None, runs))
        weights, n = stage(weights, "run-weights"), len(runs)
        told = [
            (ridge.cross_moments(own, vectors(w, "train"), weights, n), _model(w, vectors, runs), shares[share])
            for vectors, share in teachers
        ]
        bought = ridge.label_moments(own, w.labels("intersection"), weights, n)
        return ridge.solve(ridge.square_moments(own, weights, n), bought, n, teachers=told)

    return w.state(f"student-{tuple(runs)}", make)


def _distilled(w: Workbench, runs: Sequence[int] = (1,)) -> DataFrame:
    def make() -> DataFrame:
        both = w.types("test").where(F.col("event") == "intersection")
        return ridge.score(_student(w, runs), TL.restrict(student_vectors(w, "test"), both), w.available("test"), runs)

    return w.keep(f"scores-distilled-{len(runs)}", make)


def _fused(w: Workbench, runs: Sequence[int] = (1,)) -> DataFrame:
    return fusion.late_fusion(_scores(w, conversation_vectors, runs), _scores(w, session_vectors, runs), w.types("test"))


def session_contexts(w: Workbench, part: str) -> DataFrame:
    return w.keep(f"contexts-{part}", lambda: CT.contexts(CT.symbols(w.session_steps(part), w.session_vocabulary())))


def context_tree(w: Workbench) -> CT.ContextTree:
    return w.state("context-tree", lambda: CT.fit(session_contexts(w, "train"), w.labels("train")))


def context_shares(w: Workbench) -> DataFrame:
    """Shares of the items on sale after the last steps of each test event, and without them."""
    return CT.shares(context_tree(w), session_contexts(w, "test"), w.available("test"))


def _ordered(w: Workbench, runs: Sequence[int] = (1,)) -> DataFrame:
    """Session scores with the odds of what follows the last steps; the runs share one context tree."""
    told = w.keep("context-shares", lambda: context_shares(w))
    return CT.joined(_scores(w, session_vectors, runs), told)


def _routed(w: Workbench, runs: Sequence[int] = (1,)) -> DataFrame:
    by_type = {
        "conversation": _scores(w, conversation_vectors, runs),
        "session": _scores(w, session_vectors, runs),
        "intersection": _distilled(w, runs),
    }
    return fusion.routed_scores(by_type, w.types("test"))


def score_conversation(w: Workbench) -> DataFrame:
    return _scores(w, conversation_vectors)


def score_session(w: Workbench) -> DataFrame:
    return _scores(w, session_vectors)


def score_session_ordered(w: Workbench) -> DataFrame:
    return _ordered(w)


def score_keyword(w: Workbench) -> DataFrame:
    return _scores(w, keyword_vectors)


def score_joint(w: Workbench) -> DataFrame:
    return _scores(w, joint_vectors)


def score_relative(w: Workbench) -> DataFrame:
    return _scores(w, relative_vectors)


def score_relative_encoded(w: Workbench) -> DataFrame:
    return _scores(w, relative_encoded_vectors)


def score_neutral_imputed(w: Workbench) -> DataFrame:
    return _scores(w, neutral_vectors)


def score_generated(w: Workbench) -> DataFrame:
    return _scores(w, generated_vectors)


def score_knn_imputed(w: Workbench) -> DataFrame:
    return _scores(w, neighbour_vectors)


def score_distilled(w: Workbench) -> DataFrame:
    return _distilled(w)


def score_late_fusion(w: Workbench) -> DataFrame:
    """Fitted conversation and session scores, averaged on intersections."""
    return _fused(w)


def score_routed(w: Workbench) -> DataFrame:
    """Conversation, session and distilled scorers, each on the events of its type."""
    return _routed(w)


def _predict(matrix, batch: pd.DataFrame) -> pd.DataFrame:
    made = I.apply_generator(matrix, stacked(batch["x"]))
    return pd.DataFrame({EVENT: batch[EVENT], "length": (made**2).sum(axis=1) ** 0.5})


def batch_score(w: Workbench) -> DataFrame:
    """Any fitted object applied to Arrow batches: here the length of generated embeddings."""
    matrix = I.generator_matrix(conversation_generator(w))
    return score_batches(_any_step(w, "test"), matrix, _predict, f"{EVENT} bigint, length double")


# --- evaluation ------------------------------------------------------------------------------


CURVE = (1, 2, 3, 4, 5)


def _of_vectors(vectors):
    return lambda w, runs=(1,): _scores(w, vectors, runs), lambda w: vectors(w, "test").select(EVENT)


def _by_type(**families):
    """The events that the scorer of their type scores."""

    def events(w: Workbench) -> DataFrame:
        types = w.types("test")
        parts = [TL.restrict(types.where(F.col("event") == t), v(w, "test")) for t, v in families.items()]
        return reduce(lambda a, b: a.unionByName(b), parts).select(EVENT)

    return events


def _of_fusion(w: Workbench) -> DataFrame:
    talk, clicks, types = conversation_vectors(w, "test"), session_vectors(w, "test"), w.types("test")
    one = TL.restrict(types.where(F.col("event") != "session"), talk)
    other = TL.restrict(types.where(F.col("event") != "conversation"), clicks)
    return one.unionByName(other).select(EVENT).distinct()


#: Of each family: its scores by run, the test events it scores, whether a report has a union row.
FAMILIES = {
    "conversation": (*_of_vectors(conversation_vectors), False),
    "session": (*_of_vectors(session_vectors), False),
    "session_ordered": (_ordered, lambda w: session_vectors(w, "test").select(EVENT), False),
    "keyword": (*_of_vectors(keyword_vectors), True),
    "joint": (*_of_vectors(joint_vectors), True),
    "relative": (*_of_vectors(relative_vectors), True),
    "relative_encoded": (*_of_vectors(relative_encoded_vectors), True),
    "neutral_imputed": (*_of_vectors(neutral_vectors), True),
    "generated": (*_of_vectors(generated_vectors), True),
    "knn_imputed": (*_of_vectors(neighbour_vectors), True),
    "late_fusion": (_fused, _of_fusion, True),
    "distilled": (
        _routed,
        _by_type(conversation=conversation_vectors, session=session_vectors, intersection=student_vectors),
        True,
    ),
}


def best_items(w: Workbench, scores: DataFrame, events: DataFrame, k: int, runs=(1,)) -> DataFrame:
    """The first ``k`` items of each scored event and run; items without a score count as 0."""
    each = events.withColumn("run", F.explode(F.lit(list(runs))))
    return topk_sparse(scores, each, w.catalogue(), k)


def _evaluation(family: str):
    """Hit rate and mean average precision at k = 1..5 by event type, from one ranking."""
    scores, events, union = FAMILIES[family]

    def evaluate(w: Workbench) -> DataFrame:
        found = event_metrics(best_items(w, scores(w), events(w), max(CURVE)), w.labels("test"), CURVE)
        return evaluation_report(w.types("test"), found.drop("run"), CURVE, union)

    return evaluate


def run_evaluation(family: str):
    """Five bootstrap runs from one reading of the vectors, reported by type at k = 3 and averaged."""
    scores, events, union = FAMILIES[family]

    def evaluate(w: Workbench) -> DataFrame:
        found = event_metrics(best_items(w, scores(w, RUNS), events(w), 3, RUNS), w.labels("test"), [3])
        return metrics_over_runs(metrics_by_type(w.types("test"), found, RUNS, union=union))

    return evaluate


EVALUATIONS = {f"evaluate_{family}": _evaluation(family) for family in FAMILIES}
#: Families whose five runs are registered.
REPEATED = tuple(FAMILIES)
EVALUATIONS |= {f"evaluate_{family}_runs": run_evaluation(family) for family in REPEATED}


def validation_auc(w: Workbench) -> DataFrame:
    """Macro AUC of every family with vectors of its own, fitted before the validation tail and scored on it.

    The distilled student takes the last 11 % of the events as its tail, the others 10 %.
    """
    valid = w.validation_events()
    families = (
        conversation_vectors, session_vectors, keyword_vectors, joint_vectors, relative_vectors, relative_encoded_vectors,
        neutral_vectors, generated_vectors, neighbour_vectors,
    )
    on_sale = w.keep("available-validation", lambda: TL.restrict(w.available("train"), valid))
    reports = [tail_auc(w, v, "train", valid, on_sale, _weights(w, v)) for v in families]
    tail = validation_split(w.types("train").where(F.col("event") == "intersection").select(EVENT), 0.11)
    tail = tail.where("is_validation").select(EVENT)
    reports.append(tail_auc(w, student_vectors, "intersection", tail, TL.restrict(w.available("train"), tail)))
    return reduce(lambda a, b: a.unionByName(b), reports)


def tail_auc(w: Workbench, vectors, part: str, valid: DataFrame, on_sale: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """Macro AUC of a family on the events in ``valid``, of which ``on_sale`` has the items."""
    rows = vectors(w, part)
    model = ridge.fit(rows.join(valid, EVENT, "left_anti"), w.labels("train"), [weights])
    held = rows.join(valid, EVENT, "left_semi")
    scores = ridge.score(model, held, on_sale, (1,)).drop("run")
    report = macro_auc(scores, w.labels("train"), held.select(EVENT))
    return report.withColumn("model", F.lit(vectors.__name__.removesuffix("_vectors")))


SCORERS = {
    f.__name__: f
    for f in (
        score_conversation, score_session, score_session_ordered, score_keyword, score_joint, score_relative, score_relative_encoded,
        score_neutral_imputed, score_generated, score_knn_imputed, score_distilled, score_late_fusion, score_routed, batch_score, validation_auc,
    )
} | EVALUATIONS
