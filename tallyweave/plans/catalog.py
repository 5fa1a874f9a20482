"""Every registered query: a name and a function of the workbench.

Results are flat (arrays are exploded), whole numbers are BIGINT, and fractions are rounded to six
places, because engines add doubles in different orders.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyweave.operators import anchors as A
from tallyweave.operators import features as FE
from tallyweave.operators import fusion, joint, labels, metrics, ranking, ridge, sequences, weights
from tallyweave.operators import impute as I
from tallyweave.operators import timeline as TL
from tallyweave.operators.embeddings import conversation_embedding as conversation_means
from tallyweave.operators.embeddings import event_embedding as event_means
from tallyweave.operators.embeddings import long_vector
from tallyweave.operators.pooling import pooled_sessions
from tallyweave.operators.split import holdout, validation_split
from tallyweave.plans import scorers
from tallyweave.plans.workbench import N_ANCHORS, Workbench, workbench
from tallyweave.schemas import EVENT
from tallyweave.sources.fixture import EMBEDDING_WIDTH, ITEMS, RUNS
from tallyweave.sources.tables import pack_embedding

Plan = Callable[[Workbench], DataFrame]
PLANS: dict[str, Plan] = {}
K = 3
CURVE = (1, 2, 3, 4, 5)


def plan(function: Plan) -> Plan:
    """Register a query under the name of its function; a trailing ``_`` avoids an imported name."""
    PLANS[function.__name__.rstrip("_")] = function
    return function


def flat(df: DataFrame) -> DataFrame:
    def column(field: T.StructField):
        if isinstance(field.dataType, (T.ByteType, T.ShortType, T.IntegerType)):
            return F.col(field.name).cast("bigint")
        if isinstance(field.dataType, (T.FloatType, T.DoubleType)):
            return F.round(F.col(field.name).cast("double"), 6).alias(field.name)
        return F.col(field.name)

    return df.select(*[column(f) for f in df.schema.fields])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(function: Plan) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, folder: flat(function(workbench(spark, folder)))

    return {name: bind(function) for name, function in PLANS.items()}


# --- scans, splits, joins --------------------------------------------------------------------


@plan
def scan_timeline(w: Workbench) -> DataFrame:
    return w.t.users


@plan
def embedding_pack(w: Workbench) -> DataFrame:
    keys = ["conversation_id", "sentence_number"]
    columns = [F.col("embedding")[i].alias(f"embedding_{i + 1}") for i in range(EMBEDDING_WIDTH)]
    wide = w.t.conversations_embedding.select(*keys, *columns)
    return long_vector(pack_embedding(wide, EMBEDDING_WIDTH), keys)


@plan
def timeline_checks(w: Workbench) -> DataFrame:
    return TL.timeline_checks(w.t.users, w.t.purchase_events, w.t.post_filter)


@plan
def holdout_train(w: Workbench) -> DataFrame:
    return holdout(w.t.users)


@plan
def holdout_test(w: Workbench) -> DataFrame:
    return holdout(w.t.users, test=True)


@plan
def validation_tail(w: Workbench) -> DataFrame:
    """Conversation rows of the train part, in (event, event number, id) order."""
    rows = TL.of_modality(w.timeline("train"), "conversation")
    order = (EVENT, "event_number", "conversation_id")
    return validation_split(rows, order=order).withColumn("is_validation", F.col("is_validation").cast("int"))


@plan
def validation_split_(w: Workbench) -> DataFrame:
    return validation_split(w.events("train")).withColumn("is_validation", F.col("is_validation").cast("int"))


@plan
def timeline_actions(w: Workbench) -> DataFrame:
    return TL.timeline_actions(w.timeline("train"), w.t.sessions)


@plan
def timeline_sentences(w: Workbench) -> DataFrame:
    return TL.timeline_sentences(w.timeline("train"), w.t.conversations_keyword)


@plan
def conversation_labels(w: Workbench) -> DataFrame:
    return labels.conversation_labels(w.timeline("train"), w.labels("train"))


@plan
def split_purchases(w: Workbench) -> DataFrame:
    return TL.restrict(w.t.purchase_events, w.timeline("train"))


@plan
def missing_modality(w: Workbench) -> DataFrame:
    parts = [
        TL.missing_modality(w.timeline("train"), m).withColumn("missing", F.lit(m))
        for m in ("conversation", "session")
    ]
    return parts[0].unionByName(parts[1])


@plan
def event_spine(w: Workbench) -> DataFrame:
    return TL.event_spine(w.timeline("train"), TL.of_modality(w.timeline("train"), "session"))


# --- types and weights -----------------------------------------------------------------------


@plan
def event_type(w: Workbench) -> DataFrame:
    return TL.event_type(w.t.users)


@plan
def event_type_share(w: Workbench) -> DataFrame:
    return weights.event_type_share(w.types("train"))


@plan
def sample_weights(w: Workbench) -> DataFrame:
    return weights.sample_weights(w.types("train"))


@plan
def distillation_weights(w: Workbench) -> DataFrame:
    return weights.distillation_weights(w.types("train"))


# --- tag features ----------------------------------------------------------------------------


@plan
def feature_share(w: Workbench) -> DataFrame:
    return FE.feature_share(w.actions("train"), "action_tags", [EVENT, "session_id", "action_number"])


@plan
def pruned_tags(w: Workbench) -> DataFrame:
    def part(name: str) -> DataFrame:
        rows = FE.prune(w.actions(name), "action_tags", w.session_vocabulary(), ["session_id"], "action_number")
        return rows.withColumn("part", F.lit(name))

    return part("train").unionByName(part("test"))


@plan
def multi_hot_sessions(w: Workbench) -> DataFrame:
    steps = FE.encode_steps(w.actions("train"), "action_tags", w.session_vocabulary(), ["session_id"])
    return FE.long_features(steps, [EVENT, "event_number", "session_id"])


@plan
def padded_sequences(w: Workbench) -> DataFrame:
    slots = FE.padded_slots(w.session_steps("train"), ["session_id"])
    return FE.long_features(slots, [EVENT, "slot", "n_steps"])


@plan
def session_slots(w: Workbench) -> DataFrame:
    return FE.long_features(FE.session_slots(w.actions("test"), w.session_vocabulary()), [EVENT, "slot", "n_steps"])


@plan
def shuffled_sequences(w: Workbench) -> DataFrame:
    slots = FE.shuffled_slots(w.session_steps("train"), 42, ["session_id"])
    return FE.long_features(slots, [EVENT, "slot", "n_steps"])


@plan
def keyword_timeline(w: Workbench) -> DataFrame:
    def part(name: str) -> DataFrame:
        rows = TL.keyword_timeline(w.timeline(name), w.t.sessions, w.t.conversations_keyword, name == "test")
        return rows.withColumn("part", F.lit(name))

    return part("train").unionByName(part("test"))


@plan
def keyword_features(w: Workbench) -> DataFrame:
    def part(name: str) -> DataFrame:
        steps = FE.keyword_features(w.keywords(name), w.keyword_vocabulary()).withColumn("part", F.lit(name))
        keys = [EVENT, "event_number", "conversation_id", "session_id", "conversation_ind", "part"]
        return FE.long_features(steps, keys)

    return part("train").unionByName(part("test"))


# --- embeddings and joint features -----------------------------------------------------------


@plan
def event_embedding(w: Workbench) -> DataFrame:
    return long_vector(event_means(w.timeline("train"), w.t.conversations_embedding), [EVENT])


@plan
def conversation_embedding(w: Workbench) -> DataFrame:
    rows = conversation_means(w.timeline("train"), w.t.conversations_embedding)
    return long_vector(rows, [EVENT, "event_number", "conversation_id"])


@plan
def modality_union(w: Workbench) -> DataFrame:
    train = w.timeline("train")
    return TL.modality_union(TL.of_modality(train, "conversation"), TL.of_modality(train, "session"))


@plan
def joint_features(w: Workbench) -> DataFrame:
    steps = joint.joint_features(w.conversations("train"), w.session_steps("train"))
    keys = [EVENT, "event_number", "conversation_id", "session_id", "conversation_ind"]
    values = F.filter(
        F.transform("embedding", lambda x, i: F.struct(F.concat(F.lit("e"), i).alias("name"), x.alias("value"))),
        lambda e: F.coalesce(e["value"] != 0, F.lit(False)),
    )
    values = F.coalesce(values, F.array().cast("array<struct<name:string,value:double>>"))
    tags = F.transform("features", lambda f: F.struct(F.concat(F.lit("t:"), f).alias("name"), F.lit(1.0).alias("value")))
    return steps.select(*keys, F.explode_outer(F.concat(values, tags)).alias("_x")).select(*keys, "_x.name", "_x.value")


# --- imputation ------------------------------------------------------------------------------


@plan
def impute_conversations(w: Workbench) -> DataFrame:
    filled = I.impute_conversations(w.timeline("test"), w.event_embeddings("test"), w.embedding_means())
    return long_vector(filled, [EVENT])


@plan
def impute_sessions(w: Workbench) -> DataFrame:
    steps = I.impute_sessions(w.timeline("test"), w.session_steps("test"), w.session_modes())
    return FE.long_features(steps, [EVENT, "event_number", "session_id"])


@plan
def neutral_imputed(w: Workbench) -> DataFrame:
    """Per event: filled slots and features, and the imputed embedding summed up by its moments."""
    talk, slots = scorers.neutral_inputs(w, "test")
    folded = F.aggregate(
        F.transform("embedding", lambda x, i: x * (i + 1)), F.lit(0.0), lambda acc, x: acc + x
    )
    moments = talk.select(EVENT, folded.alias("embedding_moment"))
    return slots.join(moments, EVENT).select(EVENT, "slot", "n_steps", F.size("features").alias("n_features"), "embedding_moment")


def long_moments(moments: DataFrame) -> DataFrame:
    return moments.select("row", F.posexplode("sums").alias("column", "value"))


@plan
def generator_moments_conversation(w: Workbench) -> DataFrame:
    """Sums behind the generator of conversations from sessions."""
    return long_moments(I.generator_moments(scorers.conversation_pairs(w)))


@plan
def generator_moments_session(w: Workbench) -> DataFrame:
    """Sums behind the generator of sessions from conversations."""
    return long_moments(I.generator_moments(scorers.session_pairs(w)))


@plan
def impute_conv_generated(w: Workbench) -> DataFrame:
    return long_vector(scorers.generated_conversations(w, "test"), [EVENT])


@plan
def impute_ses_generated(w: Workbench) -> DataFrame:
    """Generated steps; an event whose steps are all empty shows with nulls."""
    lacking = TL.missing_modality(w.timeline("test"), "session")
    steps = FE.long_features(scorers.generated_sessions(w, "test"), [EVENT, "event_number"])
    return lacking.join(steps, EVENT, "left")


@plan
def impute_conv_knn(w: Workbench) -> DataFrame:
    """Mean embeddings of the nearest intersection events."""
    return long_vector(scorers.neighbour_embeddings(w, "test"), [EVENT])


@plan
def impute_ses_knn(w: Workbench) -> DataFrame:
    """Steps that the nearest intersection events share."""
    return FE.long_features(scorers.neighbour_steps(w, "test"), [EVENT, "event_number"])


@plan
def sequences_from_chunks(w: Workbench) -> DataFrame:
    """Padded sequences rebuilt from stored chunks of steps."""
    chunks = w.keep("sequence-chunks", lambda: sequences.chunked(w.session_steps("train"), ["session_id"], 2))
    rows = sequences.slots(chunks, 2).withColumn("position", F.explode_outer("positions")).drop("positions")
    names = w.session_vocabulary().select("position", "feature")
    return rows.join(names, "position", "left").select(EVENT, "slot", "n_steps", "feature")


# --- labels, popularity, masks, ranking ------------------------------------------------------


@plan
def item_labels(w: Workbench) -> DataFrame:
    return labels.item_labels(w.t.purchase_events)


@plan
def item_matrix(w: Workbench) -> DataFrame:
    return labels.item_matrix(w.labels("test"), ITEMS)


@plan
def item_popularity(w: Workbench) -> DataFrame:
    return labels.item_popularity(w.labels("train"))


@plan
def popularity_scores(w: Workbench) -> DataFrame:
    return labels.popularity_scores(w.available("test"), w.popularity())


@plan
def popularity_topk(w: Workbench) -> DataFrame:
    scores = labels.popularity_scores(w.available("test"), w.popularity())
    return ranking.topk_sparse(scores, w.events("test"), w.on_sale(), K)


@plan
def popularity_curve(w: Workbench) -> DataFrame:
    """Mean average precision of the popularity recommender at k = 1..5, from one ranking."""
    scores = labels.popularity_scores(w.available("test"), w.popularity())
    top = ranking.topk_sparse(scores, w.events("test"), w.on_sale(), max(CURVE))
    found = metrics.event_metrics(top, w.labels("test"), CURVE)
    return metrics.evaluation_report(w.types("test"), found, CURVE)


@plan
def popularity_report(w: Workbench) -> DataFrame:
    """Hit rate and mean average precision of the popularity recommender by event type."""
    found = metrics.event_metrics(popularity_topk(w), w.labels("test"), [K])
    return metrics.metrics_by_type(w.types("test"), found)


@plan
def masked_scores(w: Workbench) -> DataFrame:
    return labels.masked_scores(w.scores("test"), w.available("test"))


@plan
def ranked_items(w: Workbench) -> DataFrame:
    return ranking.ranked_items(w.masked())


@plan
def topk_items(w: Workbench) -> DataFrame:
    return ranking.topk_items(w.masked(), K)


def _metrics(w: Workbench, ks=(K,)) -> DataFrame:
    return metrics.event_metrics(ranking.topk_items(w.masked(), max(ks)), w.labels("test"), ks)


@plan
def hit_at_k(w: Workbench) -> DataFrame:
    return _metrics(w, CURVE).select("run", EVENT, "k", "hit")


@plan
def precision_at_k(w: Workbench) -> DataFrame:
    return _metrics(w, CURVE).select("run", EVENT, "k", "precision")


@plan
def recall_at_k(w: Workbench) -> DataFrame:
    return _metrics(w, CURVE).select("run", EVENT, "k", "recall")


@plan
def reciprocal_rank(w: Workbench) -> DataFrame:
    return _metrics(w, CURVE).select("run", EVENT, "k", "reciprocal_rank")


@plan
def average_precision(w: Workbench) -> DataFrame:
    return _metrics(w, CURVE).select("run", EVENT, "k", "average_precision")


@plan
def metrics_by_type(w: Workbench) -> DataFrame:
    return metrics.metrics_by_type(w.types("test"), _metrics(w), RUNS)


@plan
def metrics_over_runs(w: Workbench) -> DataFrame:
    return metrics.metrics_over_runs(metrics_by_type(w))


@plan
def map_by_k(w: Workbench) -> DataFrame:
    return metrics.map_by_k(w.types("test"), _metrics(w, CURVE), RUNS, CURVE)


@plan
def macro_auc(w: Workbench) -> DataFrame:
    valid = w.validation_events()
    scores = labels.masked_scores(TL.restrict(w.t.scores(), valid), w.t.post_filter)
    return metrics.macro_auc(scores, w.labels("train"), valid, RUNS)


# --- fusion and distillation -----------------------------------------------------------------


@plan
def late_fusion(w: Workbench) -> DataFrame:
    fused = fusion.late_fusion(w.scores("test", 0), w.scores("test", 1), w.types("test"))
    return labels.masked_scores(fused, w.available("test"))


@plan
def routed_scores(w: Workbench) -> DataFrame:
    models = {"conversation": 0, "session": 1, "intersection": 2}
    routed = fusion.routed_scores({t: w.scores("test", m) for t, m in models.items()}, w.types("test"))
    return labels.masked_scores(routed, w.available("test"))


def _targets(w: Workbench) -> DataFrame:
    teachers = [w.scores("intersection", m, (1,)) for m in (0, 1)]
    return fusion.distillation_targets(w.labels("intersection"), *teachers)


@plan
def distillation_targets(w: Workbench) -> DataFrame:
    return _targets(w)


@plan
def distillation_loss(w: Workbench) -> DataFrame:
    student = w.scores("intersection", 2, (1,))
    return fusion.distillation_loss(_targets(w), student, weights.distillation_weights(w.types("train")))


# --- anchors and relative representations ----------------------------------------------------


@plan
def anchor_candidates(w: Workbench) -> DataFrame:
    return A.anchor_candidates(w.timeline("train"))


@plan
def anchor_quota(w: Workbench) -> DataFrame:
    return A.anchor_quota(w.labels("train"), N_ANCHORS)


@plan
def anchor_class(w: Workbench) -> DataFrame:
    return A.anchor_class(A.anchor_candidates(w.timeline("train")), w.labels("train"), w.anchor_quotas())


@plan
def anchor_sample(w: Workbench) -> DataFrame:
    return A.anchor_sample(w.anchor_classes(), N_ANCHORS)


@plan
def anchor_shortfall(w: Workbench) -> DataFrame:
    return A.anchor_shortfall(w.anchor_classes(), w.anchor_quotas())


@plan
def relative_representation(w: Workbench) -> DataFrame:
    keys = [EVENT, "event_number", "conversation_ind"]
    steps = A.relative_timeline(w.relative_conversations("test"), w.relative_sessions("test"))
    return long_vector(steps, keys, "relative")


@plan
def relative_sequences(w: Workbench) -> DataFrame:
    steps = A.relative_timeline(w.relative_conversations("train"), w.relative_sessions("train"))
    slots = FE.padded_slots(steps, ["conversation_id", "session_id"])
    return long_vector(slots, [EVENT, "slot", "n_steps", "conversation_ind"], "relative")


# --- pooled features and scorers -------------------------------------------------------------


@plan
def pooled_sessions_(w: Workbench) -> DataFrame:
    return pooled_sessions(w.session_steps("train")).drop("position")


@plan
def context_counts(w: Workbench) -> DataFrame:
    """How often each item was bought after the last 0 to 3 steps of a session."""
    counts = scorers.context_tree(w).counts
    return counts.select("depth", F.translate("context", "\x1f", ">").alias("context"), "item_id", "n")


@plan
def context_shares(w: Workbench) -> DataFrame:
    return scorers.context_shares(w)


def _once(w: Workbench) -> DataFrame:
    """Every training event with the weight 1."""
    return ridge.weighted(w.events("train"), [None])


@plan
def scorer_squares_conversation(w: Workbench) -> DataFrame:
    """X'X behind the conversation scorer, the constant last."""
    return long_moments(ridge.square_moments(scorers.conversation_vectors(w, "train"), _once(w), 1))


def _bought_sums(w: Workbench, vectors) -> DataFrame:
    """X'y of every item as rows of ``item_id``, ``row`` and ``value``."""
    moments = ridge.label_moments(vectors(w, "train"), w.labels("train"), _once(w), 1)
    return moments.select("item_id", F.posexplode("sums").alias("row", "value"))


@plan
def scorer_labels_conversation(w: Workbench) -> DataFrame:
    """X'y of every item behind the conversation scorer, the constant last."""
    return _bought_sums(w, scorers.conversation_vectors)


@plan
def scorer_labels_session(w: Workbench) -> DataFrame:
    """X'y of every item behind the session scorer, by feature and way of pooling; sums of 0 are left out."""
    vocabulary = w.session_vocabulary()
    width = w.width(vocabulary)
    sums = _bought_sums(w, scorers.session_vectors).withColumn("value", F.round("value", 9)).where((F.col("value") != 0) & (F.col("row") < 3 * width))
    kind = F.element_at(F.array(F.lit("any_step"), F.lit("last_step"), F.lit("recency")), F.floor(F.col("row") / width).cast("int") + 1)
    placed = sums.select("item_id", kind.alias("pooling"), (F.col("row") % width).alias("position"), "value")
    return placed.join(vocabulary.select("feature", "position"), "position").drop("position")


@plan
def scorer_residuals_conversation(w: Workbench) -> DataFrame:
    """What the normal equations of the fitted conversation scorer leave over, item by item: nothing."""
    squares = long_moments(ridge.square_moments(scorers.conversation_vectors(w, "train"), _once(w), 1))
    fitted = scorers._model(w, scorers.conversation_vectors).coefficients
    weights_ = fitted.select("item_id", F.posexplode("coefficients").alias("column", "c"))
    shrunk = F.when((F.col("row") == F.col("column")) & (F.col("row") < EMBEDDING_WIDTH), F.lit(ridge.RIDGE)).otherwise(F.lit(0.0))
    left = squares.join(weights_, "column").groupBy("item_id", "row").agg(F.sum((F.col("value") + shrunk) * F.col("c")).alias("told"))
    both = left.join(_bought_sums(w, scorers.conversation_vectors), ["item_id", "row"])
    return both.select("item_id", "row", (F.round(F.col("told") - F.col("value"), 6) + F.lit(0.0)).alias("residual"))


@plan
def encoder_squares_conversation(w: Workbench) -> DataFrame:
    """X'X of the conversations, each once for every item of its event, behind the encoder."""
    steps = w.encoder_steps("conversation", "train")
    n = w.labels("train").groupBy(EVENT).agg(F.count(F.lit(1)).cast("double").alias("weight"))
    return long_moments(ridge.square_moments(steps, ridge.weighted(w.labels("train"), [n]), 1))


@plan
def encoder_conversation(w: Workbench) -> DataFrame:
    """Canonical correlations of conversation embeddings with bought items."""
    return w.encoder("conversation").select("direction", "correlation")


@plan
def encoder_session(w: Workbench) -> DataFrame:
    """Canonical correlations of session features with bought items."""
    return w.encoder("session").select("direction", "correlation")


@plan
def generated_steps(w: Workbench) -> DataFrame:
    """Observed and generated steps together, the generated ones read off stand-in probabilities.

    Probability (31 event + 17 age + 7 position) % 101 / 100 of the first 50 classes at ages 0 to 3, for the
    test events without a session.
    """
    vocabulary = w.session_vocabulary().where(F.col("position") < 50)
    lacking = TL.missing_modality(w.timeline("test"), "session")
    ages = lacking.select(EVENT, F.explode(F.sequence(F.lit(0), F.lit(3))).alias("age"))
    told = F.transform(
        F.sequence(F.lit(0), F.lit(49)), lambda p: ((F.col(EVENT) * 31 + F.col("age") * 17 + p * 7) % 101) / F.lit(100.0)
    )
    made = I.generated_steps(ages.withColumn("y", told), vocabulary)
    both = w.session_steps("test").unionByName(made, allowMissingColumns=True)
    return FE.long_features(both, [EVENT, "event_number", "session_id"])



PLANS.update(scorers.SCORERS)
