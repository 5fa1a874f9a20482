"""Hand-worked frames for splits, types, features, embeddings and imputation."""

import pytest
from pyspark.sql import functions as F

from tallyweave.operators import features as FE
from tallyweave.operators import impute as I
from tallyweave.operators import timeline as TL
from tallyweave.operators.embeddings import conversation_embedding, event_embedding
from tallyweave.operators.pooling import pooled_sessions
from tallyweave.operators.split import holdout, validation_split

USERS = "user_id long, purchase_event_id long, conversation_id long, session_id long, event_number int"
ACTIONS = "session_id long, action_number int, action_tags string"
STEPS = "purchase_event_id long, event_number int, session_id long, features array<string>, positions array<int>"


@pytest.mark.parametrize("n, cut", [(5, 4), (15, 14), (25, 22)])
def test_holdout_rounds_half_to_even(spark, n, cut):
    users = spark.range(n).withColumnRenamed("id", "purchase_event_id")
    assert holdout(users).count() == cut
    assert holdout(users, test=True).agg(F.min("purchase_event_id")).first()[0] == cut


def test_holdout_by_rank_ignores_gaps(spark):
    users = spark.range(20).select((F.col("id") * 1000).alias("purchase_event_id"))
    assert holdout(users, by="rank").count() == 18
    assert holdout(users, test=True, by="rank").agg(F.min("purchase_event_id")).first()[0] == 18_000


def test_holdout_parts_are_disjoint_and_complete(spark, rows):
    users = spark.range(37).withColumnRenamed("id", "purchase_event_id")
    both = rows(holdout(users)) + rows(holdout(users, test=True))
    assert both == [(i,) for i in range(37)]


def test_validation_tail_rounds_up(spark, rows):
    events = spark.range(11).withColumnRenamed("id", "purchase_event_id")
    marked = validation_split(events).where("is_validation")
    assert rows(marked, "purchase_event_id") == [(9,), (10,)]


def test_validation_tail_cuts_inside_an_event(spark, rows):
    data = [(1, 1), (1, 2), (1, 3), (2, 1), (2, 2)]
    frame = spark.createDataFrame(data, "purchase_event_id long, event_number int")
    marked = validation_split(frame, order=("purchase_event_id", "event_number")).where("is_validation")
    assert rows(marked, "purchase_event_id", "event_number") == [(2, 2)]


def test_event_type_reads_rows_without_a_session_as_conversations(spark, rows):
    data = [
        (1, 1, 10, None, 1),
        (1, 2, None, 20, 1),
        (1, 3, 11, None, 1),
        (1, 3, None, 21, 2),
        (1, 4, 12, 22, 1),  # both ids: the session decides
        (1, 5, None, None, 1),  # neither id
    ]
    types = TL.event_type(spark.createDataFrame(data, USERS))
    assert rows(types) == [
        (1, "conversation"), (2, "session"), (3, "intersection"), (4, "session"), (5, "conversation"),
    ]


def test_attach_keeps_rows_without_details(spark, rows):
    users = spark.createDataFrame([(1, 1, None, 7, 1), (1, 1, None, 8, 2)], USERS)
    sessions = spark.createDataFrame([(7, 1, "a"), (7, 2, "b"), (9, 1, "c")], ACTIONS)
    joined = TL.timeline_actions(users, sessions)
    assert rows(joined) == [(1, 1, 7, 1, "a"), (1, 1, 7, 2, "b"), (1, 2, 8, None, None)]


def _actions(spark, data):
    schema = "purchase_event_id long, event_number int, session_id long, action_number int, action_tags string"
    return spark.createDataFrame(data, schema)


KEYS = ["purchase_event_id", "session_id", "action_number"]


def test_share_counts_repeats_and_featureless_actions(spark, rows):
    actions = _actions(spark, [(1, 1, 5, 1, "a,a,b"), (1, 1, 5, 2, None), (2, 1, 6, 1, "b")])
    shares = FE.feature_share(actions, "action_tags", KEYS)
    assert rows(shares.select("feature", "n", F.round("share", 6))) == [("a", 2, 0.666667), ("b", 2, 0.666667)]


def test_share_cut_is_inclusive(spark, rows):
    actions = _actions(spark, [(e, 1, e, 1, "rare" if e == 0 else "often") for e in range(1000)])
    kept = FE.frequent(FE.feature_share(actions, "action_tags", KEYS))
    assert rows(kept, "feature") == [("often",), ("rare",)]


def test_pruning_keeps_an_emptied_event_with_null_ids(spark, rows):
    actions = _actions(
        spark,
        [
            (1, 1, 10, 1, "x,b,b,a"),
            (1, 2, 11, 1, "rare"),  # a session that loses everything vanishes
            (2, 1, 20, 1, "a"),
            (2, 2, 21, 1, "b"),
            (3, 1, 30, 1, "rare2"),  # an event that loses everything stays
        ],
    )
    shares = FE.feature_share(actions, "action_tags", KEYS)
    pruned = FE.prune(actions, "action_tags", shares, ["session_id"], "action_number", min_share=0.4)
    assert rows(pruned) == [
        (1, 1, 10, 1, "b,b,a"), (2, 1, 20, 1, "a"), (2, 2, 21, 1, "b"), (3, None, None, None, ""),
    ]


def test_unseen_features_are_ignored_and_empty_is_a_class_only_if_fitted(spark, rows):
    fit = _actions(spark, [(1, 1, 10, 1, "a"), (2, 1, 20, 1, "b")])
    vocabulary = FE.fit_vocabulary(fit, "action_tags", KEYS)
    assert rows(vocabulary, "position", "feature") == [(0, "a"), (1, "b")]
    apply = _actions(spark, [(7, 1, 70, 1, "b,c"), (7, 1, 70, 2, "b"), (8, 1, 80, 1, "c")])
    steps = FE.encode_steps(apply, "action_tags", vocabulary, ["session_id"])
    assert rows(steps) == [(7, 1, 70, ["b"], [1]), (8, None, None, [], [])]


def test_empty_class_when_a_fitted_event_lost_everything(spark, rows):
    fit = _actions(spark, [(e, 1, e, 1, "a") for e in range(4)] + [(9, 1, 90, 1, "rare")])
    vocabulary = FE.fit_vocabulary(fit, "action_tags", KEYS, min_share=0.5)
    assert rows(vocabulary, "position", "feature") == [(0, ""), (1, "a")]
    steps = FE.encode_steps(fit, "action_tags", vocabulary, ["session_id"], min_share=0.5)
    assert (9, None, None, [""], [0]) in rows(steps)


def test_slots_are_left_padded_to_the_longest_event(spark, rows):
    steps = spark.createDataFrame(
        [(1, 4, 10, ["a"], [0]), (2, 1, 20, ["a"], [0]), (2, 5, 21, ["b"], [1]), (2, 9, 22, [], [])], STEPS
    )
    slots = FE.padded_slots(steps, ["session_id"])
    assert rows(slots, "purchase_event_id", "session_id", "slot", "n_steps") == [
        (1, 10, 3, 1), (2, 20, 1, 3), (2, 21, 2, 3), (2, 22, 3, 3),
    ]
    assert rows(FE.padded_slots(steps, ["session_id"], max_steps=5), "slot") == [(3,), (4,), (5,), (5,)]


def test_shuffled_slots_are_a_permutation_and_repeatable(spark, rows):
    steps = spark.range(40).select(
        F.lit(1).cast("long").alias("purchase_event_id"),
        F.col("id").cast("int").alias("event_number"),
        F.col("id").alias("session_id"),
    )
    first = rows(FE.shuffled_slots(steps, 1, ["session_id"]), "event_number", "slot")
    assert first == rows(FE.shuffled_slots(steps.repartition(3), 1, ["session_id"]), "event_number", "slot")
    assert sorted(s for _, s in first) == list(range(1, 41))
    assert first != rows(FE.shuffled_slots(steps, 2, ["session_id"]), "event_number", "slot")


def test_keyword_indicator_is_set_after_pruning(spark, rows):
    users = spark.createDataFrame([(1, 1, None, 10, 1), (1, 2, 5, None, 1), (1, 2, None, 20, 2)], USERS)
    sessions = spark.createDataFrame([(10, 1, "rare"), (20, 1, "a")], ACTIONS)
    talk = spark.createDataFrame(
        [(5, 0, "user", "a,b"), (5, 1, "agent", ""), (5, 2, "agent", None)],
        "conversation_id long, sentence_number int, sentence_speaker string, keywords string",
    )
    union = TL.keyword_timeline(users, sessions, talk)
    assert union.count() == 3
    vocabulary = spark.createDataFrame([("a", 9, 0.9, 0), ("b", 9, 0.9, 1)], "feature string, n long, share double, position int")
    steps = FE.keyword_features(union, vocabulary)
    assert rows(steps, "purchase_event_id", "conversation_id", "session_id", "features", "conversation_ind") == [
        (1, None, None, [], 1),  # a session event that lost its only tag reads as a conversation
        (2, None, 20, ["a"], 0),
        (2, 5, None, ["a", "b"], 1),
    ]


def test_keyword_spine_keeps_silent_events_at_test_time(spark, rows):
    users = spark.createDataFrame([(1, 1, 5, None, 1)], USERS)
    sessions = spark.createDataFrame([], ACTIONS)
    talk = spark.createDataFrame(
        [(5, 0, "user", "")], "conversation_id long, sentence_number int, sentence_speaker string, keywords string"
    )
    assert TL.keyword_timeline(users, sessions, talk).count() == 0
    kept = TL.keyword_timeline(users, sessions, talk, keep_empty_events=True)
    assert rows(kept) == [(1, None, None, None, None, None)]


EMBEDDING = "conversation_id long, sentence_number int, sentence_speaker string, embedding array<float>"


def test_event_mean_weighs_sentences_and_conversation_mean_does_not(spark, rows):
    users = spark.createDataFrame([(1, 1, 10, None, 1), (1, 1, 11, None, 2), (1, 2, 12, None, 1)], USERS)
    sentences = spark.createDataFrame(
        [(10, 0, "user", [4.0, 0.0]), (11, 0, "user", [0.0, 1.0]), (11, 1, "agent", [0.0, 2.0]), (11, 2, "user", [0.0, 3.0])],
        EMBEDDING,
    )
    assert rows(event_embedding(users, sentences)) == [(1, [1.0, 1.5]), (2, None)]
    assert rows(conversation_embedding(users, sentences), "conversation_id", "embedding") == [
        (10, [4.0, 0.0]), (11, [0.0, 2.0]), (12, None),
    ]


def test_means_skip_missing_values(spark, rows):
    users = spark.createDataFrame([(1, 1, 10, None, 1)], USERS)
    sentences = spark.createDataFrame(
        [(10, 0, "user", [1.0, None, None]), (10, 1, "user", [3.0, float("nan"), 8.0])], EMBEDDING
    )
    assert rows(event_embedding(users, sentences)) == [(1, [2.0, None, 8.0])]


def test_mean_imputation_uses_fitted_means(spark, rows):
    fitted = I.fit_mean(
        spark.createDataFrame([(1, [1.0, 4.0]), (2, [3.0, None])], "purchase_event_id long, embedding array<double>")
    )
    users = spark.createDataFrame([(1, 7, None, 1, 1), (1, 8, 2, None, 1)], USERS)
    seen = spark.createDataFrame([(8, [9.0, None])], "purchase_event_id long, embedding array<double>")
    assert rows(I.impute_conversations(users, seen, fitted)) == [(7, [2.0, 4.0]), (8, [9.0, 4.0])]


def test_mode_ties_go_to_zero_and_missing_numbers_to_one(spark, rows):
    vocabulary = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "feature string, position int")
    steps = spark.createDataFrame([(1, 1, 10, ["a", "b"], [0, 1]), (2, 1, 20, ["a"], [0])], STEPS)
    modes = I.fit_mode(steps, vocabulary)
    assert rows(modes, "feature", "mode") == [("a", 1), ("b", 0), ("c", 0)]
    users = spark.createDataFrame([(1, 1, None, 10, 1), (1, 5, 50, None, 1)], USERS)
    filled = I.impute_sessions(users, steps.where("purchase_event_id = 1"), modes)
    assert rows(filled, "purchase_event_id", "event_number", "features") == [(1, 1, ["a", "b"]), (5, 1, ["a"])]


def test_pooling_halves_with_every_step_back(spark, rows):
    steps = spark.createDataFrame(
        [(1, 1, 10, ["a"], [0]), (1, 2, 11, ["a", "b"], [0, 1]), (1, 3, 12, ["b"], [1])], STEPS
    )
    pooled = pooled_sessions(steps)
    assert rows(pooled, "feature", "any_step", "last_step", "recency") == [("a", 1.0, 0.0, 0.75), ("b", 1.0, 1.0, 1.5)]


def test_checks_count_broken_promises(spark, rows):
    users = spark.createDataFrame([(1, 0, 10, None, 1), (1, 2, 11, 12, 1)], USERS)
    items = spark.createDataFrame([(0, "1")], "purchase_event_id long, item_id string")
    assert rows(TL.timeline_checks(users, items, items)) == [
        ("an item bought per event", 1), ("an item on sale per event", 1),
        ("dense event ids from 0", 1), ("one id per row", 1),
    ]
