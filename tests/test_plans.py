"""The physical plans: what is pushed down, what is broadcast, and what never happens."""

import re

import pytest
from pyspark.sql import functions as F

from tallyweave.operators import anchors as A
from tallyweave.operators import features as FE
from tallyweave.operators import labels as L
from tallyweave.operators import ranking as R
from tallyweave.operators.embeddings import event_embedding
from tallyweave.operators.split import holdout
from tallyweave.operators.timeline import timeline_checks
from tallyweave.plans import catalog, oracles
from tallyweave.plans.workbench import workbench
from tallyweave.state import stage

FOLDER = "/root/testdata/sf0.001"
# the only queries with an oracle that multiply matrices in Python
MATRIX = {
    "relative_representation", "relative_sequences", "generator_moments_conversation", "generator_moments_session",
    "scorer_squares_conversation", "scorer_residuals_conversation", "encoder_squares_conversation", "impute_conv_knn", "impute_ses_knn",
}


def explained(df) -> str:
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )


def test_holdout_cut_reaches_the_scan(spark, tmp_path):
    spark.range(100).select(F.col("id").alias("purchase_event_id")).write.parquet(str(tmp_path / "u"))
    plan = explained(holdout(spark.read.parquet(str(tmp_path / "u"))))
    assert re.search(r"PushedFilters: \[.*LessThan\(purchase_event_id,ScalarSubquery", plan)


def test_only_the_needed_columns_are_read(spark, tmp_path):
    schema = "conversation_id long, sentence_number int, sentence_speaker string, embedding array<float>"
    spark.createDataFrame([(1, 1, "user", [1.0])], schema).write.parquet(str(tmp_path / "e"))
    users = spark.createDataFrame([(1, 1)], "purchase_event_id long, conversation_id long").withColumn(
        "event_number", F.lit(1)
    )
    plan = explained(event_embedding(users, spark.read.parquet(str(tmp_path / "e"))))
    assert "ReadSchema: struct<conversation_id:bigint,embedding:array<float>>" in plan


def test_a_stored_vocabulary_is_broadcast_only_below_the_threshold(spark, rows):
    actions = spark.createDataFrame(
        [(1, 1, 1, 1, "a")], "purchase_event_id long, event_number int, session_id long, action_number int, action_tags string"
    )
    fitted = FE.fit_vocabulary(actions, "action_tags", ["purchase_event_id", "session_id", "action_number"])
    vocabulary = stage(fitted, "plan-vocabulary")
    small = FE.prune_long(actions, "action_tags", vocabulary)
    assert "BroadcastHashJoin" in explained(small)
    expected = rows(small)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        large = FE.prune_long(actions, "action_tags", vocabulary)
        assert "BroadcastHashJoin" not in explained(large)
        assert rows(large) == expected
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_top_k_limits_before_the_shuffle(spark):
    scores = spark.createDataFrame([(1, "a", 0.5)], "purchase_event_id long, item_id string, score double")
    plan = explained(R.topk_items(scores, 3))
    partial = plan.index("WindowGroupLimit")
    assert plan.count("WindowGroupLimit") >= 2 and partial >= 0


def test_anchor_quota_limits_before_the_shuffle(spark):
    classes = spark.createDataFrame([(1, "a", 2)], "purchase_event_id long, class string, quota int")
    assert explained(A.anchor_sample(classes, 10)).count("WindowGroupLimit") >= 2


def test_sparse_top_k_shuffles_the_scores_once(spark, tmp_path):
    schema = "purchase_event_id long, item_id string, score double"
    spark.createDataFrame([(1, "a", 0.5)], schema).write.parquet(str(tmp_path / "scores"))
    scores = spark.read.parquet(str(tmp_path / "scores"))
    events = spark.range(3).withColumnRenamed("id", "purchase_event_id")
    items = spark.createDataFrame([("a",), ("b",)], "item_id string")
    plan = R.topk_sparse(scores, events, items, 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("score") and plan.count("Exchange hashpartitioning(purchase_event_id") <= 2


@pytest.mark.parametrize("name", sorted(oracles.oracle_sql()))
def test_no_cross_join_and_no_python_beside_matrices(spark, name):
    plan = explained(catalog.PLANS[name](workbench(spark, FOLDER)))
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    if name not in MATRIX:
        assert "Python" not in plan and "Pandas" not in plan


def test_popularity_does_not_multiply_events_with_items(spark):
    on_sale = spark.createDataFrame([(1, "a")], "purchase_event_id long, item_id string")
    plan = explained(L.popularity_scores(on_sale, L.item_popularity(on_sale)))
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_checks_meet_the_stored_tables_by_shuffle(spark, rows):
    users = spark.createDataFrame([(0, 1, None), (1, None, 2), (2, 3, None)], "purchase_event_id long, conversation_id long, session_id long")
    bought = stage(spark.createDataFrame([(0, "1"), (0, "2"), (1, "1")], "purchase_event_id long, item_id string"), "plan-checks")
    checks = timeline_checks(stage(users, "plan-users"), bought, bought)
    # neither table may pass through the driver, however small its files
    assert explained(checks).count("SortMergeJoin LeftAnti") >= 2 and "BroadcastHashJoin LeftAnti" not in explained(checks)
    assert rows(checks)[:2] == [("an item bought per event", 1), ("an item on sale per event", 1)]
