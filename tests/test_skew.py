"""One hot key holding a third of all rows gives whole results, equal to a plain computation."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyweave.functions.positions import hash_bucket, id_bucket, with_positions, with_running_sum
from tallyweave.operators import features as FE
from tallyweave.operators import metrics as M
from tallyweave.operators import timeline as TL


@pytest.fixture(scope="module")
def hot(spark):
    """9,000 rows in 60 groups, group 0 holding a third; ids are unique and unordered."""
    rng = random.Random(3)
    ids = list(range(9_000))
    rng.shuffle(ids)
    data = [(0 if i % 3 == 0 else 1 + i % 59, x, rng.randrange(5)) for i, x in enumerate(ids)]
    return spark.createDataFrame(data, "g long, id long, v int").repartition(8)


def test_positions_equal_row_number(spark, rows, hot):
    found = with_positions(hot, ["g"], id_bucket("id", 64), ["id"], "p", total="n")
    plain = Window.partitionBy("g")
    expected = hot.withColumn("p", F.row_number().over(plain.orderBy("id"))).withColumn("n", F.count("id").over(plain))
    assert rows(found, "g", "id", "p", "n") == rows(expected, "g", "id", "p", "n")


def test_positions_over_all_rows(spark, rows, hot):
    found = with_positions(hot, [], id_bucket("id", 100), ["id"], "p")
    assert rows(found.where(F.col("p") != F.col("id") + 1)) == []
    assert found.count() == 9_000


def test_hash_positions_follow_the_hash(spark, rows, hot):
    hashed = hot.withColumn("h", F.xxhash64("id"))
    found = with_positions(hashed, ["g"], hash_bucket(F.col("h"), 6), ["h", "id"], "p")
    expected = hashed.withColumn("p", F.row_number().over(Window.partitionBy("g").orderBy("h", "id")))
    assert rows(found, "g", "id", "p") == rows(expected, "g", "id", "p")


def test_running_sum_equals_window(spark, rows, hot):
    found = with_running_sum(hot, ["g"], F.floor(F.col("id") / 50), ["id"], F.col("v"), "s")
    before = Window.partitionBy("g").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    expected = hot.withColumn("s", F.coalesce(F.sum("v").over(before), F.lit(0)))
    assert rows(found, "g", "id", "s") == rows(expected, "g", "id", "s")


def test_no_task_sees_a_whole_hot_group(spark, hot):
    """The windows of a position run over blocks: no block exceeds its width."""
    blocks = hot.groupBy("g", id_bucket("id", 64)).count()
    assert blocks.agg(F.max("count")).first()[0] <= 64


def test_hot_session_joins_whole(spark):
    users = spark.createDataFrame(
        [(1, e, None, e, 1) for e in range(30)],
        "user_id long, purchase_event_id long, conversation_id long, session_id long, event_number int",
    )
    sessions = spark.range(3_000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 29).alias("session_id"),
        F.col("id").cast("int").alias("action_number"),
        F.lit("a").alias("action_tags"),
    )
    joined = TL.timeline_actions(users, sessions)
    assert joined.where("action_number is not null").count() == 3_000
    assert joined.where("action_number is null").count() == 1  # session 29 has no action


def test_one_event_with_very_many_steps(spark):
    n = 10_000  # several blocks of event numbers
    steps = spark.range(n + 50).select(
        F.when(F.col("id") < n, 0).otherwise(F.col("id")).alias("purchase_event_id"),
        F.when(F.col("id") < n, F.col("id")).otherwise(1).cast("int").alias("event_number"),
        F.col("id").alias("session_id"),
    )
    slots = FE.padded_slots(steps, ["session_id"])
    assert slots.count() == n + 50
    hot_event = slots.where("purchase_event_id = 0")
    assert hot_event.where("slot <> event_number + 1").count() == 0
    assert slots.where(f"purchase_event_id > 0 and slot <> {n}").count() == 0


def test_auc_of_a_hot_item_with_distinct_scores(spark):
    n = 4_000
    scores = spark.range(n).select(
        F.col("id").alias("purchase_event_id"), F.lit("hot").alias("item_id"), ((F.col("id") * 7919) % n + 1).cast("double").alias("score")
    )
    labels = scores.where("score % 5 = 0").select("purchase_event_id", "item_id")
    found = M.item_auc(scores.repartition(7), labels, scores.select("purchase_event_id")).first()
    positive = [s for s in range(1, n + 1) if s % 5 == 0]
    wins = sum(s - 1 - (s - 1) // 5 for s in positive)
    assert found["auc"] == pytest.approx(wins / (len(positive) * (n - len(positive))))
