"""Readers, shards, packing and stored state."""

import math

import pytest
from pyspark.sql import functions as F

from tallyweave import state
from tallyweave.operators import features as FE
from tallyweave.sources import tables as S


def _write(path, text):
    path.write_text(text)
    return str(path)


def test_users_with_float_ids(spark, rows, tmp_path):
    path = _write(
        tmp_path / "users.csv",
        "user_id,purchase_event_id,conversation_id,session_id,event_number\n1,0,12.0,,1\n1,0,,9007199254740993,2\n",
    )
    assert rows(S.read_users(spark, path)) == [(1, 0, None, 9007199254740993, 2), (1, 0, 12, None, 1)]


def test_comma_lists_and_missing_lists(spark, rows, tmp_path):
    path = _write(tmp_path / "s.csv", 'session_id,action_number,action_tags\n1,1,"a,b"\n1,2,\n')
    assert rows(S.read_sessions(spark, path)) == [(1, 1, "a,b"), (1, 2, None)]
    path = _write(
        tmp_path / "k.csv", 'conversation_id,sentence_number,sentence_speaker,keywords\n5,1,user,"x,y"\n'
    )
    assert rows(S.read_conversations_keyword(spark, path)) == [(5, 1, "user", "x,y")]


HEADER = "user_id,purchase_event_id,conversation_id,session_id,event_number"


def test_columns_are_read_by_name(spark, rows, tmp_path):
    path = _write(tmp_path / "u.csv", "purchase_event_id,extra,user_id,event_number,session_id,conversation_id\n7,x,1,1,,5\n")
    assert rows(S.read_users(spark, path)) == [(1, 7, 5, None, 1)]
    lacking = _write(tmp_path / "l.csv", "user_id,purchase_event_id\n1,2\n")
    with pytest.raises(ValueError, match="no column conversation_id"):
        S.read_users(spark, lacking)


def test_every_shard_has_its_own_order(spark, rows, tmp_path):
    shards = tmp_path / "shards"
    shards.mkdir()
    _write(shards / "e_1.csv", "conversation_id,sentence_number,sentence_speaker,embedding_1,embedding_2\n1,1.0,user,0.5,2\n")
    _write(shards / "e_2.csv", "embedding_2,embedding_1,sentence_speaker,sentence_number,conversation_id\n4,3,agent,1,2\n")
    found = S.read_conversations_embedding(spark, str(shards), width=2)
    assert rows(found) == [(1, 1, "user", [0.5, 2.0]), (2, 1, "agent", [3.0, 4.0])]
    both = [str(shards / "e_1.csv"), str(shards / "e_2.csv")]
    assert rows(S.read_conversations_embedding(spark, both, width=2)) == rows(found)


def test_a_thousand_shards_take_one_job(spark, rows, tmp_path):
    shards = tmp_path / "many shards"
    shards.mkdir()
    for i in range(1000):
        names = ["purchase_event_id", "item_id"] if i % 3 else ["item_id", '"more, of it"', "purchase_event_id"]
        values = {"purchase_event_id": str(i), "item_id": f"x{i}", '"more, of it"': '"a,b"'}
        _write(shards / f"p_{i}.csv", "\n" * (i % 2) + ",".join(names) + "\n" + ",".join(values[n] for n in names) + "\n")
    _write(shards / "p_empty.csv", "")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("headers", "")
    try:
        found = S.headers(spark, str(shards))
    finally:
        spark.sparkContext._jsc.clearJobGroup()
    assert len(tracker.getJobIdsForGroup("headers")) <= 4  # the stages of one adaptive plan, and the listing of the files
    assert sorted((h, len(files)) for h, files in found) == [(("item_id", "more, of it", "purchase_event_id"), 334), (("purchase_event_id", "item_id"), 666)]
    assert rows(S.read_purchase_events(spark, str(shards))) == [(i, f"x{i}") for i in range(1000)]


def test_doubled_quotes(spark, rows, tmp_path):
    path = _write(tmp_path / "s.csv", 'session_id,action_number,action_tags\n1,1,"x ""q"",y"\n')
    assert rows(S.read_sessions(spark, path)) == [(1, 1, 'x "q",y')]


@pytest.mark.parametrize("text", ["12.5", "x", "1e40", "12,3,4,5,6,7"])
def test_a_bad_number_raises(spark, tmp_path, text):
    path = _write(tmp_path / "u.csv", f"{HEADER}\n1,{text},,3,1\n")
    with pytest.raises(Exception):  # noqa: B017 - Spark's own kinds, by the place that notices
        S.read_users(spark, path).collect()


def test_floats_that_are_whole(spark, rows, tmp_path):
    path = _write(tmp_path / "u.csv", f"{HEADER}\n1.0,1e+3,1e16,,2\n")
    assert rows(S.read_users(spark, path)) == [(1, 1000, 10**16, None, 2)]
    sessions = _write(tmp_path / "s.csv", "session_id,action_number,action_tags\n1.0,2.0,a\n")
    assert rows(S.read_sessions(spark, sessions)) == [(1, 2, "a")]


def test_items_stay_text(spark, rows, tmp_path):
    path = _write(tmp_path / "p.csv", "purchase_event_id,item_id\n0,007\n0,10;2\n")
    assert rows(S.read_purchase_events(spark, path)) == [(0, "007"), (0, "10;2")]
    assert rows(S.read_post_filter(spark, path)) == [(0, "007"), (0, "10;2")]


def test_embedding_shards_are_one_table(spark, tmp_path):
    shards = tmp_path / "shards"
    shards.mkdir()
    head = "conversation_id,sentence_number,sentence_speaker,embedding_1,embedding_2\n"
    _write(shards / "e_1.csv", head + "1,1,user,0.5,NaN\n")
    _write(shards / "e_2.csv", head + "2,1,agent,1.5,\n")
    found = S.read_conversations_embedding(spark, str(shards), width=2).orderBy("conversation_id").collect()
    assert [r["embedding"] for r in found] == [[0.5, None], [1.5, None]]


def test_nan_never_survives_packing(spark):
    wide = spark.createDataFrame([(1, float("nan"), 2.0)], "conversation_id long, embedding_1 float, embedding_2 float")
    packed = S.pack_embedding(wide, 2).first()["embedding"]
    assert packed == [None, 2.0] and not any(v is not None and math.isnan(v) for v in packed)


def test_a_saved_vocabulary_encodes_like_a_fresh_one(spark, rows, tmp_path):
    schema = "purchase_event_id long, event_number int, session_id long, action_number int, action_tags string"
    actions = spark.createDataFrame([(1, 1, 1, 1, "b,a"), (2, 1, 2, 1, "c")], schema)
    fitted = FE.fit_vocabulary(actions, "action_tags", ["purchase_event_id", "session_id", "action_number"])
    state.save_state(fitted, str(tmp_path / "v"))
    loaded = state.load_state(spark, str(tmp_path / "v"))
    assert rows(FE.encode_steps(actions, "action_tags", loaded, ["session_id"])) == rows(
        FE.encode_steps(actions, "action_tags", fitted, ["session_id"])
    )


def test_staging_cuts_lineage(spark, rows):
    frame = spark.range(5).withColumn("x", F.col("id") * 2)
    staged = state.stage(frame, "lineage")
    assert rows(staged) == rows(frame)
    assert "Range" not in staged._jdf.queryExecution().toString()


def test_clustered_tables_join_without_a_shuffle(spark, tmp_path):
    for name in ("left", "right"):
        S.write_clustered(spark.range(100).withColumn(name, F.lit(1)), f"clustered_{name}", "id", 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = spark.table("clustered_left").join(spark.table("clustered_right"), "id")
        assert joined.count() == 100
        assert "hashpartitioning(id" not in joined._jdf.queryExecution().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE clustered_left")
        spark.sql("DROP TABLE clustered_right")
