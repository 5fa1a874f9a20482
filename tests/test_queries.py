"""Every registered query with SQL equals DuckDB on the same tables; the others return whole rows."""

import os

import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables not present")
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    yield connection
    connection.close()


def _key(row):
    return tuple((v is not None, v) for v in row)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    cursor = duck.execute(ORACLES[name])
    columns = [c[0] for c in cursor.description]
    expected = sorted((tuple(dict(zip(columns, r))[c] for c in sorted(columns)) for r in cursor.fetchall()), key=_key)
    result = QUERIES[name](spark, FOLDER)
    assert sorted(result.columns) == sorted(columns)
    found = sorted((tuple(r[c] for c in sorted(columns)) for r in result.collect()), key=_key)
    assert found == expected


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", ["score_session", "score_joint", "score_relative", "score_generated"])
def test_scores_cover_what_is_on_sale(spark, name):
    from tallyweave.plans.workbench import workbench

    scores = QUERIES[name](spark, FOLDER)
    w = workbench(spark, FOLDER)
    wanted = w.events("test")
    if name == "score_session":
        wanted = w.types("test").where("event <> 'conversation'")
    known = w.labels("train").select("item_id").distinct()
    keys = ["purchase_event_id", "item_id"]
    pairs = w.available("test").select(*keys).distinct().join(wanted, "purchase_event_id", "left_semi").join(known, "item_id")
    assert scores.select(*keys).exceptAll(pairs.select(*keys)).count() == 0
    assert pairs.select(*keys).exceptAll(scores.select(*keys)).count() == 0
    assert scores.where("score < 0 or score > 1 or score is null").count() == 0


def test_sparse_scores_rank_like_dense_ones(spark, rows):
    from tallyweave.operators.labels import masked_scores
    from tallyweave.operators import ridge
    from tallyweave.operators.ranking import topk_items
    from tallyweave.plans import scorers
    from tallyweave.plans.workbench import workbench

    w = workbench(spark, FOLDER)
    vectors = scorers.session_vectors(w, "test")
    known = w.labels("train").select("item_id").distinct()
    pairs = vectors.select("purchase_event_id").crossJoin(known)
    dense = masked_scores(ridge.score(scorers._model(w, scorers.session_vectors), vectors, pairs, (1,)), w.available("test"))
    sparse = scorers.best_items(w, scorers.score_session(w), vectors.select("purchase_event_id"), 5)
    columns = ("run", "purchase_event_id", "item_id", "rank")
    assert rows(sparse, *columns) == rows(topk_items(dense, 5), *columns)


def test_shuffled_sequences_hold_the_same_steps(spark):
    shuffled = QUERIES["shuffled_sequences"](spark, FOLDER)
    ordered = QUERIES["padded_sequences"](spark, FOLDER)
    keys = ["purchase_event_id", "feature", "n_steps"]
    assert shuffled.select(*keys).exceptAll(ordered.select(*keys)).count() == 0
    assert ordered.select(*keys).exceptAll(shuffled.select(*keys)).count() == 0


def test_entry_reports_all_events(spark):
    report = {r["event"]: r for r in entry.entry(spark).collect()}
    assert report["union"]["n_events"] == sum(r["n_events"] for e, r in report.items() if e != "union")
