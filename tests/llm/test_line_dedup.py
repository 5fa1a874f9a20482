"""Line deduplication against brute force on odd rows; the query's SQL is compared in the query tests."""

import random

import pytest
from pyspark.sql import functions as F

from tallyweave.llm import line_dedup


def words_in(line):
    return len([w for w in __import__("re").split(r"[\x20\x09-\x0D]+", line) if w])


def plain(documents, least):
    """Of each (doc_id, text), in the order of documents, the deleted places of lines."""
    sequences = []
    for doc, text in documents:
        lines = [(i, line, words_in(line)) for i, line in enumerate(text.split("\n")) if words_in(line)]
        sequences.append((doc, text, lines))
    seen, gone = {}, {}
    for d, (doc, text, lines) in enumerate(sequences):
        for a in range(len(lines)):
            total = 0
            for b in range(a, len(lines)):
                total += lines[b][2]
                if total >= least:
                    content = tuple(line for _, line, _ in lines[a : b + 1])
                    first = seen.setdefault(content, (d, a))
                    if first != (d, a):
                        gone.setdefault((doc, text), set()).update(i for i, _, _ in lines[a : b + 1])
    return gone


def covered(result):
    return {(r["doc_id"], r["was"]): {i for x in r["deleted"] for i in range(x["first"], x["last"] + 1)} for r in result if r["deleted"]}


@pytest.mark.parametrize("seed,least", [(1, 6), (2, 10), (3, 3)])
def test_equals_all_runs(spark, seed, least):
    draw = random.Random(seed)
    pool = [" ".join(draw.choices("abcdef", k=draw.randint(1, 5))) for _ in range(12)] + ["", "  "]
    documents = [(i, "\n".join(draw.choices(pool, k=draw.randint(0, 14)))) for i in range(40)]
    documents += [(100 + i, documents[3][1] + "\n" + documents[5][1]) for i in range(6)]
    frame = spark.createDataFrame(documents, "doc_id long, text string").withColumn("was", F.col("text"))
    result = line_dedup.without_repeats(frame, least).collect()
    expected = plain(documents, least)
    found = covered(result)
    worded = {k: {i for i in v if words_in(k[1].split("\n")[i])} for k, v in found.items()}
    assert worded == expected
    for r in result:
        lines = r["was"].split("\n")
        kept = [line for i, line in enumerate(lines) if i not in found.get((r["doc_id"], r["was"]), ())]
        assert r["text"] == ("\n".join(kept) if (r["doc_id"], r["was"]) in expected else r["was"])
        assert r["n_lines"] == len(lines)
        assert r["emptied"] == ((r["doc_id"], r["was"]) in expected and not any(words_in(k) for k in kept))


def test_odd_rows(spark):
    passage = " ".join(f"w{i}" for i in range(60))
    data = [
        (2, f"one\n{passage}\ntwo"), (1, f"start\n{passage}"), (1, f"start\n{passage}"), (None, passage), (None, passage),
        (4, None), (5, ""), (6, "short line\nshort line"), (7, f"{passage}\n\n{passage}"), (8, passage), (9, "long " * 200_000),
    ]
    frame = spark.createDataFrame([(*r, "clash") for r in data], "doc_id long, text string, deleted string")
    result = line_dedup.without_repeats(frame).collect()
    assert len(result) == len(data)
    texts = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"]) for r in result if r["doc_id"] != 4)
    assert texts == [
        (False, 1, f"start\n{passage}"), (False, 1, f"start\n{passage}"), (False, 2, "one\ntwo"), (False, 5, ""),
        (False, 6, "short line\nshort line"), (False, 7, ""), (False, 8, ""), (False, 9, "long " * 200_000), (True, 0, ""), (True, 0, ""),
    ]
    assert {r["doc_id"] for r in result if r["emptied"]} == {7, 8, None}
    assert line_dedup.without_repeats(frame.limit(0)).count() == 0


def test_main_path_is_native(spark):
    frame = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    plan = line_dedup.without_repeats(frame)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
