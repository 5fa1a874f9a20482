"""Line deduplication by winnowing: later repeats of runs of lines are deleted.

A run is a sequence of consecutive lines of one document, counted without blank lines. A later run is
deleted if it has ``min_words`` words or more and stands somewhere earlier: in a document with a
smaller id, or further up in the same one. Only DataFrame functions are used.

1. Fingerprints. The window of a line is the shortest run from it on that has ``min_words`` words. The
   least line hash in it is its fingerprint, so equal windows select the same line: two documents that
   share a run of that many words share a fingerprint, wherever the run begins.
2. Positions. A fingerprint that is selected at one place only can't be part of a repeated run. Windows
   are kept if their fingerprint is selected at several places.
3. Extension both ways. Around those places the windows that begin at each line and the windows that
   end at each line are compared by the hash of all their lines; the first place of each content
   stays. A run of ``min_words`` words or more is the union of the windows inside it, so it is deleted
   whole, whatever its length, and no two occurrences are ever paired with each other.
4. Lines that only first places cover stay.

Texts are read twice: once for hashes of lines, once to drop the deleted lines; between the two only
hashes move. The rows of one hash meet as counts and least places, summed before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyweave.state import stage

WORD = r"[^\x20\x09-\x0D]+"
MIN_WORDS = 50
KEY = ["doc_id", "text_hash"]


def lines_of(text: str = "text") -> Column:
    """The lines of a text, split at line feeds."""
    return F.split(F.col(text), "\n", -1)


def keyed(documents: DataFrame) -> DataFrame:
    """``doc_id``, ``text_hash``, ``text``: rows that agree in the first two are one document."""
    return documents.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")


def hashed_lines(documents: DataFrame) -> DataFrame:
    """One row per line with a word: key, ``pos`` (from 0), ``h`` and ``k`` (two hashes), ``words``, ``before`` (words above), ``total``."""
    each = F.transform(
        lines_of(),
        lambda line, i: F.struct(
            i.alias("pos"), F.xxhash64(line).alias("h"), F.xxhash64(F.lit(1), line).alias("k"), F.regexp_count(line, F.lit(WORD)).alias("words")
        ),
    )
    worded = F.filter(each, lambda x: x["words"] > 0)
    once = documents.select(*KEY, worded.alias("lines")).groupBy(*KEY).agg(F.first("lines").alias("lines"))
    above = W.partitionBy(*KEY).orderBy("pos")
    rows = once.select(*KEY, F.inline("lines"))
    return rows.withColumns(
        {
            "before": F.sum(F.col("words").cast("long")).over(above) - F.col("words"),
            "total": F.sum(F.col("words").cast("long")).over(W.partitionBy(*KEY)),
            "place": F.row_number().over(above),
        }
    )


def windows(lines: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Both windows of each line: the shortest run of ``min_words`` words from it on, and up to it.

    Columns: key, ``first`` and ``last`` (positions), ``place`` (number of the first line with a word),
    ``n`` (lines with a word), ``c`` and ``d`` (hashes of the content), ``f`` (fingerprint), ``at`` (its position).
    """
    # a line belongs to the window from line i on if fewer than min_words words lie between their starts
    on = W.partitionBy(*KEY).orderBy("before").rangeBetween(0, min_words - 1)
    up = W.partitionBy(*KEY).orderBy("after").rangeBetween(0, min_words - 1)
    content = F.collect_list(F.struct("place", "pos", "h", "k"))
    long_enough = lines.where(F.col("total") >= min_words)
    placed = long_enough.withColumn("after", F.col("total") - F.col("before") - F.col("words"))
    runs = placed.select(
        *KEY,
        F.when(F.col("total") - F.col("before") >= min_words, content.over(on)).alias("begun"),
        F.when(F.col("before") + F.col("words") >= min_words, content.over(up)).alias("ended"),
    )
    both = runs.select(*KEY, F.explode(F.array("begun", F.sort_array("ended"))).alias("run")).where("run is not null")
    least = F.array_min(F.transform("run", lambda x: F.struct(x["h"].alias("h"), x["pos"].alias("pos"))))
    return both.select(
        *KEY,
        F.col("run")[0]["pos"].alias("first"),
        F.element_at("run", -1)["pos"].alias("last"),
        F.col("run")[0]["place"].alias("place"),
        F.size("run").alias("n"),
        F.xxhash64(F.transform("run", lambda x: x["h"])).alias("c"),
        F.xxhash64(F.transform("run", lambda x: x["k"])).alias("d"),
        least["h"].alias("f"),
        least["pos"].alias("at"),
    )


def deleted_runs(documents: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Key and ``deleted``: ranges of deleted lines (``first``, ``last``, from 0) in order.

    ``documents`` has ``doc_id``, ``text_hash`` and ``text``; documents that lose nothing have no row.
    """
    found = stage(windows(hashed_lines(documents), min_words), "line-windows")
    order = [F.col("doc_id").isNull().alias("without"), "doc_id", "text_hash"]
    spot, here = F.struct(*order, "at"), F.struct(*order, "place")
    selected = found.groupBy("f").agg(F.min(spot).alias("low"), F.max(spot).alias("high"))
    repeated = selected.where(F.col("low") != F.col("high")).select("f")
    candidates = found.join(repeated, "f", "left_semi").withColumn("here", here)
    firsts = candidates.groupBy("c", "d", "n").agg(F.min("here").alias("origin"), F.max("here").alias("latest"))
    firsts = firsts.where(F.col("origin") != F.col("latest")).drop("latest")
    later = candidates.join(firsts, ["c", "d", "n"]).where(F.col("here") != F.col("origin"))
    covered = later.select(*KEY, F.explode(F.sequence("first", "last")).alias("line")).distinct()
    island = F.col("line") - F.row_number().over(W.partitionBy(*KEY).orderBy("line"))
    ranges = covered.withColumn("island", island).groupBy(*KEY, "island").agg(F.min("line").alias("first"), F.max("line").alias("last"))
    return ranges.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("deleted"))


def without_repeats(documents: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``documents`` with the later repeats gone from ``text``, ``n_lines``, ``deleted`` (ranges) and ``emptied``.

    All rows and columns stay. Null texts stay null and have no line, and a text that loses nothing
    stays as it is; a blank line goes when it lies inside a deleted window. ``emptied`` is true where
    lines were deleted and none with a word is left. Ids order documents, null last; of several texts
    under one id the order is that of their hashes; rows with one id and one text are one document and
    fare alike. Columns of the new names are replaced.
    """
    plain = documents.drop("n_lines", "deleted", "emptied", "_hash")
    gone = deleted_runs(keyed(plain.where("text is not null")), min_words)
    gone = gone.select(F.col("doc_id").alias("_gone_id"), F.col("text_hash").alias("_gone_hash"), "deleted")
    same = F.col("doc_id").eqNullSafe(F.col("_gone_id")) & (F.col("_hash") == F.col("_gone_hash"))
    joined = plain.withColumn("_hash", F.xxhash64("text")).join(gone, same, "left").drop("_hash", "_gone_id", "_gone_hash")
    inside = lambda i: F.exists("deleted", lambda r: i.between(r["first"], r["last"]))
    left = F.array_join(F.filter(lines_of(), lambda line, i: ~inside(i)), "\n")
    emptied = F.col("deleted").isNotNull() & (F.regexp_count("text", F.lit(WORD)) == 0)
    counted = joined.withColumn("n_lines", F.coalesce(F.size(lines_of()), F.lit(0)))
    cleaned = counted.withColumn("text", F.when(F.col("deleted").isNull(), F.col("text")).otherwise(left))
    none = F.array().cast("array<struct<first:int,last:int>>")
    return cleaned.withColumns({"emptied": emptied, "deleted": F.coalesce("deleted", none)})
