"""One query per operator: the operator over its whole table with production parameters, then its columns."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.llm import (
    byte_bpe,
    embedding_dedup,
    line_dedup,
    oracles,
    packing,
    periodic_runs,
    prefix_trie,
    quality_classifier,
    quality_rules,
    rotated_codes,
    secret_scan,
    simhash,
    toxicity,
    url_filter,
)
from tallyweave.llm.common import fold, table

BYTE_BPE = "byte_bpe_multi_50k.tiktoken"
WORD_BPE = "word_bpe_49k.json"
WORD_BPE_END = 2


GOOD = 0.7


def op1_quality(spark: SparkSession, folder: str) -> DataFrame:
    documents, held_out = table(spark, folder, "documents"), fold("doc_id", 4) == 2
    model = quality_classifier.fit(documents, table(spark, folder, "labels"), "quality", ~held_out)
    return quality_classifier.scored(documents.select("doc_id", "text"), model).select(
        "doc_id",
        F.coalesce(held_out, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= GOOD).cast("int").alias("predicted"),
    )


RULES = [
    url_filter.Rule("allow", "org/"),
    url_filter.Rule("block", "example.org/es/"),
    url_filter.Rule("block", "example.org/en/1"),
    url_filter.Rule("allow", "com/fr/"),
    url_filter.Rule("block", "com/de/"),
]


def op2_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return url_filter.judged(table(spark, folder, "pages"), RULES)


def op3_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    documents, held_out = table(spark, folder, "documents"), fold("doc_id", 5) == 0
    model = toxicity.fit(documents, table(spark, folder, "labels"), "toxic", ~held_out)
    return toxicity.scored(documents, model).select(
        "doc_id",
        F.coalesce(held_out, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op4_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    return byte_bpe.round_trip(documents, public_tokenizers.path(BYTE_BPE), public_tokenizers.PATTERN)


def word_bpe() -> str:
    with open(public_tokenizers.path(WORD_BPE), encoding="utf-8") as file:
        return file.read()


def op5_secrets(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    return secret_scan.scanned(documents, secret_scan.fit(documents))


def op6_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Ranges of deleted lines, and a digest of what is left of each text."""
    done = line_dedup.without_repeats(table(spark, folder, "documents"))
    size = F.aggregate("deleted", F.lit(0), lambda n, r: n + r["last"] - r["first"] + 1)
    ranges = F.array_join(F.transform("deleted", lambda r: F.concat_ws("-", r["first"], r["last"])), ",")
    return done.select(
        "doc_id",
        F.col("n_lines").cast("long").alias("n_lines"),
        size.cast("long").alias("n_deleted"),
        ranges.alias("deleted"),
        F.md5("text").alias("kept_md5"),
    )


def op7_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, folder, "documents"), radius=2, words=3, seed=42)
    return found.select("doc_id", simhash.as_hex("fp").alias("fingerprint"), "component_id")


def op8_embedding_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, folder, "embeddings"), threshold=0.98)


def op9_packing(spark: SparkSession, folder: str) -> DataFrame:
    limits = packing.Limits()
    cut = packing.pieces(table(spark, folder, "documents"), word_bpe(), ["doc_id"], WORD_BPE_END, limits)
    return packing.pack(cut, limits)


def op10_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.judged(table(spark, folder, "documents")).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
        "log_perplexity",
    )


def op11_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie.trie(prefix_trie.branched(prefix_trie.turns(table(spark, folder, "conversations"))))


def op12_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    found = periodic_runs.scanned(table(spark, folder, "documents"), periodic_runs.looped)
    exponent = F.expr("(1000 * length) div period").alias("exponent_milli")
    return found.select("doc_id", "n_runs", "start", "length", "period", exponent, "runs_sha256", "collapsed_sha256")


def op13_nearest(spark: SparkSession, folder: str) -> DataFrame:
    return rotated_codes.nearest(table(spark, folder, "embeddings"), F.pmod("vec_id", F.lit(100)) == 0, 10)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_quality, op2_url_filter, op3_toxicity, op4_byte_bpe, op5_secrets, op6_line_dedup, op7_simhash, op8_embedding_dedup, op9_packing, op10_quality_rules]
    found += [op11_prefix_trie, op12_periodic_runs, op13_nearest]
    return {query.__name__: query for query in found}


def oracle_sql() -> dict[str, str]:
    return oracles.oracle_sql()
