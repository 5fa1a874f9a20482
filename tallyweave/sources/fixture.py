"""The six target tables, derived from whole driver tables (rules in FIXTURES.md).

Each table is staged as parquet on first use and shared by all later queries of the application.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyweave.functions.positions import id_bucket, with_positions, with_running_sum
from tallyweave.state import stage

ITEMS = [str(i) for i in range(20)]
RUNS = (1, 2, 3, 4, 5)
EMBEDDING_WIDTH = 64


def by_shuffle(purchases: DataFrame) -> DataFrame:
    """Purchases that meet another table by shuffle: stored, they take a small share of their size in memory, and
    Spark, which judges by their files, would send them all through the driver."""
    return purchases.hint("merge")


class Tables:
    """Lazily staged tables of one input folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    # --- staged intermediate results -------------------------------------------------------

    @cached_property
    def _log(self) -> DataFrame:
        """Events with their tag number, day, minute and the user's earlier purchases."""
        origin = "TIMESTAMP_NTZ'2024-01-01 00:00:00'"
        ts = "CAST(ts AS TIMESTAMP_NTZ)"
        events = self._read("events").select(
            "event_id",
            "user_id",
            "event_type",
            F.expr(ts).alias("ts"),
            F.get_json_object("props", "$.k").cast("long").alias("k"),
            F.expr(f"timestampdiff(DAY, {origin}, {ts})").alias("d"),
            F.expr(f"timestampdiff(MINUTE, {origin}, {ts})").alias("minute"),
        )
        bought = F.when(F.col("event_type") == "purchase", 1).otherwise(0)
        return stage(
            with_running_sum(events, ["user_id"], F.col("minute"), ["ts", "event_id"], bought, "prior"),
            "log",
        )

    @cached_property
    def _purchases(self) -> DataFrame:
        """Purchases numbered from 0 in ``event_id`` order."""
        bought = self._log.where(F.col("event_type") == "purchase").select("event_id", "user_id", "k", "prior")
        numbered = with_positions(bought, [], id_bucket("event_id"), ["event_id"], "_rank")
        return stage(numbered.withColumn("raw", F.col("_rank") - 1).drop("_rank"), "purchases")

    @cached_property
    def _actions(self) -> DataFrame:
        """What a user did since the previous purchase, one row per action."""
        done = self._log.where(F.col("event_type") != "purchase")
        of = by_shuffle(self._purchases.select("user_id", "prior", "raw"))
        joined = done.join(of, ["user_id", "prior"]).withColumn("session_id", F.col("raw") * 100 + F.col("d"))
        numbered = with_positions(
            joined, ["session_id"], F.col("minute"), ["ts", "event_id"], "action_number"
        )
        own = F.concat(F.lit("o"), F.pmod("event_id", F.lit(1) + F.lit(20) * F.col("k")))
        section = F.concat(F.lit("s"), F.col("k") % 10)
        kind = F.concat(F.lit("t_"), F.col("event_type"))
        tags = F.when(F.col("k") % 3 == 0, own).otherwise(F.concat_ws(",", section, own, kind))
        return stage(
            numbered.select(
                "raw", "user_id", "session_id",
                F.col("action_number").cast("int").alias("action_number"),
                tags.alias("action_tags"),
            ),
            "actions",
        )

    @cached_property
    def _links(self) -> DataFrame:
        """Conversations spread evenly over purchases; every fourth one shares its neighbour's."""
        ids = self._read("conversations").select("conv_id").distinct()
        purchases = self._purchases.agg(F.count(F.lit(1))).scalar()
        conversations = ids.agg(F.count(F.lit(1))).scalar()
        c = F.col("conv_id") - F.when(F.col("conv_id") % 4 == 1, 1).otherwise(0)
        spread = ids.withColumn("_c", c).withColumn("_p", purchases).withColumn("_n", conversations)
        raw = F.expr("greatest(((2 * _c + 1) * _p) div (2 * _n) - 1, 0L)")
        linked = spread.select(F.col("conv_id").alias("conversation_id"), raw.alias("raw"))
        return linked.join(by_shuffle(self._purchases.select("raw", "user_id")), "raw")

    # --- target tables ---------------------------------------------------------------------

    @cached_property
    def _timeline(self) -> DataFrame:
        sessions = self._actions.select("raw", "user_id", "session_id").distinct().withColumn(
            "_place", F.lit(1)
        )
        conversations = self._links.withColumn(
            "_place", F.when(F.col("conversation_id") % 2 == 0, 0).otherwise(2)
        )
        rows = sessions.unionByName(conversations, allowMissingColumns=True)
        linked = with_positions(rows.select("raw").distinct(), [], id_bucket("raw"), ["raw"], "_rank")
        # one purchase has at most a row per day and a few conversations, so a plain window is bounded
        inside = Window.partitionBy("raw").orderBy("_place", F.coalesce("session_id", "conversation_id"))
        return stage(
            rows.join(linked, "raw").select(
                "raw",
                "user_id",
                (F.col("_rank") - 1).alias("purchase_event_id"),
                "conversation_id",
                "session_id",
                F.row_number().over(inside).alias("event_number"),
            ),
            "timeline",
        )

    @cached_property
    def users(self) -> DataFrame:
        return self._timeline.drop("raw")

    @cached_property
    def sessions(self) -> DataFrame:
        return self._actions.select("session_id", "action_number", "action_tags")

    @cached_property
    def conversations_keyword(self) -> DataFrame:
        """Words of at least three letters, from the whole text of a sentence."""
        words = F.filter(
            F.split(F.regexp_replace("text", "[^A-Za-z ]", ""), " "), lambda w: F.length(w) >= 3
        )
        return stage(
            self._read("conversations").select(
                F.col("conv_id").alias("conversation_id"),
                F.col("turn").cast("int").alias("sentence_number"),
                F.when(F.col("role") == "user", "user").otherwise("agent").alias("sentence_speaker"),
                F.array_join(words, ",").alias("keywords"),
            ),
            "keywords",
        )

    @cached_property
    def conversations_embedding(self) -> DataFrame:
        vectors = self._read("embeddings").select("vec_id", "embedding")
        total = vectors.agg(F.count(F.lit(1))).scalar()
        turns = self._read("conversations").select("conv_id", "turn", "role").withColumn(
            "vec_id", F.pmod(F.col("conv_id") * 31 + F.col("turn") * 7, total)
        )
        return stage(
            turns.join(vectors, "vec_id").select(
                F.col("conv_id").alias("conversation_id"),
                F.col("turn").cast("int").alias("sentence_number"),
                F.when(F.col("role") == "user", "user").otherwise("agent").alias("sentence_speaker"),
                "embedding",
            ),
            "embeddings",
        )

    @cached_property
    def purchase_events(self) -> DataFrame:
        events = self._timeline.select("raw", "purchase_event_id").distinct()
        second = F.when(F.col("event_id") % 3 == 0, F.col("event_id") % 20)
        items = F.array_distinct(F.array_compact(F.array(F.col("k") % 20, second)))
        return stage(
            by_shuffle(self._purchases).join(events, "raw").select(
                "purchase_event_id", F.explode(items.cast("array<string>")).alias("item_id")
            ),
            "bought",
        )

    @cached_property
    def post_filter(self) -> DataFrame:
        """Items on sale at a purchase: each rests for every fourth event, unless it was bought then."""
        resting = (F.col("item_id").cast("long") + F.col("purchase_event_id")) % 4 == 0
        on_sale = self.events.select(
            "purchase_event_id", F.explode(F.lit(ITEMS)).alias("item_id")
        ).where(~resting)
        return stage(on_sale.unionByName(self.purchase_events.where(resting)), "on_sale")

    @cached_property
    def events(self) -> DataFrame:
        return stage(self.users.select("purchase_event_id").distinct(), "event_ids")

    def scores(self, model: int = 0, runs: tuple[int, ...] = RUNS) -> DataFrame:
        """Stand-in scores with ties by design, one per run, event and item, for model number ``model``."""
        rows = self.events.select(
            "purchase_event_id", F.explode(F.lit(list(runs))).alias("run")
        ).select("run", "purchase_event_id", F.explode(F.lit(ITEMS)).alias("item_id"))
        value = (
            F.col("purchase_event_id") * 31 + F.col("item_id").cast("long") * 17 + F.col("run") * 7 + 13 * model
        ) % 101 / F.lit(100.0)
        return rows.withColumn("score", value)


_TABLES: dict[tuple[str, str], Tables] = {}


def tables(spark: SparkSession, folder: str) -> Tables:
    """The staged tables of ``folder`` for the running application."""
    key = (spark.sparkContext.applicationId, folder.rstrip("/"))
    if key not in _TABLES:
        _TABLES[key] = Tables(spark, folder)
    return _TABLES[key]
