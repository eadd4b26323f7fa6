"""Input tables as the canonical event table: session, aid, ts (ms), event_type (0 click, 1 cart, 2 order), event_index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EPOCH = 1_704_067_200_000
DAY = 86_400_000
SESSION_SPAN = 3 * DAY
#: Role boundaries; amid sessions, so that history is truncated and periods are clipped.
HISTORY_END = EPOCH + 35 * DAY // 2
FIT_END = EPOCH + 23 * DAY
SELECTION_END = EPOCH + 26 * DAY
EVALUATION_END = EPOCH + 59 * DAY // 2
ACTIONS = ("clicks", "carts", "orders")
SCHEMA = "session bigint, aid bigint, ts bigint, event_type bigint, event_index bigint"


def raw_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actions of the events table in milliseconds; errors are no actions."""
    kind = F.when(F.col("event_type") == "purchase", 2).when(F.col("event_type") == "signup", 1).otherwise(0)
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").where("event_type <> 'error'")
    return rows.select(
        "event_id", "user_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ts"), kind.cast("bigint").alias("event_type"),
        F.get_json_object("props", "$.k").cast("bigint").alias("aid"),
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The canonical table; a session is a user's three-day span. One shuffle, on the session."""
    session = F.col("user_id") * 1000 + F.floor((F.col("ts") - EPOCH) / SESSION_SPAN)
    rows = raw_actions(spark, sf_dir).withColumn("session", session.cast("bigint"))
    order = Window.partitionBy("session").orderBy("ts", "event_id")
    return rows.select("session", "aid", "ts", "event_type", (F.row_number().over(order) - 1).cast("bigint").alias("event_index"))


def portable_hash(*parts: Column) -> Column:
    """48 bits of an MD5, the same in any engine."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, 12), 16, 10).cast("bigint")
