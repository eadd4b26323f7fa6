"""Nested session records: reading, flattening, writing and validating."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trailmix.canon import DAY

RAW = "session bigint, events array<struct<aid: bigint, ts: bigint, type: string>>"


def code_of(action):
    return F.when(action == "clicks", 0).when(action == "carts", 1).when(action == "orders", 2)


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Session lines; a malformed line fails the job."""
    return spark.read.schema(RAW).option("mode", "FAILFAST").json(path)


def nested(ev: DataFrame) -> DataFrame:
    """One row per session with its ordered events."""
    action = F.when(F.col("event_type") == 0, "clicks").when(F.col("event_type") == 1, "carts").otherwise("orders")
    item = F.struct("event_index", "aid", "ts", action.alias("type"))
    rows = ev.groupBy("session").agg(F.array_sort(F.collect_list(item)).alias("events"))
    return rows.select("session", F.transform("events", lambda e: F.struct(e["aid"].alias("aid"), e["ts"].alias("ts"), e["type"].alias("type"))).alias("events"))


def to_lines(ev: DataFrame) -> DataFrame:
    return nested(ev).select(F.to_json(F.struct("session", "events")).alias("value"))


def parsed(lines: DataFrame) -> DataFrame:
    return lines.select(F.from_json("value", RAW, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def flatten(raw: DataFrame) -> DataFrame:
    """Canonical events; an unknown action fails the job."""
    rows = raw.select("session", F.posexplode("events").alias("event_index", "e"))
    kind = F.coalesce(code_of(F.col("e.type")), F.raise_error(F.concat(F.lit("unknown action "), F.col("e.type"))).cast("int"))
    return rows.select("session", "e.aid", "e.ts", kind.cast("bigint").alias("event_type"), F.col("event_index").cast("bigint").alias("event_index"))


def raw_summary(ev: DataFrame) -> DataFrame:
    before = F.lag("ts").over(Window.partitionBy("session").orderBy("event_index"))
    c = lambda e, n: F.count_if(F.expr(e)).alias(n)
    return ev.withColumn("before", before).agg(
        F.countDistinct("session").alias("sessions"), F.count("*").alias("n_events"), c("event_type = 0", "clicks"), c("event_type = 1", "carts"), c("event_type = 2", "orders"),
        F.min("ts").alias("min_ts"), F.max("ts").alias("max_ts"), c("ts < before", "time_reversals"), c("aid < 0 OR ts < 0", "bad_values"),
    )


def processed_summary(ev: DataFrame) -> DataFrame:
    w = Window.partitionBy("session").orderBy("event_index")
    rows = ev.withColumn("before", F.lag("event_index").over(w)).withColumn("ts_before", F.lag("ts").over(w))
    c = lambda e, n: F.count_if(F.expr(e)).alias(n)
    return rows.agg(
        F.count("*").alias("n_events"), F.countDistinct("session").alias("sessions"), c("before IS NULL AND event_index <> 0", "bad_starts"), c("event_index <> before + 1", "index_gaps"),
        c("ts < ts_before", "time_reversals"), F.min("ts").alias("min_ts"), F.max("ts").alias("max_ts"),
    )


def fixture(spark: SparkSession) -> DataFrame:
    """512 sessions by formula: four one-day periods of 256, 128, 64 and 64; the last two events are a cart and an order."""
    s = F.col("session")
    period = F.when(s < 256, 0).when(s < 384, 1).when(s < 448, 2).otherwise(3)
    i = s - F.when(s < 256, 0).when(s < 384, 256).when(s < 448, 384).otherwise(448)
    rows = spark.range(512).select(F.col("id").alias("session")).withColumn("p", period).withColumn("i", i).withColumn("n", 6 + F.col("i") % 5)
    rows = rows.withColumn("j", F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))))
    unseen = (F.col("p") == 3) & (F.col("i") % 11 == 0) & (F.col("j") == F.col("n") - 1)
    aid = F.when(unseen, 999).otherwise(1 + (F.col("i") * 7 + F.floor(F.col("j") / 2)) % 128)
    ts = F.lit(1_661_000_000_000) + F.col("p") * DAY + F.col("i") * 1000 + F.col("j") * 10
    kind = (F.col("j") >= F.col("n") - 2).cast("bigint") + (F.col("j") == F.col("n") - 1).cast("bigint")
    return rows.select("session", aid.cast("bigint").alias("aid"), ts.alias("ts"), kind.alias("event_type"), F.col("j").cast("bigint").alias("event_index"))
