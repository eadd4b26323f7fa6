"""Chronological corpus: roles, clipped sessions, observed prefixes, future labels and the query ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmix.canon import ACTIONS, EVALUATION_END, FIT_END, HISTORY_END, SELECTION_END, portable_hash

SEED = 42
BUDGETS = {"fit": 200, "selection": 100}
TOP = 20


def role_of(first_ts: Column) -> Column:
    return (
        F.when(first_ts < HISTORY_END, "history").when(first_ts < FIT_END, "fit").when(first_ts < SELECTION_END, "selection")
        .when(first_ts < EVALUATION_END, "evaluation").otherwise("excluded")
    )


def period_end_of(role: Column) -> Column:
    return F.when(role == "history", HISTORY_END).when(role == "fit", FIT_END).when(role == "selection", SELECTION_END).otherwise(EVALUATION_END).cast("bigint")


def objective_of(kind: Column) -> Column:
    return F.when(kind == 0, "clicks").when(kind == 1, "carts").otherwise("orders")


def session_roles(ev: DataFrame) -> DataFrame:
    rows = ev.groupBy("session").agg(F.min("ts").alias("first_ts"))
    rows = rows.withColumn("split_role", role_of(F.col("first_ts")))
    return rows.withColumn("period_end", period_end_of(F.col("split_role")))


def history(ev: DataFrame) -> DataFrame:
    return ev.where(F.col("ts") < HISTORY_END)


def eligible(ev: DataFrame) -> DataFrame:
    """Events of later roles before their period's end, with place and count after clipping. All windows share one shuffle."""
    rows = ev.withColumn("split_role", role_of(F.min("ts").over(Window.partitionBy("session"))))
    rows = rows.withColumn("period_end", period_end_of(F.col("split_role")))
    rows = rows.where(F.col("split_role").isin("fit", "selection", "evaluation") & (F.col("ts") < F.col("period_end")))
    place = Window.partitionBy("session").orderBy("event_index")
    return rows.withColumn("event_position", F.row_number().over(place).cast("bigint")).withColumn("n_events", F.count("*").over(Window.partitionBy("session")))


def query_sessions(elig: DataFrame) -> DataFrame:
    """Sessions of two events or more with the length of their observed prefix, 1 to n - 1, by hash."""
    rows = elig.where("n_events >= 2").select("session", "split_role", "period_end", "n_events").distinct()
    cut = 1 + portable_hash(F.col("session"), F.lit(SEED), F.lit("prefix")) % (F.col("n_events") - 1)
    return rows.withColumn("prefix_events", cut.cast("bigint"))


def sampled(sessions: DataFrame, budgets: dict[str, int] | None = None) -> DataFrame:
    """All evaluation sessions; of fit and selection the first of their budget by hash, or all if ``budgets`` has none. Labels play no part."""
    budgets = BUDGETS if budgets is None else budgets
    if not budgets:
        return sessions
    out = sessions.where("split_role = 'evaluation'")
    draw = portable_hash(F.col("session"), F.lit(SEED), F.lit("sample"))
    for role, budget in budgets.items():
        out = out.unionByName(sessions.where(F.col("split_role") == role).orderBy(draw, "session").limit(budget))  # every task keeps its own first ones
    return out


def query_events(ev: DataFrame, budgets: dict[str, int] | None = None) -> DataFrame:
    elig = eligible(ev)
    keys = ["session", "split_role", "period_end", "n_events"]
    return elig.join(sampled(query_sessions(elig), budgets), keys).select(*elig.columns, "prefix_events")


def observed(qev: DataFrame) -> DataFrame:
    return qev.where("event_position <= prefix_events").select("session", "aid", "ts", "event_type", "event_index", "split_role", "period_end")


def future_labels(qev: DataFrame) -> DataFrame:
    """The first future click, and every distinct future cart and order item with its earliest place."""
    rows = qev.where("event_position > prefix_events")
    turn = F.row_number().over(Window.partitionBy("session", "event_type").orderBy("event_index"))
    rows = rows.withColumn("_turn", turn).where("event_type <> 0 OR _turn = 1")
    keys = ["session", "split_role", objective_of(F.col("event_type")).alias("objective"), "aid"]
    return rows.groupBy(*keys).agg(F.min("ts").alias("label_ts"), F.min("event_index").alias("label_event_index"))


def ledger(qev: DataFrame) -> DataFrame:
    """Three rows a session, with or without labels. The objectives are three rows by definition, so they are spread by explode."""
    heads = observed(qev).groupBy("session", "split_role", "period_end").agg(
        F.min("ts").alias("first_ts"), F.max("ts").alias("query_ts"), F.max("event_index").alias("observed_last_index"), F.count("*").alias("observed_events")
    )
    heads = heads.withColumn("objective", F.explode(F.array(*[F.lit(a) for a in ACTIONS])))
    counts = future_labels(qev).groupBy("session", "objective").agg(F.count("*").alias("_n"))
    rows = heads.join(counts, ["session", "objective"], "left").withColumn("true_items", F.coalesce("_n", F.lit(0)).cast("bigint")).drop("_n")
    return rows.withColumn("recall_denominator", F.least(F.lit(TOP), "true_items").cast("bigint"))
