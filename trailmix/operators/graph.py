"""Item statistics and the co-visitation graph, from history alone. Scores are fixed-point integers, so sums are exact in any order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmix.canon import HISTORY_END

HOUR = 3_600_000
HORIZONS = (1, 6, 12, 24, 72, 168, 336)
TAIL, POSITIONS, SPAN, NEIGHBOURS, POPULAR = 30, 3, 24 * HOUR, 10, 20
UNIT = 1_000_000_000
#: Multipliers by the target's action (click, cart, order), in twentieths.
CART, ORDER = (2, 60, 30), (1, 40, 80)
CHANNELS = ("time", "cart", "order")


def item_statistics(hist: DataFrame) -> DataFrame:
    """First and last time and 32 counts per item, in one aggregation."""
    aggs = [F.min("ts").alias("history_first_ts"), F.max("ts").alias("history_last_ts")]
    for name, kind in (("all", None), ("clicks", 0), ("carts", 1), ("orders", 2)):
        of = F.lit(True) if kind is None else F.col("event_type") == kind
        aggs.append(F.count_if(of).alias(f"hist_{name}_all"))
        aggs += [F.count_if(of & (F.col("ts") >= HISTORY_END - h * HOUR)).alias(f"hist_{name}_h{h}") for h in HORIZONS]
    return hist.groupBy("aid").agg(*aggs)


def tail(hist: DataFrame, size: int = TAIL) -> DataFrame:
    """The last events of each session by index, without a sort: indices are contiguous from 0."""
    last = F.max("event_index").over(Window.partitionBy("session"))
    return hist.withColumn("_last", last).where(F.col("event_index") > F.col("_last") - size).drop("_last")


def by_action(kind: Column, factors: tuple[int, int, int]) -> Column:
    return F.when(kind == 0, factors[0]).when(kind == 1, factors[1]).otherwise(factors[2]).cast("bigint")


def weight(gap: Column, steps: Column) -> Column:
    value = F.exp(-F.abs(gap) / F.lit(21_600_000.0)) / F.sqrt(F.abs(steps).cast("double"))
    return F.round(value * F.lit(float(UNIT))).cast("bigint")


def pairs(events: DataFrame) -> DataFrame:
    """Ordered pairs of different items within POSITIONS steps and SPAN of a session.

    Written with ``lead`` over the session's own order: at most POSITIONS rows an event, both directions, and no
    join, so a very long session costs no more than its length.
    """
    order = Window.partitionBy("session").orderBy("event_index")
    steps = [F.struct(F.lit(k).alias("step"), *[F.lead(c, k).over(order).alias(c) for c in ("aid", "ts", "event_type", "event_index")]) for k in range(1, POSITIONS + 1)]
    rows = events.withColumn("_next", F.array(*steps)).withColumn("n", F.explode("_next"))
    gap, apart = F.col("n.ts") - F.col("ts"), F.col("n.event_index") - F.col("event_index")
    rows = rows.where(F.col("n.aid").isNotNull() & (F.col("n.aid") != F.col("aid")) & (F.abs(gap) <= SPAN) & (apart <= POSITIONS))
    w = weight(gap, apart)
    both = F.explode(F.array(
        F.struct(F.col("aid").alias("source_aid"), F.col("n.aid").alias("target_aid"), F.col("n.event_type").alias("target_type")),
        F.struct(F.col("n.aid").alias("source_aid"), F.col("aid").alias("target_aid"), F.col("event_type").alias("target_type")),
    ))
    return rows.select("session", w.alias("w"), both.alias("p")).select("session", "p.*", "w")


def pairs_by_join(events: DataFrame) -> DataFrame:
    """The same pairs by a self-join on the session with a band predicate."""
    a, b = events.alias("a"), events.alias("b")
    gap, apart = F.col("b.ts") - F.col("a.ts"), F.col("b.event_index") - F.col("a.event_index")
    rows = a.join(b, F.col("a.session") == F.col("b.session")).where((F.abs(apart) >= 1) & (F.abs(apart) <= POSITIONS) & (F.abs(gap) <= SPAN) & (F.col("a.aid") != F.col("b.aid")))
    return rows.select(F.col("a.session"), F.col("a.aid").alias("source_aid"), F.col("b.aid").alias("target_aid"), F.col("b.event_type").alias("target_type"), weight(gap, apart).alias("w"))


def unique_pairs(rows: DataFrame) -> DataFrame:
    """The best weight of each directed pair in each session, per channel."""
    kind, w = F.col("target_type"), F.col("w")
    return rows.groupBy("session", "source_aid", "target_aid").agg(
        F.max(w).alias("time_w"), F.max(w * by_action(kind, CART)).alias("cart_w"), F.max(w * by_action(kind, ORDER)).alias("order_w")
    )


def totals(unique: DataFrame) -> DataFrame:
    return unique.groupBy("source_aid", "target_aid").agg(*[F.sum(f"{c}_w").alias(f"{c}_w") for c in CHANNELS])


def pruned(edges: DataFrame, k: int = NEIGHBOURS) -> DataFrame:
    """Edges in the top k of any channel of their source. Each channel is ranked on its own, so that tasks drop all but k edges of a hub before the shuffle."""
    out = None
    for c in CHANNELS:
        order = Window.partitionBy("source_aid").orderBy(F.desc(f"{c}_w"), "target_aid")
        one = edges.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= k).drop("_rank")
        out = one if out is None else out.unionByName(one)
    return out.distinct()


def covisit(hist: DataFrame) -> DataFrame:
    return pruned(totals(unique_pairs(pairs(tail(hist)))))


def scaled(edges: DataFrame) -> DataFrame:
    """Scores as floating-point numbers, only at the edge."""
    return edges.select(
        "source_aid", "target_aid", (F.col("time_w") / F.lit(float(UNIT))).alias("time_score"),
        (F.col("cart_w") / F.lit(20.0 * UNIT)).alias("cart_score"), (F.col("order_w") / F.lit(20.0 * UNIT)).alias("order_score"),
    )


def popular(stats: DataFrame, k: int = POPULAR) -> DataFrame:
    """Per action the items most counted in the last day of history; ranks only over those with a count."""
    named = F.explode(F.array(*[F.struct(F.lit(a).alias("action"), F.col(f"hist_{a}_h24").alias("n")) for a in ("clicks", "carts", "orders")]))
    rows = stats.select("aid", named.alias("x")).select("aid", "x.*").where("n > 0")
    order = Window.partitionBy("action").orderBy(F.desc("n"), "aid")
    return rows.withColumn("list_rank", F.row_number().over(order).cast("bigint")).where(F.col("list_rank") <= k)
