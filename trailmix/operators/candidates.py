"""Candidates of an observed prefix: five sources, ranks, rank fusion, budgets, targets and sampled training rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmix.canon import portable_hash
from trailmix.operators.graph import UNIT

SEEDS, BUDGET, TOP = 50, 30, 20
#: No budget is larger.
MOST = 400
SOURCES = ("time", "cart", "order", "revisit", "popular")
FUSION = (0.4, 0.3, 0.6, 1.0, 0.01)
POPULAR_WEIGHTS = {"clicks": 0.1, "carts": 0.3, "orders": 0.6}
#: Weights of the sources per objective.
OBJECTIVES = {"clicks": (1.0, 0.1, 0.1, 1.0, 0.01), "carts": (0.3, 1.0, 0.3, 1.0, 0.01), "orders": (0.2, 0.5, 1.0, 1.0, 0.01)}
FUSED = 1e12


def prefixes(observed: DataFrame) -> DataFrame:
    """Observed events with ``pos``, 1 for the most recent."""
    return observed.withColumn("pos", F.row_number().over(Window.partitionBy("session").orderBy(F.desc("event_index"))).cast("bigint"))


def _rooted(value: Column) -> Column:
    return F.round(value.cast("double") / F.sqrt(F.col("pos").cast("double"))).cast("bigint")


def seed_edges(prefix: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges from the SEEDS most recent events. At most SEEDS * neighbours rows a session; AQE broadcasts the graph if it is small."""
    seeds = prefix.where(F.col("pos") <= SEEDS).select("session", F.col("aid").alias("source_aid"), "pos", "ts")
    return seeds.join(edges, "source_aid").withColumnRenamed("target_aid", "aid")


def discovery(prefix: DataFrame, edges: DataFrame, popular: DataFrame) -> DataFrame:
    """(session, aid) of every candidate: own items, the popular lists, neighbours of seeds."""
    lists = popular.select("aid").distinct()  # three bounded lists
    everyone = prefix.select("session").distinct().join(F.broadcast(lists))
    return prefix.select("session", "aid").union(everyone).union(seed_edges(prefix, edges).select("session", "aid")).distinct()


def source_scores(prefix: DataFrame, edges: DataFrame, popular: DataFrame) -> DataFrame:
    """(session, aid) with the integer score of each source, 0 where it has none: contributions are unioned and summed once."""
    zero = F.lit(0).cast("bigint")
    graph = seed_edges(prefix, edges).select("session", "aid", *[_rooted(F.col(f"{c}_w")).alias(f"{c}_s") for c in ("time", "cart", "order")], zero.alias("revisit_s"), zero.alias("popular_s"))
    own = prefix.select("session", "aid", *[zero.alias(f"{c}_s") for c in ("time", "cart", "order")], _rooted(F.lit(UNIT)).alias("revisit_s"), zero.alias("popular_s"))
    share = F.when(F.col("action") == "clicks", 0.1).when(F.col("action") == "carts", 0.3).otherwise(0.6)
    lists = popular.groupBy("aid").agg(F.sum(F.round(share * float(UNIT) / F.col("list_rank")).cast("bigint")).alias("popular_s"))
    everyone = prefix.select("session").distinct().join(F.broadcast(lists)).select("session", "aid", *[zero.alias(f"{c}_s") for c in SOURCES[:4]], "popular_s")
    return graph.unionByName(own).unionByName(everyone).groupBy("session", "aid").agg(*[F.sum(f"{c}_s").alias(f"{c}_s") for c in SOURCES])


def source_ranks(scores: DataFrame) -> DataFrame:
    """Ranks among positive scores, ties by item; 0 stands for none. One shuffle for all five."""
    out = scores
    for c in SOURCES:
        rank = F.row_number().over(Window.partitionBy("session").orderBy(F.desc(f"{c}_s"), "aid"))
        out = out.withColumn(f"{c}_r", F.when(F.col(f"{c}_s") > 0, rank).otherwise(0).cast("bigint"))
    return out


def fused(weights: tuple[float, ...]) -> Column:
    """Reciprocal ranks, weighted and summed in fixed point."""
    parts = [F.when(F.col(f"{c}_r") > 0, F.round(F.lit(w * FUSED) / (20 + F.col(f"{c}_r"))).cast("bigint")).otherwise(F.lit(0).cast("bigint")) for c, w in zip(SOURCES, weights, strict=True)]
    return reduce(lambda a, b: a + b, parts)


def selected(ranks: DataFrame, prefix: DataFrame, budget: int = BUDGET) -> DataFrame:
    """Revisited items, most recent first, then others by fusion; cut at the budget. Smaller budgets are prefixes of larger ones."""
    if not 1 <= budget <= MOST:
        raise ValueError(f"a candidate budget lies between 1 and {MOST}")
    last = prefix.groupBy("session", "aid").agg(F.min("pos").alias("last_pos"))
    rows = ranks.withColumn("fusion", fused(FUSION)).join(last, ["session", "aid"], "left")
    order = Window.partitionBy("session").orderBy(F.asc_nulls_last("last_pos"), F.desc("fusion"), "aid")
    return rows.withColumn("candidate_position", F.row_number().over(order).cast("bigint")).where(F.col("candidate_position") <= budget)


def by_objective(candidates: DataFrame, top: int = TOP) -> DataFrame:
    """Top items per session and objective by the objective's own weights."""
    scores = F.explode(F.array(*[F.struct(F.lit(o).alias("objective"), fused(w).alias("score")) for o, w in OBJECTIVES.items()]))
    rows = candidates.select("session", "aid", "candidate_position", scores.alias("x")).select("session", "aid", "candidate_position", "x.*")
    order = Window.partitionBy("session", "objective").orderBy(F.desc("score"), "aid")
    return rows.withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= top)


def with_targets(candidates: DataFrame, labels: DataFrame) -> DataFrame:
    """0/1 membership of each candidate in the labels of each objective."""
    wide = labels.groupBy("session", "aid").agg(*[F.max((F.col("objective") == o).cast("bigint")).alias(f"target_{o}") for o in OBJECTIVES])
    rows = candidates.join(wide, ["session", "aid"], "left")
    return rows.withColumns({f"target_{o}": F.coalesce(f"target_{o}", F.lit(0).cast("bigint")) for o in OBJECTIVES})


def training_sample(targets: DataFrame, budget: int = 10, seed: int = 7) -> DataFrame:
    """All positives, the first half of the budget of negatives in candidate order, the rest of it by hash."""
    positive = reduce(lambda a, b: a | b, [F.col(f"target_{o}") > 0 for o in OBJECTIVES])
    rows = targets.withColumn("positive", positive.cast("bigint"))
    hard = budget // 2
    order = Window.partitionBy("session", "positive").orderBy("candidate_position")
    rows = rows.withColumn("_place", F.row_number().over(order))
    draw = portable_hash(F.col("session"), F.col("aid"), F.col("candidate_position"), F.lit(seed))
    chance = Window.partitionBy("session", "positive", (F.col("_place") <= hard)).orderBy(draw, "candidate_position")
    rows = rows.withColumn("_draw", F.row_number().over(chance))
    return rows.where((F.col("positive") == 1) | (F.col("_place") <= hard) | (F.col("_draw") <= budget - hard)).drop("_place", "_draw")
