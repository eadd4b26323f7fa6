"""Ranking metrics: pooled recall and its variants, NDCG, MRR, ceilings, slices, shortfalls and bootstrap intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmix.canon import portable_hash

K = 20
WEIGHTS = {"clicks": 0.1, "carts": 0.3, "orders": 0.6}


def weight_of(objective: Column) -> Column:
    return F.when(objective == "clicks", 0.1).when(objective == "carts", 0.3).otherwise(0.6)


def hits(recommended: DataFrame, labels: DataFrame, ledger: DataFrame) -> DataFrame:
    """Per session and objective: hits, ndcg, mrr, hit rate, eligibility. Sessions without recommendations or labels stay, with zeros."""
    met = recommended.join(labels.select("session", "objective", "aid"), ["session", "objective", "aid"])
    gained = met.groupBy("session", "objective").agg(F.count("*").alias("hits"), F.sum(1.0 / F.log2(F.col("rank") + 1.0)).alias("_dcg"), F.max(1.0 / F.col("rank")).alias("mrr"))
    rows = ledger.select("session", "split_role", "objective", "observed_events", "true_items", "recall_denominator").join(gained, ["session", "objective"], "left")
    ideal = F.aggregate(F.sequence(F.lit(1), F.col("recall_denominator")), F.lit(0.0), lambda acc, i: acc + 1.0 / F.log2(i + 1.0))
    some = F.col("recall_denominator") > 0
    return rows.select(
        "session", "split_role", "objective", "observed_events", "true_items", "recall_denominator", F.coalesce("hits", F.lit(0)).cast("bigint").alias("hits"),
        F.when(some, F.coalesce("_dcg", F.lit(0.0)) / ideal).otherwise(0.0).alias("ndcg"), F.coalesce("mrr", F.lit(0.0)).alias("mrr"),
        F.coalesce((F.col("hits") > 0).cast("bigint"), F.lit(0)).cast("bigint").alias("hit_rate"), some.cast("bigint").alias("eligible"),
    )


def pooled(rows: DataFrame, *keys: str) -> DataFrame:
    """Hits over denominators, pooled per objective. A zero denominator has no recall."""
    sums = rows.groupBy(*keys, "objective").agg(F.sum("hits").alias("hits"), F.sum("recall_denominator").alias("denominator"))
    return sums.withColumn("recall", F.when(F.col("denominator") > 0, F.col("hits") / F.col("denominator")))


def weighted(recalls: DataFrame, *keys: str) -> DataFrame:
    """Weighted sum over the three objectives; null unless all are defined."""
    complete = F.count("recall") == 3
    return recalls.groupBy(*keys).agg(F.when(complete, F.sum(weight_of(F.col("objective")) * F.col("recall"))).alias("score"))


def official(rows: DataFrame) -> DataFrame:
    """One row, ``score``: weighted pooled recall. A missing objective, a zero denominator or more hits than the denominator fails the job."""
    sums = pooled(rows).agg(
        F.count_if(F.col("denominator") > 0).alias("defined"), F.count_if(F.col("hits") > F.col("denominator")).alias("beyond"),
        F.sum(weight_of(F.col("objective")) * F.col("recall")).alias("score"),
    )
    fault = lambda text: F.raise_error(F.lit(text)).cast("double")
    score = F.when(F.col("defined") != len(WEIGHTS), fault("every objective needs a positive denominator")).when(F.col("beyond") > 0, fault("more hits than the denominator"))
    return sums.select(score.otherwise(F.col("score")).alias("score"))


def bucket(events: Column) -> Column:
    return F.when(events == 1, "1").when(events <= 5, "2-5").when(events <= 20, "6-20").otherwise("21+")


def recall_at_k(ranked: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """Cut to k, then drop duplicates (they waste places); the denominator is min(k, labels). Lists are (session, rank, aid)."""
    got = ranked.where(F.col("rank") <= k).select("session", "aid").distinct().join(truth.select("session", "aid").distinct(), ["session", "aid"])
    n = truth.groupBy("session").agg(F.least(F.lit(k), F.countDistinct("aid")).cast("bigint").alias("denominator"))
    rows = n.join(got.groupBy("session").agg(F.count("*").alias("hits")), "session", "left")
    return rows.select("session", F.coalesce("hits", F.lit(0)).cast("bigint").alias("hits"), "denominator")


def ceiling_at_k(ranked: DataFrame, truth: DataFrame, k: int, cap: int = K) -> DataFrame:
    """Drop duplicates, then cut to k; numerator and denominator are capped at ``cap`` whatever k is."""
    first = ranked.groupBy("session", "aid").agg(F.min("rank").alias("rank"))
    place = F.row_number().over(Window.partitionBy("session").orderBy("rank", "aid"))
    kept = first.withColumn("_place", place).where(F.col("_place") <= k)
    got = kept.join(truth.select("session", "aid").distinct(), ["session", "aid"]).groupBy("session").agg(F.count("*").alias("_n"))
    n = truth.groupBy("session").agg(F.least(F.lit(cap), F.countDistinct("aid")).cast("bigint").alias("denominator"))
    return n.join(got, "session", "left").select("session", F.least(F.lit(cap), F.coalesce("_n", F.lit(0))).cast("bigint").alias("hits"), "denominator")


#: Cumulative Poisson(1) probabilities of 0, 1, 2, ... in millionths.
POISSON = (367_879, 735_759, 919_699, 981_012, 996_340, 999_406, 999_917, 999_990)


def poisson_weight(draw: Column) -> Column:
    """A Poisson(1) count from a uniform hash."""
    u = draw % 1_000_000
    out = F.lit(len(POISSON))
    for n in reversed(range(len(POISSON))):
        out = F.when(u < POISSON[n], n).otherwise(out)
    return out.cast("bigint")


def poisson_replicates(rows: DataFrame, replicates: int, seed: int) -> DataFrame:
    """Pooled recall of each replicate; base, second list and denominator of a session share its weight. Pre-aggregates before the shuffle."""
    drawn = rows.withColumn("replicate", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(replicates - 1).cast("bigint"))))
    w = poisson_weight(portable_hash(F.col("session"), F.col("replicate"), F.lit(seed)))
    drawn = drawn.withColumn("_w", w)
    return drawn.groupBy("replicate").agg(F.sum(F.col("_w") * F.col("base_hits")).alias("base"), F.sum(F.col("_w") * F.col("second_hits")).alias("second"), F.sum(F.col("_w") * F.col("denominator")).alias("denominator"))
