"""A co-occurrence model: symmetric session pairs, popularity by action, and explained recommendations for each objective."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmix.canon import ACTIONS

SCALE = 1_000_000
POOL, TOP = 50, 20
#: Shares of association, recency and popularity in a score.
PARTS = (0.6, 0.3, 0.1)
SOURCES = ("session co-occurrence", "observed prefix", "historical popularity")


#: Items of a session that meet those of another block in one task.
BLOCK = 256


def cooccurrence(hist: DataFrame, block: int = BLOCK) -> DataFrame:
    """(item, other, n): sessions that hold both items, a pair once a session. The rows are as many as the pairs of different items of sessions.

    Items of a session are numbered and meet by blocks of ``block``: a session of very many items is spread over as many keys as it has pairs of
    blocks, so that none has more than ``block`` squared rows.
    """
    items = hist.select("session", "aid").distinct()
    own = Window.partitionBy("session")
    place, last = F.row_number().over(own.orderBy("aid")) - 1, F.count("*").over(own) - 1
    items = items.select("session", "aid", F.floor(place / block).alias("_mine"), F.sequence(F.lit(0).cast("long"), F.floor(last / block)).alias("_all"))
    left = items.select("session", F.col("aid").alias("item"), F.col("_mine").alias("_a"), F.explode("_all").alias("_b"))
    right = items.select("session", F.col("aid").alias("other"), F.explode("_all").alias("_a"), F.col("_mine").alias("_b"))
    pairs = left.join(right, ["session", "_a", "_b"]).where("item <> other")
    return pairs.groupBy("item", "other").agg(F.count("*").alias("n"))


def popularity(hist: DataFrame) -> DataFrame:
    """Per item of the catalogue its events of each action, repeats included."""
    return hist.groupBy("aid").agg(*[F.count_if(F.col("event_type") == k).alias(f"n_{a}") for k, a in enumerate(ACTIONS)])


def recency(prefix: DataFrame) -> DataFrame:
    """(session, aid, recency): the best 1 / distance of an item from the end of its prefix, as an integer; ties in time by item and action."""
    back = Window.partitionBy("session").orderBy(F.desc("ts"), F.desc("aid"), F.desc("event_type"))
    rows = prefix.withColumn("_distance", F.row_number().over(back))
    return rows.groupBy("session", "aid").agg(F.max(F.round(F.lit(float(SCALE)) / F.col("_distance")).cast("bigint")).alias("recency"))


def leading(counts: DataFrame, pool: int = POOL) -> DataFrame:
    """(objective, aid): the catalogue's ``pool`` most popular items of each action. No other item without association or recency can be among the best ``pool`` of a session."""
    out = None
    for a in ACTIONS:
        one = counts.orderBy(F.desc(f"n_{a}"), "aid").limit(pool).select(F.lit(a).alias("objective"), "aid")
        out = one if out is None else out.unionByName(one)
    return out


#: Rows of (session, item) that a task orders, on average.
TASK_ROWS = 100_000


def tasks(own: DataFrame, pairs: DataFrame, counts: DataFrame, pool: int = POOL, task_rows: int = TASK_ROWS) -> int:
    """How many tasks explain sessions, so that each has some ``task_rows`` rows at any size of the input; the driver gets one row of sums."""
    degree = pairs.groupBy(F.col("item").alias("aid")).agg(F.count("*").alias("_n"))
    heads = own.join(degree, "aid", "left").groupBy("session").agg(F.sum(1 + F.coalesce("_n", F.lit(0))).alias("_n"))
    n_items = counts.count()
    listed = F.least(F.col("_n"), F.lit(n_items)) + min(n_items, len(ACTIONS) * pool)
    return max(1, -(-(heads.agg(F.sum(listed)).first()[0] or 0) // task_rows))


def explanations(prefix: DataFrame, pairs: DataFrame, counts: DataFrame, pool: int = POOL, task_rows: int = TASK_ROWS) -> DataFrame:
    """Per (session, objective, item of the catalogue) recency, association with the prefix, the session's highest association, and popularity, as integers.

    Items with an association or in the prefix, and the leading ones of any action; the other items of the catalogue
    have popularity alone and rank behind these, so sessions never meet the whole catalogue. Rows are spread over the objectives last,
    and the number of tasks goes by that of rows, so that a task's memory does not grow with the input.
    """
    own, zero = recency(prefix), F.lit(0).cast("bigint")
    n = tasks(own, pairs, counts, pool, task_rows)
    own = own.repartition(n, "session")
    near = own.join(pairs.withColumnRenamed("item", "aid"), "aid").groupBy("session", F.col("other").alias("aid")).agg(F.sum(F.col("recency") * F.col("n")).alias("assoc"))
    everyone = own.select("session").distinct().join(F.broadcast(leading(counts, pool).select("aid").distinct()))  # three bounded lists
    rows = own.select("session", "aid", "recency", zero.alias("assoc")).unionByName(near.select("session", "aid", zero.alias("recency"), "assoc"))
    rows = rows.unionByName(everyone.select("session", "aid", zero.alias("recency"), zero.alias("assoc"))).repartition(n, "session")
    rows = rows.groupBy("session", "aid").agg(F.max("recency").alias("recency"), F.max("assoc").alias("assoc"))
    rows = rows.withColumn("most", F.max("assoc").over(Window.partitionBy("session")))
    tops = counts.agg(*[F.max(f"n_{a}").alias(f"top_{a}") for a in ACTIONS])
    known = rows.join(counts, "aid").crossJoin(F.broadcast(tops))  # one row
    each = F.explode(F.array(*[F.struct(F.lit(a).alias("objective"), F.col(f"n_{a}").alias("popularity"), F.col(f"top_{a}").alias("top")) for a in ACTIONS]))
    return known.select("session", "aid", "recency", "assoc", "most", each.alias("_x")).select("session", "_x.objective", "aid", "recency", "assoc", "most", "_x.popularity", "_x.top")


def _share(value: Column, most: Column) -> Column:
    return F.when(most > 0, value.cast("double") / most).otherwise(0.0)


def candidates(explained: DataFrame, pool: int = POOL) -> DataFrame:
    """The best ``pool`` items per session and objective by weighted score in fixed point, ties by item."""
    a, r, p = PARTS
    score = a * _share(F.col("assoc"), F.col("most")) + r * (F.col("recency") / F.lit(float(SCALE))) + p * _share(F.col("popularity"), F.col("top"))
    rows = explained.withColumn("score", F.round(score * F.lit(1e9)).cast("bigint"))
    rank = F.row_number().over(Window.partitionBy("session", "objective").orderBy(F.desc("score"), "aid"))
    return rows.withColumn("rank", rank.cast("bigint")).where(F.col("rank") <= pool)


def sources() -> Column:
    """Names of the parts that speak for an item, comma-joined."""
    return F.concat_ws(",", *[F.when(F.col(c) > 0, F.lit(n)) for c, n in zip(("assoc", "recency", "popularity"), SOURCES, strict=True)])
