"""Queries of metrics and audits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmix.operators import metrics
from trailmix.plans.base import Steps, prelude

QUERIES: dict[str, object] = {}
ORACLES: dict[str, str] = {}


def add(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = lambda spark, sf_dir: f(Steps(spark, sf_dir))
        if sql:
            ORACLES[name] = prelude() + sql
        return f

    return register


EVAL = "evaluation"
TRUTH = ", truth_ AS (SELECT session, aid FROM lab_ WHERE split_role = 'evaluation' AND objective <> 'clicks'), lists_ AS (SELECT session, aid, pos AS rank FROM pre_) "


def truth(s: Steps) -> DataFrame:
    return s.labels_of(EVAL).where("objective <> 'clicks'").select("session", "aid")


def lists(s: Steps) -> DataFrame:
    """Prefix items by recency, with their repeats: lists on which cutting and deduplicating differ."""
    return s.pre.select("session", "aid", F.col("pos").alias("rank"))


@add("ranked_hits", "SELECT session, objective, hits, recall_denominator FROM hits_")
def _(s: Steps) -> DataFrame:
    return s.hits.select("session", "objective", "hits", "recall_denominator")


@add("query_metrics", "SELECT session, objective, hits, recall_denominator, round(ndcg, 9) AS ndcg, round(mrr, 9) AS mrr, hit_rate, eligible FROM hits_")
def _(s: Steps) -> DataFrame:
    return s.hits.select("session", "objective", "hits", "recall_denominator", F.round("ndcg", 9).alias("ndcg"), F.round("mrr", 9).alias("mrr"), "hit_rate", "eligible")


@add("setop_hit_intersection", "SELECT session, objective, aid FROM recs_ INTERSECT SELECT session, objective, aid FROM lab_")
def _(s: Steps) -> DataFrame:
    return s.recs.select("session", "objective", "aid").join(s.labels_of(EVAL), ["session", "objective", "aid"], "left_semi").distinct()


POOLED = "(SELECT objective, sum(hits)::BIGINT AS hits, sum(recall_denominator)::BIGINT AS denominator, sum(hits) / sum(recall_denominator)::DOUBLE AS recall FROM hits_ GROUP BY 1)"
WEIGHT = "CASE objective WHEN 'clicks' THEN 0.1 WHEN 'carts' THEN 0.3 ELSE 0.6 END::DOUBLE"


@add("official_score", f"SELECT objective, hits, denominator, recall, round((SELECT sum({WEIGHT} * recall) FROM {POOLED}), 9) AS weighted FROM {POOLED}")
def _(s: Steps) -> DataFrame:
    rows = metrics.pooled(s.hits)
    return rows.withColumn("weighted", F.round(metrics.official(s.hits).scalar(), 9))


@add("evaluation_report", """SELECT objective, count(*) AS sessions, sum(eligible)::BIGINT AS eligible, sum(hits)::BIGINT AS hits, sum(recall_denominator)::BIGINT AS denominator, round(avg(ndcg) FILTER (eligible = 1), 9) AS ndcg,
    round(avg(mrr) FILTER (eligible = 1), 9) AS mrr, round(avg(hit_rate) FILTER (eligible = 1), 9) AS hit_rate FROM hits_ GROUP BY 1""")
def _(s: Steps) -> DataFrame:
    mean = lambda c: F.round(F.avg(F.when(F.col("eligible") == 1, F.col(c))), 9).alias(c)
    return s.hits.groupBy("objective").agg(
        F.count("*").alias("sessions"), F.sum("eligible").alias("eligible"), F.sum("hits").alias("hits"), F.sum("recall_denominator").alias("denominator"), mean("ndcg"), mean("mrr"), mean("hit_rate")
    )


@add("prefix_slices", """SELECT slice, objective, hits, denominator, recall FROM (SELECT slice, objective, sum(hits)::BIGINT AS hits, sum(recall_denominator)::BIGINT AS denominator, sum(hits) / nullif(sum(recall_denominator), 0)::DOUBLE AS recall,
    FROM (SELECT *, CASE WHEN observed_events = 1 THEN '1' WHEN observed_events <= 5 THEN '2-5' WHEN observed_events <= 20 THEN '6-20' ELSE '21+' END AS slice FROM hits_) GROUP BY 1, 2) QUALIFY min(denominator) OVER (PARTITION BY slice) > 0 AND count(*) OVER (PARTITION BY slice) = 3""")
def _(s: Steps) -> DataFrame:
    rows = metrics.pooled(s.hits.withColumn("slice", metrics.bucket(F.col("observed_events"))), "slice")
    whole = rows.groupBy("slice").agg(F.min("denominator").alias("least"), F.count("*").alias("n")).where("least > 0 AND n = 3").select("slice")
    return rows.join(whole, "slice", "left_semi")


CUTS = "(VALUES (5), (10), (30))"


@add("candidate_frontier", f"""SELECT budget::BIGINT AS budget, objective, sum(least(20, n))::BIGINT AS hits, sum(recall_denominator)::BIGINT AS denominator FROM (SELECT budget, l.session, l.objective, any_value(recall_denominator) AS recall_denominator, count(c.aid) AS n
    FROM led_ l CROSS JOIN {CUTS} b(budget) LEFT JOIN lab_ t USING (session, objective) LEFT JOIN cand_ c ON c.session = l.session AND c.aid = t.aid AND c.candidate_position <= budget WHERE l.split_role = 'evaluation' GROUP BY 1, 2, 3) GROUP BY 1, 2""")
def _(s: Steps) -> DataFrame:
    met = s.cand.select("session", "aid", "candidate_position").join(s.labels_of(EVAL), ["session", "aid"])
    counts = met.groupBy("session", "objective").agg(*[F.count_if(F.col("candidate_position") <= b).alias(f"n{b}") for b in (5, 10, 30)])
    rows = s.ledger_of(EVAL).join(counts, ["session", "objective"], "left")
    spread = F.explode(F.array(*[F.struct(F.lit(b).cast("bigint").alias("budget"), F.least(F.lit(20), F.coalesce(f"n{b}", F.lit(0))).cast("bigint").alias("hits")) for b in (5, 10, 30)]))
    rows = rows.select("objective", "recall_denominator", spread.alias("x"))
    return rows.groupBy(F.col("x.budget").alias("budget"), "objective").agg(F.sum("x.hits").alias("hits"), F.sum("recall_denominator").alias("denominator"))


@add("pool_hits_by_budget", "SELECT session, objective, count(*) FILTER (candidate_position <= 5) AS pool_5, count(*) FILTER (candidate_position <= 10) AS pool_10, count(*) AS pool_30 FROM cand_ JOIN lab_ USING (session, aid) GROUP BY 1, 2")
def _(s: Steps) -> DataFrame:
    met = s.cand.join(s.labels_of(EVAL), ["session", "aid"])
    return met.groupBy("session", "objective").agg(F.count_if(F.col("candidate_position") <= 5).alias("pool_5"), F.count_if(F.col("candidate_position") <= 10).alias("pool_10"), F.count("*").alias("pool_30"))


@add("recall_at_k", TRUTH + "SELECT t.session, (SELECT count(DISTINCT l.aid) FROM lists_ l JOIN truth_ u USING (session, aid) WHERE l.session = t.session AND l.rank <= 3) AS hits, least(3, count(DISTINCT aid)) AS denominator FROM truth_ t GROUP BY 1")
def _(s: Steps) -> DataFrame:
    return metrics.recall_at_k(lists(s), truth(s), 3)


CEILING = "(SELECT session, aid FROM (SELECT session, aid, row_number() OVER (PARTITION BY session ORDER BY min(rank), aid) AS place FROM lists_ GROUP BY 1, 2) WHERE place <= 3)"


@add("candidate_ceiling", TRUTH + f"SELECT t.session, least(20, (SELECT count(*) FROM {CEILING} c WHERE c.session = t.session AND c.aid IN (SELECT u.aid FROM truth_ u WHERE u.session = t.session))) AS hits, least(20, count(DISTINCT aid)) AS denominator FROM truth_ t GROUP BY 1")
def _(s: Steps) -> DataFrame:
    return metrics.ceiling_at_k(lists(s), truth(s), 3)


PAIR = """, base_ AS (SELECT session, aid FROM cand_ WHERE candidate_position <= 5), second_ AS (SELECT session, aid FROM recs_ WHERE objective = 'orders' AND rank <= 5), tr_ AS (SELECT DISTINCT session, aid FROM truth_),
two_ AS (SELECT session, count(*) AS n, count(b.k) AS base, count(s.k) AS second, count(*) FILTER (b.k IS NOT NULL OR s.k IS NOT NULL) AS either, count(*) FILTER (b.k IS NULL AND s.k IS NOT NULL) AS fresh FROM tr_
    LEFT JOIN (SELECT *, 1 AS k FROM base_) b USING (session, aid) LEFT JOIN (SELECT *, 1 AS k FROM second_) s USING (session, aid) GROUP BY 1) """


def two_lists(s: Steps) -> DataFrame:
    base = s.cand.where("candidate_position <= 5").select("session", "aid", F.lit(1).alias("b"))
    second = s.recs.where("objective = 'orders' AND rank <= 5").select("session", "aid", F.lit(1).alias("s"))
    rows = truth(s).distinct().join(base, ["session", "aid"], "left").join(second, ["session", "aid"], "left")
    return rows.groupBy("session").agg(
        F.count("*").alias("n"), F.count("b").alias("base"), F.count("s").alias("second"), F.count_if(F.expr("b IS NOT NULL OR s IS NOT NULL")).alias("either"), F.count_if(F.expr("b IS NULL AND s IS NOT NULL")).alias("fresh")
    )


@add("incremental_recall", TRUTH + PAIR + "SELECT sum(least(20, base))::BIGINT AS base_hits, sum(least(20, second))::BIGINT AS second_hits, sum(least(20, either))::BIGINT AS union_hits, sum(fresh)::BIGINT AS unique_hits, sum(least(20, n))::BIGINT AS denominator, (sum(least(20, either)) - sum(least(20, base)))::BIGINT AS gained FROM two_")
def _(s: Steps) -> DataFrame:
    capped = lambda c: F.sum(F.least(F.lit(20), c))
    return two_lists(s).agg(
        capped("base").alias("base_hits"), capped("second").alias("second_hits"), capped("either").alias("union_hits"), F.sum("fresh").alias("unique_hits"), capped("n").alias("denominator"), (capped("either") - capped("base")).alias("gained")
    )


@add("poisson_bootstrap", TRUTH + PAIR + """, d_ AS (SELECT *, ('0x' || substr(md5(session || '|' || replicate || '|11'), 1, 12))::BIGINT % 1000000 AS u FROM two_, (SELECT unnest(range(50)) AS replicate)),
    w_ AS (SELECT *, (u >= 367879)::INT + (u >= 735759)::INT + (u >= 919699)::INT + (u >= 981012)::INT + (u >= 996340)::INT + (u >= 999406)::INT + (u >= 999917)::INT + (u >= 999990)::INT AS w FROM d_)
    SELECT replicate, sum(w * base)::BIGINT AS base, sum(w * either)::BIGINT AS second, sum(w * n)::BIGINT AS denominator FROM w_ GROUP BY 1""")
def _(s: Steps) -> DataFrame:
    rows = two_lists(s).select("session", F.col("base").alias("base_hits"), F.col("either").alias("second_hits"), F.col("n").alias("denominator"))
    return metrics.poisson_replicates(rows, 50, 11)


@add("bootstrap_interval")
def _(s: Steps) -> DataFrame:
    """Rows only: a 95 % interval of the pooled gain by percentiles over replicates."""
    rows = two_lists(s).select("session", F.col("base").alias("base_hits"), F.col("either").alias("second_hits"), F.col("n").alias("denominator"))
    gain = (F.col("second") - F.col("base")) / F.col("denominator")
    made = metrics.poisson_replicates(rows, 200, 11).where("denominator > 0").select(gain.alias("gain"))
    return made.agg(F.percentile("gain", 0.025).alias("low"), F.percentile("gain", 0.5).alias("middle"), F.percentile("gain", 0.975).alias("high"), F.count("*").alias("replicates"))


@add("shortfall_accounting", """SELECT objective, sum(recall_denominator)::BIGINT AS denominator, sum(h)::BIGINT AS hits, sum(least(recall_denominator, greatest(p, h)) - h)::BIGINT AS ranking_shortfall, sum(recall_denominator - least(recall_denominator, greatest(p, h)))::BIGINT AS retrieval_shortfall,
    count(*) FILTER (recall_denominator > 0) AS active, count(*) FILTER (recall_denominator > 0 AND observed_events <= 4) AS short_prefixes FROM (SELECT session, objective, observed_events, recall_denominator, hits AS h, coalesce(n, 0) AS p FROM hits_
    LEFT JOIN (SELECT session, objective, count(*) AS n FROM cand_ JOIN lab_ USING (session, aid) GROUP BY 1, 2) USING (session, objective)) GROUP BY 1""")
def _(s: Steps) -> DataFrame:
    pool = s.cand.select("session", "aid").join(s.labels_of(EVAL), ["session", "aid"]).groupBy("session", "objective").agg(F.count("*").alias("p"))
    rows = s.hits.join(pool, ["session", "objective"], "left").withColumn("p", F.coalesce("p", F.lit(0)))
    reachable = F.least("recall_denominator", F.greatest("p", "hits"))
    return rows.groupBy("objective").agg(
        F.sum("recall_denominator").alias("denominator"), F.sum("hits").alias("hits"), F.sum(reachable - F.col("hits")).alias("ranking_shortfall"), F.sum(F.col("recall_denominator") - reachable).alias("retrieval_shortfall"),
        F.count_if(F.col("recall_denominator") > 0).alias("active"), F.count_if(F.expr("recall_denominator > 0 AND observed_events <= 4")).alias("short_prefixes"),
    )


@add("audit_ledger", """SELECT count(*) AS n, count(*) FILTER (true_items <> coalesce(k, 0)) AS wrong_counts, count(*) FILTER (recall_denominator <> least(20, true_items)) AS wrong_denominators, count(*) FILTER (hits > recall_denominator) AS too_many_hits
    FROM hits_ LEFT JOIN (SELECT session, objective, count(DISTINCT aid) AS k FROM lab_ GROUP BY 1, 2) USING (session, objective)""")
def _(s: Steps) -> DataFrame:
    counted = s.labels_of(EVAL).groupBy("session", "objective").agg(F.countDistinct("aid").alias("k"))
    c = lambda e, n: F.count_if(F.expr(e)).alias(n)
    return s.hits.join(counted, ["session", "objective"], "left").agg(
        F.count("*").alias("n"), c("true_items <> coalesce(k, 0)", "wrong_counts"), c("recall_denominator <> least(20, true_items)", "wrong_denominators"), c("hits > recall_denominator", "too_many_hits")
    )
