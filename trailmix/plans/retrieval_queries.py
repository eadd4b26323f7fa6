"""Queries of the co-visitation graph, candidates and recommendations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmix.canon import HISTORY_END
from trailmix.operators import candidates, graph, simple
from trailmix.plans.base import Steps, prelude

QUERIES: dict[str, object] = {}
ORACLES: dict[str, str] = {}


def add(name: str, sql: str | None = None, role: str = "evaluation"):
    def register(f):
        QUERIES[name] = lambda spark, sf_dir: f(Steps(spark, sf_dir))
        if sql:
            ORACLES[name] = prelude(role) + sql
        return f

    return register


COUNTS = ", ".join(f"hist_{a}_{h}" for a in ("all", "clicks", "carts", "orders") for h in ("all", *[f"h{x}" for x in graph.HORIZONS]))
S5 = ", ".join(f"{c}_s" for c in candidates.SOURCES)
R5 = ", ".join(f"{c}_r" for c in candidates.SOURCES)


@add("item_statistics", f"SELECT aid, history_first_ts, history_last_ts, {COUNTS} FROM stats_")
def _(s: Steps) -> DataFrame:
    return s.stats


@add("covisit_pairs", "SELECT session, source_aid, target_aid, target_type, w FROM prs_")
def _(s: Steps) -> DataFrame:
    """By a self-join with a band predicate, over tails of at most 30 events."""
    return graph.pairs_by_join(s.tail)


@add("covisit_pairs_lead", "SELECT session, source_aid, target_aid, target_type, w FROM prs_")
def _(s: Steps) -> DataFrame:
    """By ``lead``, which is linear in a session; the form that the graph is built with."""
    return s.prs.select("session", "source_aid", "target_aid", "target_type", "w")


@add("covisit_unique_pairs", "SELECT session, source_aid, target_aid, time_w, cart_w, order_w FROM up_")
def _(s: Steps) -> DataFrame:
    return s.up


@add("covisit_totals", "SELECT source_aid, target_aid, time_w, cart_w, order_w FROM tot_")
def _(s: Steps) -> DataFrame:
    return s.tot


@add("covisit_graph", "SELECT source_aid, target_aid, time_w / 1e9::DOUBLE AS time_score, cart_w / 2e10::DOUBLE AS cart_score, order_w / 2e10::DOUBLE AS order_score FROM graph_")
def _(s: Steps) -> DataFrame:
    return graph.scaled(s.edges)


@add("topk_neighbors", "SELECT * FROM (SELECT source_aid, target_aid, time_w / 1e9::DOUBLE AS time_score, row_number() OVER (PARTITION BY source_aid ORDER BY time_w DESC, target_aid) AS rank FROM tot_) WHERE rank <= 10")
def _(s: Steps) -> DataFrame:
    order = graph.Window.partitionBy("source_aid").orderBy(F.desc("time_w"), "target_aid")
    rows = s.tot.withColumn("rank", F.row_number().over(order).cast("bigint")).where("rank <= 10")
    return rows.select("source_aid", "target_aid", (F.col("time_w") / F.lit(1e9)).alias("time_score"), "rank")


@add("popular_items", "SELECT action, aid, n, list_rank FROM pop_")
def _(s: Steps) -> DataFrame:
    return s.pop.select("action", "aid", "n", "list_rank")


@add("candidate_edges", "SELECT session, pos, source_aid, aid, time_w, cart_w, order_w FROM sed_")
def _(s: Steps) -> DataFrame:
    return candidates.seed_edges(s.pre, s.edges).select("session", "pos", "source_aid", "aid", "time_w", "cart_w", "order_w")


@add("candidate_discovery", "SELECT DISTINCT session, aid FROM part_")
def _(s: Steps) -> DataFrame:
    return candidates.discovery(s.pre, s.edges, s.pop)


@add("setop_union_sources", "SELECT session, aid FROM pre_ UNION SELECT session, aid FROM sed_")
def _(s: Steps) -> DataFrame:
    return s.pre.select("session", "aid").union(candidates.seed_edges(s.pre, s.edges).select("session", "aid")).distinct()


@add("source_scores", f"SELECT session, aid, {S5} FROM sc_")
def _(s: Steps) -> DataFrame:
    return s.sc


@add("source_ranks", f"SELECT session, aid, {R5} FROM rk_")
def _(s: Steps) -> DataFrame:
    return s.rk.select("session", "aid", *R5.split(", "))


@add("revisit_candidates", "SELECT session, aid, last_pos, row_number() OVER (PARTITION BY session ORDER BY last_pos) AS place FROM (SELECT session, aid, min(pos) AS last_pos FROM pre_ GROUP BY 1, 2)")
def _(s: Steps) -> DataFrame:
    rows = s.pre.groupBy("session", "aid").agg(F.min("pos").alias("last_pos"))
    return rows.withColumn("place", F.row_number().over(graph.Window.partitionBy("session").orderBy("last_pos")).cast("bigint"))


@add("candidate_fusion", "SELECT session, aid, fusion FROM fus_")
def _(s: Steps) -> DataFrame:
    return s.rk.select("session", "aid", candidates.fused(candidates.FUSION).alias("fusion"))


@add("candidates_topn", "SELECT session, aid, fusion, candidate_position FROM cand_")
def _(s: Steps) -> DataFrame:
    return s.cand.select("session", "aid", "fusion", "candidate_position")


@add("baseline_recommendations", "SELECT session, objective, aid, score, rank FROM recs_")
def _(s: Steps) -> DataFrame:
    return s.recs.select("session", "objective", "aid", "score", "rank")


@add("topk_recommendations", "SELECT session, aid, candidate_position AS rank FROM cand_ WHERE candidate_position <= 20")
def _(s: Steps) -> DataFrame:
    return s.cand.where("candidate_position <= 20").select("session", "aid", F.col("candidate_position").alias("rank"))


@add("candidate_targets", "SELECT session, aid, candidate_position, target_clicks, target_carts, target_orders FROM tgt_")
def _(s: Steps) -> DataFrame:
    return candidates.with_targets(s.cand, s.labels_of("evaluation")).select("session", "aid", "candidate_position", "target_clicks", "target_carts", "target_orders")


NEGATIVES = """, neg_ AS (SELECT *, row_number() OVER (PARTITION BY session, positive ORDER BY candidate_position) AS place FROM (SELECT *, (target_clicks + target_carts + target_orders > 0) AS positive FROM tgt_)),
draw_ AS (SELECT *, row_number() OVER (PARTITION BY session, positive, place <= 5 ORDER BY ('0x' || substr(md5(session || '|' || aid || '|' || candidate_position || '|7'), 1, 12))::BIGINT, candidate_position) AS draw FROM neg_),
train_ AS (SELECT * FROM draw_ WHERE positive OR place <= 5 OR draw <= 5) """


@add("negative_sampling", NEGATIVES + "SELECT session, aid, candidate_position, positive::BIGINT AS positive FROM train_", role="fit")
def _(s: Steps) -> DataFrame:
    rows = candidates.training_sample(candidates.with_targets(s.fit_cand, s.labels_of("fit")))
    return rows.select("session", "aid", "candidate_position", "positive")


@add("training_rows", NEGATIVES + f"SELECT session, aid, candidate_position, target_clicks, target_carts, target_orders, {S5}, {R5} FROM train_", role="fit")
def _(s: Steps) -> DataFrame:
    rows = candidates.training_sample(candidates.with_targets(s.fit_cand, s.labels_of("fit")))
    return rows.select("session", "aid", "candidate_position", "target_clicks", "target_carts", "target_orders", *S5.split(", "), *R5.split(", "))


@add("submission_rows", "SELECT session || '_' || objective AS session_type, string_agg(aid::VARCHAR, ' ' ORDER BY rank) AS labels FROM recs_ GROUP BY session, objective")
def _(s: Steps) -> DataFrame:
    return submission(s)


def submission(s: Steps) -> DataFrame:
    items = F.transform(F.array_sort(F.collect_list(F.struct("rank", "aid"))), lambda x: x["aid"].cast("string"))
    return s.recs.groupBy("session", "objective").agg(F.array_join(items, " ").alias("labels")).select(F.concat_ws("_", "session", "objective").alias("session_type"), "labels")


@add("submission_validation", """SELECT count(*) AS n, count(*) - count(DISTINCT session_type) AS repeated, count(*) FILTER (k <> 20) AS wrong_length, count(*) FILTER (d <> k) AS repeated_items, count(*) FILTER (NOT regexp_matches(labels, '^[0-9]+( [0-9]+)*$')) AS not_decimal,
    (SELECT count(*) FROM led_ l WHERE split_role = 'evaluation' AND l.session || '_' || objective NOT IN (SELECT session || '_' || objective FROM recs_)) AS missing
    FROM (SELECT session || '_' || objective AS session_type, string_agg(aid::VARCHAR, ' ' ORDER BY rank) AS labels, count(*) AS k, count(DISTINCT aid) AS d FROM recs_ GROUP BY session, objective)""")
def _(s: Steps) -> DataFrame:
    rows = submission(s).withColumn("items", F.split("labels", " "))
    asked = s.ledger_of("evaluation").select(F.concat_ws("_", "session", "objective").alias("session_type"))
    missing = asked.join(rows.select("session_type"), "session_type", "left_anti").agg(F.count("*").alias("missing")).scalar()
    return rows.agg(
        F.count("*").alias("n"), (F.count("*") - F.countDistinct("session_type")).alias("repeated"), F.count_if(F.size("items") != 20).alias("wrong_length"),
        F.count_if(F.size(F.array_distinct("items")) != F.size("items")).alias("repeated_items"), F.count_if(~F.col("labels").rlike("^[0-9]+( [0-9]+)*$")).alias("not_decimal"),
    ).withColumn("missing", missing)


# The small model. Its SQL scores the whole catalogue for every session, as the model is defined; the plan does not.
DEMO = """, it_ AS (SELECT DISTINCT session, aid FROM hist_), co_ AS (SELECT a.aid AS item, b.aid AS other, count(*) AS n FROM it_ a JOIN it_ b USING (session) WHERE a.aid <> b.aid GROUP BY 1, 2),
cnt_ AS (SELECT aid, count(*) FILTER (event_type = 0) AS n_clicks, count(*) FILTER (event_type = 1) AS n_carts, count(*) FILTER (event_type = 2) AS n_orders FROM hist_ GROUP BY 1),
pop3_ AS (SELECT objective, aid, popularity, max(popularity) OVER (PARTITION BY objective) AS top FROM (SELECT 'clicks' AS objective, aid, n_clicks AS popularity FROM cnt_ UNION ALL SELECT 'carts', aid, n_carts FROM cnt_ UNION ALL SELECT 'orders', aid, n_orders FROM cnt_)),
far_ AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY ts DESC, aid DESC, event_type DESC) AS distance FROM obs_ WHERE split_role = 'evaluation'),
own_ AS (SELECT session, aid, round(1e6::DOUBLE / min(distance))::BIGINT AS recency FROM far_ GROUP BY 1, 2),
as_ AS (SELECT session, other AS aid, sum(recency * n)::BIGINT AS assoc FROM own_ JOIN co_ ON item = aid GROUP BY 1, 2),
why_ AS (SELECT session, objective, aid, coalesce(recency, 0) AS recency, coalesce(assoc, 0) AS assoc, popularity, top FROM (SELECT DISTINCT session FROM far_) CROSS JOIN pop3_ LEFT JOIN own_ USING (session, aid) LEFT JOIN as_ USING (session, aid)),
dsc_ AS (SELECT *, round((0.6::DOUBLE * (CASE WHEN max(assoc) OVER (PARTITION BY session, objective) > 0 THEN assoc::DOUBLE / max(assoc) OVER (PARTITION BY session, objective) ELSE 0 END) + 0.3::DOUBLE * (recency / 1e6::DOUBLE)
    + 0.1::DOUBLE * (CASE WHEN top > 0 THEN popularity / top::DOUBLE ELSE 0 END)) * 1e9::DOUBLE)::BIGINT AS score FROM why_),
dcand_ AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session, objective ORDER BY score DESC, aid) AS rank FROM dsc_) WHERE rank <= 50) """


def demo(s: Steps) -> DataFrame:
    """Candidates of every session and objective; the first 20 are recommended. Pairs, counts and the result are written once, as all queries on the model read them."""
    pairs, counts = s._kept("demo-pairs", lambda: simple.cooccurrence(s.hist)), s._kept("demo-counts", lambda: simple.popularity(s.hist))
    return s._kept("demo", lambda: simple.candidates(simple.explanations(s.pre, pairs, counts)).drop("most"))


@add("demo_cooccurrence", DEMO + "SELECT item, other, n FROM co_")
def _(s: Steps) -> DataFrame:
    return simple.cooccurrence(s.hist)


@add("demo_popularity", DEMO + "SELECT aid, n_clicks, n_carts, n_orders FROM cnt_")
def _(s: Steps) -> DataFrame:
    return simple.popularity(s.hist)


@add("demo_candidates", DEMO + "SELECT session, objective, aid, score, rank FROM dcand_")
def _(s: Steps) -> DataFrame:
    return demo(s).select("session", "objective", "aid", "score", "rank")


@add("demo_recommendations", DEMO + "SELECT session, objective, aid, score, rank FROM dcand_ WHERE rank <= 20")
def _(s: Steps) -> DataFrame:
    return demo(s).where(F.col("rank") <= simple.TOP).select("session", "objective", "aid", "score", "rank")


@add("demo_explanations", DEMO + """SELECT session, objective, aid, recency, assoc, popularity, concat_ws(',', CASE WHEN assoc > 0 THEN 'session co-occurrence' END, CASE WHEN recency > 0 THEN 'observed prefix' END, CASE WHEN popularity > 0 THEN 'historical popularity' END) AS sources
    FROM dcand_ WHERE rank <= 20""")
def _(s: Steps) -> DataFrame:
    return demo(s).where(F.col("rank") <= simple.TOP).select("session", "objective", "aid", "recency", "assoc", "popularity", simple.sources().alias("sources"))


@add("demo_evaluation", DEMO + """SELECT objective, sum(hits)::BIGINT AS hits, sum(denominator)::BIGINT AS denominator, sum(candidate_hits)::BIGINT AS candidate_hits, CASE WHEN sum(denominator) > 0 THEN sum(hits) / sum(denominator)::DOUBLE ELSE 0 END AS recall,
    CASE WHEN sum(denominator) > 0 THEN sum(candidate_hits) / sum(denominator)::DOUBLE ELSE 0 END AS candidate_oracle FROM (SELECT l.session, objective, any_value(recall_denominator) AS denominator, count(*) FILTER (rank <= 20) AS hits, least(20, count(rank)) AS candidate_hits
    FROM led_ l LEFT JOIN lab_ t USING (session, objective) LEFT JOIN dcand_ d USING (session, objective, aid) WHERE l.split_role = 'evaluation' GROUP BY 1, 2) GROUP BY 1""")
def _(s: Steps) -> DataFrame:
    met = demo(s).select("session", "objective", "aid", "rank").join(s.labels_of("evaluation").select("session", "objective", "aid"), ["session", "objective", "aid"])
    met = met.groupBy("session", "objective").agg(F.count_if(F.col("rank") <= simple.TOP).alias("hits"), F.least(F.lit(20), F.count("*")).cast("bigint").alias("candidate_hits"))
    zero = F.lit(0).cast("bigint")
    rows = s.ledger_of("evaluation").join(met, ["session", "objective"], "left").withColumns({c: F.coalesce(c, zero) for c in ("hits", "candidate_hits")})
    sums = rows.groupBy("objective").agg(F.sum("hits").alias("hits"), F.sum("recall_denominator").alias("denominator"), F.sum("candidate_hits").alias("candidate_hits"))
    share = lambda c: F.when(F.col("denominator") > 0, F.col(c) / F.col("denominator")).otherwise(0.0)
    return sums.withColumns({"recall": share("hits"), "candidate_oracle": share("candidate_hits")})


@add("demo_contract_violations", DEMO + """SELECT (SELECT count(*) FROM dcand_ WHERE session NOT IN (SELECT session FROM far_)) AS unknown_sessions, (SELECT count(*) FROM dcand_ WHERE aid NOT IN (SELECT aid FROM hist_)) AS outside_catalog,
    (SELECT count(*) - count(DISTINCT (session, objective, aid)) FROM dcand_) AS repeated, (SELECT count(*) FROM (SELECT session, objective FROM dcand_ GROUP BY 1, 2 HAVING count(*) < 20)) AS too_few,
    (SELECT count(*) FROM far_ WHERE aid < 0 OR ts < 0 OR event_type NOT IN (0, 1, 2)) AS bad_events, (SELECT count(*) FROM led_ WHERE split_role = 'evaluation' AND query_ts < 1705579200000) AS early_queries""")
def _(s: Steps) -> DataFrame:
    got = demo(s).select("session", "objective", "aid")
    n = lambda d: d.agg(F.count("*").alias("n")).scalar()
    rows = got.agg((F.count("*") - F.countDistinct("session", "objective", "aid")).alias("repeated"))
    return rows.select(
        n(got.join(s.pre.select("session").distinct(), "session", "left_anti")).alias("unknown_sessions"), n(got.join(s.hist.select("aid").distinct(), "aid", "left_anti")).alias("outside_catalog"), "repeated",
        n(got.groupBy("session", "objective").count().where(F.col("count") < simple.TOP)).alias("too_few"), n(s.pre.where("aid < 0 OR ts < 0 OR event_type NOT IN (0, 1, 2)")).alias("bad_events"),
        n(s.ledger_of("evaluation").where(F.col("query_ts") < HISTORY_END)).alias("early_queries"),
    )
