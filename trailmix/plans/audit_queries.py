"""Queries of audits: sources rebuilt both ways, nested ceilings, shortfalls by slice, demo predictions, evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmix import canon
from trailmix.operators import audits, metrics, simple
from trailmix.plans.base import Steps, prelude
from trailmix.plans.evaluation_queries import POOLED, WEIGHT
from trailmix.plans.retrieval_queries import DEMO, demo

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


def boundaries(s: Steps) -> DataFrame:
    return s.led.select("session", "split_role", "first_ts", "query_ts", "observed_last_index", "period_end").distinct()


# The SQL rebuilds from raw actions and draws, not from the steps that the stored side is made of.
_RAW = """, bound_ AS (SELECT DISTINCT session, split_role, period_end, observed_last_index FROM led_), raw_ AS (SELECT e.*, split_role, period_end, observed_last_index FROM ev_ e JOIN bound_ USING (session) WHERE ts < period_end),
rp_ AS (SELECT session, aid, ts, event_type, event_index, split_role FROM raw_ WHERE event_index <= observed_last_index), sp_ AS (SELECT session, aid, ts, event_type, event_index, split_role FROM obs_),
fut_ AS (SELECT * FROM raw_ WHERE event_index > observed_last_index),
rl_ AS (SELECT session, split_role, 'clicks' AS objective, aid, ts AS label_ts, event_index AS label_event_index FROM fut_ WHERE event_type = 0 QUALIFY row_number() OVER (PARTITION BY session ORDER BY event_index) = 1
    UNION ALL SELECT session, split_role, CASE event_type WHEN 1 THEN 'carts' ELSE 'orders' END, aid, min(ts), min(event_index) FROM fut_ WHERE event_type > 0 GROUP BY session, split_role, event_type, aid),
sl_ AS (SELECT session, split_role, objective, aid, label_ts, label_event_index FROM lab_) """


def _both(kind: str, a: str, b: str) -> str:
    n = lambda x, y: f"(SELECT count(*) FROM (FROM {x} EXCEPT ALL FROM {y}))"
    return f"SELECT '{kind}' AS kind, (SELECT count(*) FROM {a}) AS rebuilt, (SELECT count(*) FROM {b}) AS stored, {n(a, b)} AS rebuilt_minus_stored, {n(b, a)} AS stored_minus_rebuilt"


@add("audit_source", _RAW + _both("prefixes", "rp_", "sp_") + " UNION ALL " + _both("labels", "rl_", "sl_"))
def _(s: Steps) -> DataFrame:
    prefixes, labels = audits.rebuilt(s.ev, boundaries(s).drop("first_ts", "query_ts"))
    return audits.both_ways("prefixes", prefixes, s.obs).unionByName(audits.both_ways("labels", labels, s.lab))


@add("audit_boundaries", """, bound_ AS (SELECT DISTINCT session, split_role, first_ts, query_ts, observed_last_index, period_end FROM led_)
    SELECT count(DISTINCT session) AS sessions, (SELECT count(*) FROM (SELECT session FROM bound_ GROUP BY 1 HAVING count(*) > 1)) AS overlapping,
    (SELECT count(*) FROM (SELECT e.session FROM ev_ e JOIN bound_ b USING (session) WHERE e.ts < b.period_end GROUP BY 1 HAVING min(e.ts) <> min(b.first_ts) OR max(e.ts) FILTER (event_index <= observed_last_index) <> min(b.query_ts))) AS moved FROM bound_""")
def _(s: Steps) -> DataFrame:
    return audits.boundary_faults(s.ev, boundaries(s))


BUDGETS = (5, 10, 30)
_POOLS = ", ".join(f"least(20, count(c.aid) FILTER (candidate_position <= {b})) AS p{b}" for b in BUDGETS)


@add("audit_ceilings", f""", pools_ AS (SELECT l.session, l.objective, any_value(recall_denominator) AS d, {_POOLS} FROM led_ l LEFT JOIN lab_ t USING (session, objective) LEFT JOIN cand_ c ON c.session = l.session AND c.aid = t.aid WHERE l.split_role = 'evaluation' GROUP BY 1, 2)
    SELECT objective, count(*) AS queries, count(*) FILTER (p5 > p10 OR p10 > p30) AS not_nested, count(*) FILTER (p30 > d) AS beyond_denominator, count(*) FILTER (hits > p30) AS beyond_ceiling,
    count(*) FILTER (NOT (ndcg BETWEEN -1e-12 AND 1 + 1e-12 AND mrr BETWEEN 0 AND 1 AND hit_rate BETWEEN 0 AND 1) OR hit_rate <> (hits > 0)::BIGINT OR eligible <> (d > 0)::BIGINT) AS odd_metrics FROM pools_ FULL JOIN hits_ USING (session, objective) GROUP BY 1""")
def _(s: Steps) -> DataFrame:
    ceilings = audits.frontier(s.cand, s.labels_of(EVAL), s.ledger_of(EVAL), BUDGETS)
    return audits.ceiling_faults(ceilings, s.hits)


_SHORT = """, pool_ AS (SELECT session, objective, count(*) AS n FROM cand_ JOIN lab_ USING (session, aid) GROUP BY 1, 2),
reach_ AS (SELECT h.*, least(20, coalesce(n, 0)) AS reach FROM hits_ h LEFT JOIN pool_ USING (session, objective)),
slice_ AS (SELECT 'overall' AS slice, * FROM reach_ UNION ALL SELECT CASE WHEN observed_events <= 4 THEN '0_to_4_events' ELSE '5_or_more_events' END, * FROM reach_),
short_ AS (SELECT slice, objective, count(*) AS sessions, count(*) FILTER (recall_denominator > 0) AS active, sum(recall_denominator)::BIGINT AS denominator, sum(hits)::BIGINT AS hits, sum(reach)::BIGINT AS candidate_hits,
    (sum(reach) - sum(hits))::BIGINT AS ranking_shortfall, (sum(recall_denominator) - sum(reach))::BIGINT AS retrieval_shortfall FROM slice_ GROUP BY 1, 2) """


def short(s: Steps) -> DataFrame:
    pool = s.cand.select("session", "aid").join(s.labels_of(EVAL), ["session", "aid"]).groupBy("session", "objective").agg(F.count("*").alias("n"))
    return audits.shortfalls(s.hits, pool)


@add("shortfall_slices", _SHORT + "FROM short_")
def _(s: Steps) -> DataFrame:
    return short(s)


_share = lambda c: f"round(sum(CASE WHEN denominator > 0 THEN {WEIGHT} * {c} / denominator::DOUBLE ELSE 0 END), 9)"


@add("shortfall_weighted", _SHORT + f"""SELECT slice, {_share('hits')} AS weighted_recall, {_share('candidate_hits')} AS weighted_candidate_oracle, {_share('ranking_shortfall')} AS weighted_ranking_shortfall,
    {_share('retrieval_shortfall')} AS weighted_retrieval_shortfall, round(sum(CASE WHEN denominator > 0 THEN {WEIGHT} ELSE 0 END), 9) AS weighted_evaluable_mass FROM short_ GROUP BY 1""")
def _(s: Steps) -> DataFrame:
    rows = audits.weighted_shortfalls(short(s))
    return rows.select("slice", *[F.round(c, 9).alias(c) for c in rows.columns[1:]])


@add("evidence_review", f"SELECT objective, hits, denominator, recall, round((SELECT sum({WEIGHT} * recall) FROM {POOLED}), 9) AS weighted FROM {POOLED}")
def _(s: Steps) -> DataFrame:
    report = metrics.pooled(s.hits).withColumn("weighted", F.round(metrics.official(s.hits).scalar(), 9))
    return audits.evidence(report)


@add("availability_guard", f"SELECT split_role, count(DISTINCT session) AS sessions, count(*) AS n, min(ts) - {canon.HISTORY_END} AS margin_ms FROM obs_ GROUP BY 1")
def _(s: Steps) -> DataFrame:
    """Observed events of queries, none of which may precede the cutoff; the margin tells how far the first is behind it."""
    rows = audits.available(s.obs, canon.HISTORY_END)
    return rows.groupBy("split_role").agg(F.countDistinct("session").alias("sessions"), F.count("*").alias("n"), (F.min("ts") - canon.HISTORY_END).alias("margin_ms"))


@add("expr_iso_epoch", "SELECT event_id, strftime(make_timestamp(ts * 1000), '%Y-%m-%dT%H:%M:%S.%g') || '+00:00' AS iso, ts AS epoch_ms FROM act_")
def _(s: Steps) -> DataFrame:
    rows = canon.raw_actions(s.spark, s.dir)
    iso = F.concat(F.date_format(F.timestamp_millis("ts"), "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("+00:00"))
    return rows.select("event_id", iso.alias("iso")).withColumn("epoch_ms", audits.iso_ms(F.col("iso")))


@add("demo_prediction_violations", DEMO + """, drec_ AS (SELECT * FROM dcand_ WHERE rank <= 20), bylist_ AS (SELECT session, objective, count(*) AS k, count(DISTINCT aid) AS d, count(*) FILTER (rank <= 20) AS r FROM dcand_ GROUP BY 1, 2)
    SELECT (SELECT count(*) FROM bylist_) AS lists, (SELECT count(*) FROM (SELECT session FROM bylist_ GROUP BY 1 HAVING count(*) <> 3)) AS incomplete, (SELECT count(*) FROM bylist_ WHERE k > 50 OR r > 20) AS too_long, (SELECT count(*) FROM bylist_ WHERE d <> k) AS repeated,
    (SELECT count(*) FROM drec_ r WHERE NOT EXISTS (SELECT 1 FROM dcand_ c WHERE c.session = r.session AND c.objective = r.objective AND c.aid = r.aid)) AS outside_pool,
    (SELECT count(*) FROM far_ f JOIN (SELECT DISTINCT session, query_ts FROM led_ WHERE split_role = 'evaluation') q USING (session) WHERE f.ts > q.query_ts) AS after_query,
    (SELECT count(*) FROM lab_ l JOIN led_ q USING (session, split_role, objective) WHERE split_role = 'evaluation' AND label_ts < query_ts) AS past_targets,
    (SELECT count(*) FROM (SELECT DISTINCT session FROM led_ WHERE split_role = 'evaluation') WHERE session NOT IN (SELECT session FROM bylist_)) AS without_prediction""")
def _(s: Steps) -> DataFrame:
    made = demo(s).select("session", "objective", "aid", "rank")
    lists = made.groupBy("session", "objective").agg(F.count("*").alias("k"), F.countDistinct("aid").alias("d"), F.count_if(F.col("rank") <= simple.TOP).alias("r"))
    asked = s.ledger_of(EVAL).select("session", "query_ts").distinct()
    n = lambda d: d.agg(F.count("*").alias("n")).scalar()
    first = made.where(F.col("rank") <= simple.TOP)
    late = s.labels_of(EVAL).join(s.ledger_of(EVAL).select("session", "objective", "query_ts"), ["session", "objective"]).where("label_ts < query_ts")
    return lists.agg(F.count("*").alias("lists"), F.count_if(F.expr(f"k > {simple.POOL} OR r > {simple.TOP}")).alias("too_long"), F.count_if(F.expr("d <> k")).alias("repeated")).select(
        "lists", n(lists.groupBy("session").count().where("count <> 3")).alias("incomplete"), "too_long", "repeated",
        n(first.join(made.select("session", "objective", "aid"), ["session", "objective", "aid"], "left_anti")).alias("outside_pool"),
        n(s.pre.join(asked, "session").where("ts > query_ts")).alias("after_query"), n(late).alias("past_targets"), n(asked.join(lists.select("session"), "session", "left_anti")).alias("without_prediction"),
    )
