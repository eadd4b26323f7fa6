"""The shared steps of the queries: as DataFrames, and as DuckDB common table expressions written on their own."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmix import canon
from trailmix.operators import audits, candidates, corpus, graph, metrics
from trailmix.sources import files


#: Steps already written, by application, table, its files' fingerprint and the step's name.
_written: dict[tuple, DataFrame] = {}


class Steps:
    """Steps over one directory of tables. Those on which many others build are written once a session and read from there; the rest are lazy plans.

    If ``whole``, the roles have all their sessions, else those of a budget.
    """

    def __init__(self, spark: SparkSession, sf_dir: str, whole: bool = False):
        self.spark, self.dir = spark, sf_dir
        self.budgets = {} if whole else corpus.BUDGETS
        self.ending = "" if self.budgets else "-whole"

    def _kept(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        table = f"{self.dir}/events.parquet"
        key = (self.spark.sparkContext.applicationId, table, files.fingerprint(self.spark, table), name)
        if key not in _written:
            _written[key] = files.kept(build(), name)
        return _written[key]

    raw = cached_property(lambda self: canon.events(self.spark, self.dir))
    ev = cached_property(lambda self: self._kept("events", lambda: self.raw))
    roles = cached_property(lambda self: corpus.session_roles(self.ev))
    hist = cached_property(lambda self: corpus.history(self.ev))
    elig = cached_property(lambda self: corpus.eligible(self.ev))
    qs = cached_property(lambda self: corpus.query_sessions(self.elig))
    samp = cached_property(lambda self: corpus.sampled(self.qs, self.budgets))
    qev = cached_property(lambda self: self._kept(f"query-events{self.ending}", lambda: corpus.query_events(self.ev, self.budgets)))
    obs = cached_property(lambda self: corpus.observed(self.qev))
    lab = cached_property(lambda self: corpus.future_labels(self.qev))
    led = cached_property(lambda self: corpus.ledger(self.qev))
    stats = cached_property(lambda self: self._kept("item-statistics", lambda: graph.item_statistics(self.hist)))
    tail = cached_property(lambda self: graph.tail(self.hist))
    prs = cached_property(lambda self: graph.pairs(self.tail))
    up = cached_property(lambda self: graph.unique_pairs(self.prs))
    tot = cached_property(lambda self: self._kept("edge-totals", lambda: graph.totals(self.up)))
    edges = cached_property(lambda self: self._kept("edges", lambda: graph.pruned(self.tot)))
    pop = cached_property(lambda self: graph.popular(self.stats))
    whole = cached_property(lambda self: Steps(self.spark, self.dir, whole=True))

    def role(self, role: str) -> DataFrame:
        return candidates.prefixes(self.obs.where(F.col("split_role") == role))

    def labels_of(self, role: str) -> DataFrame:
        return self.lab.where(F.col("split_role") == role)

    def ledger_of(self, role: str) -> DataFrame:
        return self.led.where(F.col("split_role") == role)

    def candidates_of(self, role: str) -> DataFrame:
        pre = audits.available(self.role(role), canon.HISTORY_END)
        return self._kept(f"candidates-{role}{self.ending}", lambda: candidates.selected(candidates.source_ranks(candidates.source_scores(pre, self.edges, self.pop)), pre))

    pre = cached_property(lambda self: self.role("evaluation"))
    sc = cached_property(lambda self: candidates.source_scores(self.pre, self.edges, self.pop))
    rk = cached_property(lambda self: candidates.source_ranks(self.sc))
    cand = cached_property(lambda self: self.candidates_of("evaluation"))
    fit_cand = cached_property(lambda self: self.candidates_of("fit"))
    recs = cached_property(lambda self: candidates.by_objective(self.cand))
    hits = cached_property(lambda self: metrics.hits(self.recs, self.labels_of("evaluation"), self.ledger_of("evaluation")))


_STATS = ",\n".join(
    f"count(*) FILTER (WHERE {of} AND ts >= 1705579200000 - {h} * 3600000::BIGINT) AS hist_{name}_h{h}" if h else f"count(*) FILTER (WHERE {of}) AS hist_{name}_all"
    for name, of in (("all", "true"), ("clicks", "event_type = 0"), ("carts", "event_type = 1"), ("orders", "event_type = 2"))
    for h in (0, 1, 6, 12, 24, 72, 168, 336)
)

_RANKS = ",\n".join(
    f"CASE WHEN {c}_s > 0 THEN row_number() OVER (PARTITION BY session ORDER BY {c}_s DESC, aid) ELSE 0 END AS {c}_r" for c in ("time", "cart", "order", "revisit", "popular")
)


def _fusion(*weights: float) -> str:
    names = ("time", "cart", "order", "revisit", "popular")
    return " + ".join(f"CASE WHEN {c}_r > 0 THEN round({w}::DOUBLE * 1e12::DOUBLE / (20 + {c}_r))::BIGINT ELSE 0 END" for c, w in zip(names, weights, strict=True))


def prelude(role: str = "evaluation") -> str:
    return f"""
WITH RECURSIVE act_ AS (SELECT event_id, user_id, epoch_us(ts) // 1000 AS ts, json_extract_string(props, '$.k')::BIGINT AS aid,
    CASE event_type WHEN 'purchase' THEN 2 WHEN 'signup' THEN 1 ELSE 0 END::BIGINT AS event_type FROM events WHERE event_type <> 'error'),
ses_ AS (SELECT *, (user_id * 1000 + (ts - 1704067200000) // 259200000)::BIGINT AS session FROM act_),
ev_ AS (SELECT session, aid, ts, event_type, row_number() OVER (PARTITION BY session ORDER BY ts, event_id) - 1 AS event_index FROM ses_),
period_(split_role, begins, ends, period_end) AS (VALUES ('history', 0, 1705579200000, 1705579200000), ('fit', 1705579200000, 1706054400000, 1706054400000), ('selection', 1706054400000, 1706313600000, 1706313600000),
    ('evaluation', 1706313600000, 1706616000000, 1706616000000), ('excluded', 1706616000000, 9000000000000, 1706616000000)),
rolend_ AS (SELECT session, first_ts, split_role, period_end FROM (SELECT session, min(ts) AS first_ts FROM ev_ GROUP BY session) JOIN period_ ON first_ts BETWEEN begins AND ends - 1),
roles_ AS (SELECT session, first_ts, split_role FROM rolend_),
hist_ AS (FROM ev_ WHERE ts < 1705579200000),
size_ AS (SELECT r.session, split_role, period_end, (SELECT count(*) FROM ev_ e WHERE e.session = r.session AND e.ts < r.period_end) AS n_events FROM rolend_ r WHERE split_role NOT IN ('history', 'excluded')),
elig_ AS (SELECT e.*, split_role, period_end, event_index + 1 AS event_position, n_events FROM size_ z JOIN ev_ e ON e.session = z.session AND e.ts < z.period_end),
draw_of_ AS (SELECT *, ('0x' || substr(md5(session || '|42|prefix'), 1, 12))::BIGINT AS cut, ('0x' || substr(md5(session || '|42|sample'), 1, 12))::BIGINT AS turn FROM size_ WHERE n_events > 1),
qs_ AS (SELECT session, split_role, period_end, n_events, 1 + cut % (n_events - 1) AS prefix_events, turn FROM draw_of_),
samp_ AS (SELECT * EXCLUDE (turn) FROM ((FROM qs_ WHERE split_role = 'evaluation') UNION ALL (FROM qs_ WHERE split_role = 'fit' ORDER BY turn, session LIMIT 200) UNION ALL (FROM qs_ WHERE split_role = 'selection' ORDER BY turn, session LIMIT 100))),
qev_ AS (SELECT e.*, s.prefix_events FROM samp_ s JOIN elig_ e ON s.session = e.session),
obs_ AS (SELECT session, aid, ts, event_type, event_index, split_role, period_end FROM qev_ WHERE event_index < prefix_events),
lab_ AS (SELECT session, split_role, 'clicks' AS objective, arg_min(aid, event_index) AS aid, arg_min(ts, event_index) AS label_ts, min(event_index) AS label_event_index FROM qev_ WHERE event_index >= prefix_events AND event_type = 0 GROUP BY ALL
    UNION ALL SELECT session, split_role, ['carts', 'orders'][event_type], aid, min(ts), min(event_index) FROM qev_ WHERE event_index >= prefix_events AND event_type <> 0 GROUP BY session, split_role, event_type, aid),
wide_ AS (SELECT session, split_role, period_end, min(ts) FILTER (seen) AS first_ts, max(ts) FILTER (seen) AS query_ts, max(event_index) FILTER (seen) AS observed_last_index, count(*) FILTER (seen) AS observed_events,
    least(1, count(*) FILTER (NOT seen AND event_type = 0)) AS clicks, count(DISTINCT aid) FILTER (NOT seen AND event_type = 1) AS carts, count(DISTINCT aid) FILTER (NOT seen AND event_type = 2) AS orders
    FROM (SELECT *, event_index < prefix_events AS seen FROM qev_) GROUP BY ALL),
led_ AS (SELECT *, least(20, true_items) AS recall_denominator FROM (UNPIVOT wide_ ON clicks, carts, orders INTO NAME objective VALUE true_items)),
stats_ AS (SELECT aid, min(ts) AS history_first_ts, max(ts) AS history_last_ts, {_STATS} FROM hist_ GROUP BY aid),
tail_ AS (SELECT h.* FROM hist_ h JOIN (SELECT session, max(event_index) AS last FROM hist_ GROUP BY 1) USING (session) WHERE event_index > last - 30),
prs_ AS (SELECT a.session, a.aid AS source_aid, b.aid AS target_aid, b.event_type AS target_type,
    round(exp(-abs(b.ts - a.ts)::DOUBLE / 21600000::DOUBLE) / sqrt(abs(b.event_index - a.event_index)::DOUBLE) * 1e9::DOUBLE)::BIGINT AS w
    FROM tail_ a JOIN tail_ b USING (session) WHERE abs(b.event_index - a.event_index) BETWEEN 1 AND 3 AND abs(b.ts - a.ts) <= 86400000 AND a.aid <> b.aid),
best_ AS (SELECT session, source_aid, target_aid, max(w) FILTER (target_type = 0) AS click, max(w) FILTER (target_type = 1) AS cart, max(w) FILTER (target_type = 2) AS buy FROM prs_ GROUP BY ALL),
up_ AS (SELECT session, source_aid, target_aid, greatest(click, cart, buy) AS time_w, greatest(2 * click, 60 * cart, 30 * buy) AS cart_w, greatest(click, 40 * cart, 80 * buy) AS order_w FROM best_),
tot_ AS (SELECT source_aid, target_aid, sum(time_w)::BIGINT AS time_w, sum(cart_w)::BIGINT AS cart_w, sum(order_w)::BIGINT AS order_w FROM up_ GROUP BY ALL),
graph_ AS ((FROM tot_ QUALIFY row_number() OVER (PARTITION BY source_aid ORDER BY time_w DESC, target_aid) <= 10) UNION (FROM tot_ QUALIFY row_number() OVER (PARTITION BY source_aid ORDER BY cart_w DESC, target_aid) <= 10)
    UNION (FROM tot_ QUALIFY row_number() OVER (PARTITION BY source_aid ORDER BY order_w DESC, target_aid) <= 10)),
day_ AS (SELECT 'clicks' AS action, aid, hist_clicks_h24 AS n FROM stats_ UNION ALL SELECT 'carts', aid, hist_carts_h24 FROM stats_ UNION ALL SELECT 'orders', aid, hist_orders_h24 FROM stats_),
pop_ AS (SELECT * FROM (SELECT action, aid, n, row_number() OVER (PARTITION BY action ORDER BY n DESC, aid) AS list_rank FROM day_ WHERE n > 0) WHERE list_rank <= 20),
pre_ AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY event_index DESC) AS pos FROM obs_ WHERE split_role = '{role}'),
sed_ AS (SELECT p.session, p.pos, g.target_aid AS aid, g.source_aid, time_w, cart_w, order_w FROM pre_ p JOIN graph_ g ON g.source_aid = p.aid WHERE pos <= 50),
part_ AS (SELECT session, aid, round(time_w::DOUBLE / sqrt(pos::DOUBLE))::BIGINT AS t, round(cart_w::DOUBLE / sqrt(pos::DOUBLE))::BIGINT AS c, round(order_w::DOUBLE / sqrt(pos::DOUBLE))::BIGINT AS o, 0::BIGINT AS r, 0::BIGINT AS p FROM sed_
    UNION ALL SELECT session, aid, 0, 0, 0, round(1e9::DOUBLE / sqrt(pos::DOUBLE))::BIGINT, 0 FROM pre_
    UNION ALL SELECT session, aid, 0, 0, 0, 0, round((CASE action WHEN 'clicks' THEN 0.1 WHEN 'carts' THEN 0.3 ELSE 0.6 END)::DOUBLE * 1e9::DOUBLE / list_rank)::BIGINT FROM (SELECT DISTINCT session FROM pre_), pop_),
sc_ AS (SELECT session, aid, sum(t)::BIGINT AS time_s, sum(c)::BIGINT AS cart_s, sum(o)::BIGINT AS order_s, sum(r)::BIGINT AS revisit_s, sum(p)::BIGINT AS popular_s FROM part_ GROUP BY 1, 2),
rk_ AS (SELECT *, {_RANKS} FROM sc_),
fus_ AS (SELECT *, {_fusion(0.4, 0.3, 0.6, 1.0, 0.01)} AS fusion FROM rk_),
cand_ AS (SELECT * FROM (SELECT f.*, last_pos, row_number() OVER (PARTITION BY session ORDER BY last_pos NULLS LAST, fusion DESC, aid) AS candidate_position
    FROM fus_ f LEFT JOIN (SELECT session, aid, min(pos) AS last_pos FROM pre_ GROUP BY 1, 2) USING (session, aid)) WHERE candidate_position <= 30),
obj_ AS (SELECT session, aid, candidate_position, 'clicks' AS objective, {_fusion(1.0, 0.1, 0.1, 1.0, 0.01)} AS score FROM cand_
    UNION ALL SELECT session, aid, candidate_position, 'carts', {_fusion(0.3, 1.0, 0.3, 1.0, 0.01)} FROM cand_
    UNION ALL SELECT session, aid, candidate_position, 'orders', {_fusion(0.2, 0.5, 1.0, 1.0, 0.01)} FROM cand_),
recs_ AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session, objective ORDER BY score DESC, aid) AS rank FROM obj_) WHERE rank <= 20),
tgt_ AS (SELECT c.*, (l.k IS NOT NULL)::BIGINT AS target_clicks, (m.k IS NOT NULL)::BIGINT AS target_carts, (n.k IS NOT NULL)::BIGINT AS target_orders FROM cand_ c
    LEFT JOIN (SELECT DISTINCT session, aid, 1 AS k FROM lab_ WHERE objective = 'clicks') l USING (session, aid) LEFT JOIN (SELECT DISTINCT session, aid, 1 AS k FROM lab_ WHERE objective = 'carts') m USING (session, aid)
    LEFT JOIN (SELECT DISTINCT session, aid, 1 AS k FROM lab_ WHERE objective = 'orders') n USING (session, aid)),
got_ AS (SELECT session, objective, count(*) AS hits, sum(1 / log2(rank + 1)) AS dcg, max(1.0::DOUBLE / rank) AS mrr FROM recs_ JOIN lab_ USING (session, objective, aid) GROUP BY 1, 2),
hits_ AS (SELECT session, l.split_role, objective, observed_events, true_items, recall_denominator, coalesce(hits, 0) AS hits,
    CASE WHEN recall_denominator > 0 THEN coalesce(dcg, 0) / list_sum(list_transform(range(1, recall_denominator + 1), lambda i: 1 / log2(i + 1))) ELSE 0 END AS ndcg,
    coalesce(mrr, 0) AS mrr, (coalesce(hits, 0) > 0)::BIGINT AS hit_rate, (recall_denominator > 0)::BIGINT AS eligible
    FROM led_ l LEFT JOIN got_ USING (session, objective) WHERE l.split_role = '{role}'),
act4_(a, k) AS (VALUES ('all', NULL), ('clicks', 0), ('carts', 1), ('orders', 2))
"""
