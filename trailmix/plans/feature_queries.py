"""Queries of features, screening and rankers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmix.canon import portable_hash
from trailmix.operators import candidates, features, graph, metrics, screening, studied
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


def rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c).cast("bigint").alias(c) if t == "int" else F.col(c) for c, t in df.dtypes])


def sql_of(columns: dict[str, str], digits: int = 9) -> str:
    return ", ".join(f"round({e}, {digits}) + 0 AS {n}" for n, e in columns.items())  # + 0: no negative zero


SRC = candidates.SOURCES
_share = {c: f"(CASE WHEN max({c}_s) OVER (PARTITION BY session) > 0 THEN {c}_s / max({c}_s) OVER (PARTITION BY session)::DOUBLE ELSE 0 END)" for c in SRC}
SHARES = ", sh_ AS (SELECT *, " + ", ".join(f"{e} AS {c}_h" for c, e in _share.items()) + " FROM cand_)"
_n = " + ".join(f"({c}_r > 0)::INT" for c in SRC)
_sum, _sq = " + ".join(f"{c}_r" for c in SRC), " + ".join(f"{c}_r * {c}_r" for c in SRC)
_mean = "(" + " + ".join(f"{c}_h" for c in SRC) + ") / 5"
SOURCE_SQL = (
    SHARES + " SELECT session, aid, "
    + ", ".join(f"round({c}_s / 1e9::DOUBLE, 9) AS source_{x}_score, {c}_r AS source_{x}_rank, ({c}_r > 0)::BIGINT AS source_{x}_present, round({c}_h, 9) AS source_{x}_share" for c, x in features.SOURCE_NAMES.items())
    + f", ({_n})::BIGINT AS source_count, coalesce(least({', '.join(f'nullif({c}_r, 0)' for c in SRC)}), 1000000)::DOUBLE AS source_rank_best, "
    + sql_of({
        "source_rank_mean": f"CASE WHEN {_n} > 0 THEN ({_sum})::DOUBLE / ({_n}) ELSE 0 END",
        "source_rank_std": f"CASE WHEN {_n} > 0 THEN sqrt(greatest(0, ({_sq})::DOUBLE / ({_n}) - (({_sum})::DOUBLE / ({_n})) * (({_sum})::DOUBLE / ({_n})))) ELSE 0 END",
        "source_score_max": f"greatest({', '.join(f'{c}_h' for c in SRC)})", "source_score_mean": _mean,
        "source_score_std": "sqrt((" + " + ".join(f"({c}_h - {_mean}) * ({c}_h - {_mean})" for c in SRC) + ") / 5)",
    } | {f"source_{a}_{b}_{k}": e.format(a=f"{a}_h", b=f"{b}_h") for a, b in (("time", "cart"), ("time", "order"), ("cart", "order")) for k, e in (("product", "{a} * {b}"), ("difference", "{a} - {b}"), ("ratio", "{a} / (0.01::DOUBLE + {b})"))})
    + " FROM sh_"
).replace(", 9) AS", ", 6) AS").replace(", 9) + 0 AS", ", 6) + 0 AS")
KINDS = {"all": "true", "clicks": "event_type = 0", "carts": "event_type = 1", "orders": "event_type = 2"}


@add("feat_source", SOURCE_SQL)
def _(s: Steps) -> DataFrame:
    rows = features.source_features(s.cand)
    return rounded(rows.select("session", "aid", *[c for c in rows.columns if c.startswith("source_")]), 6)


@add("feat_context", "SELECT session, count(*) AS query_events, count(DISTINCT aid) AS query_unique, " + sql_of({
    "query_duration_hours": "(max(ts) - min(ts)) / 3600000::DOUBLE", "query_repeat_share": "1 - count(DISTINCT aid) / count(*)::DOUBLE",
    "query_hour_sin": "sin(2 * pi() * ((max(ts) / 3600000::DOUBLE) % 24) / 24)", "query_hour_cos": "cos(2 * pi() * ((max(ts) / 3600000::DOUBLE) % 24) / 24)",
    "query_weekday_sin": "sin(2 * pi() * ((max(ts) / 86400000::DOUBLE + 3) % 7) / 7)", "query_weekday_cos": "cos(2 * pi() * ((max(ts) / 86400000::DOUBLE + 3) % 7) / 7)",
    "query_gap_mean": "coalesce(avg(gap), 0)", "query_gap_std": "coalesce(stddev_pop(gap), 0)", "query_gap_max": "coalesce(max(gap), 0)", "query_gap_median": "coalesce(median(gap), 0)",
}) + ", " + ", ".join(f"count(*) FILTER ({k}) AS query_{a}_count, round(count(*) FILTER ({k}) / count(*)::DOUBLE, 9) AS query_{a}_share, round(coalesce((max(ts) - max(ts) FILTER ({k})) / 3600000::DOUBLE, -1), 9) AS query_{a}_last_age_hours" for a, k in KINDS.items())
    + " FROM (SELECT *, (ts - lag(ts) OVER (PARTITION BY session ORDER BY event_index)) / 3600000::DOUBLE AS gap FROM pre_) GROUP BY 1")
def _(s: Steps) -> DataFrame:
    return rounded(features.context_features(s.pre))


H8 = ("all", *[f"h{x}" for x in graph.HORIZONS])
HISTORY_SQL = (
    "SELECT c.session, c.aid, " + ", ".join(f"coalesce(hist_{a}_{h}, 0) AS hist_{a}_{h}" for a in KINDS for h in H8) + ", (history_last_ts IS NOT NULL)::BIGINT AS history_known, "
    + sql_of(
        {f"hist_{a}_{h}_share": f"coalesce(hist_{a}_{h}, 0) / (1::DOUBLE + coalesce(hist_{a}_all, 0))" for a in KINDS for h in H8[1:]}
        | {f"hist_{a}_trend_h{x}_h{y}": f"coalesce(hist_{a}_h{x}, 0) / (1::DOUBLE + coalesce(hist_{a}_h{y}, 0)) * ({y}::DOUBLE / {x})" for a in KINDS for x, y in ((1, 6), (6, 24), (24, 72), (72, 168), (168, 336))}
        | {f"hist_{a}_per_click_{h}": f"coalesce(hist_{a}_{h}, 0) / (1::DOUBLE + coalesce(hist_clicks_{h}, 0))" for a in ("carts", "orders") for h in H8}
        | {"history_last_age_hours": "coalesce((query_ts - history_last_ts) / 3600000::DOUBLE, -1)", "history_lifetime_hours": "coalesce((history_last_ts - history_first_ts) / 3600000::DOUBLE, 0)"}
    )
    + " FROM cand_ c JOIN (SELECT session, max(ts) AS query_ts FROM pre_ GROUP BY 1) q USING (session) LEFT JOIN stats_ s USING (aid)"
)


def items(s: Steps, cand: DataFrame | None = None, pre: DataFrame | None = None) -> DataFrame:
    """Candidates with the time of their query."""
    now = (pre if pre is not None else s.pre).groupBy("session").agg(F.max("ts").alias("query_ts"))
    return (cand if cand is not None else s.cand).select("session", "aid").join(now, "session")


@add("feat_history", HISTORY_SQL)
def _(s: Steps) -> DataFrame:
    rows = features.history_features(items(s), s.stats)
    return rounded(rows.select("session", "aid", *[c for c in rows.columns if c.startswith("hist") and c not in ("history_first_ts", "history_last_ts")]))


REPEAT_N = features.LENGTHS
_hit = lambda k, n: f"{k} AND p.pos <= {n}"
REPEAT_SQL = (
    ", now_ AS (SELECT session, max(ts) AS now, " + ", ".join(f"count(*) FILTER ({k} AND pos <= {n}) AS t_{a}_{n}" for a, k in KINDS.items() for n in REPEAT_N) + " FROM pre_ GROUP BY 1) SELECT c.session, c.aid, "
    + ", ".join(
        f"count(p.pos) FILTER ({_hit(k, n)}) AS repeat_{a}_n{n}_count, round(count(p.pos) FILTER ({_hit(k, n)}) / greatest(1, any_value(t_{a}_{n}))::DOUBLE, 9) AS repeat_{a}_n{n}_share, "
        f"coalesce(min(p.pos) FILTER ({_hit(k, n)}), -1) AS repeat_{a}_n{n}_last_position, coalesce(max(p.pos) FILTER ({_hit(k, n)}), -1) AS repeat_{a}_n{n}_first_position, "
        f"coalesce(max(p.pos) FILTER ({_hit(k, n)}) - min(p.pos) FILTER ({_hit(k, n)}), 0) AS repeat_{a}_n{n}_span, round(coalesce(min((now - p.ts) / 3600000::DOUBLE) FILTER ({_hit(k, n)}), -1), 9) AS repeat_{a}_n{n}_age_hours"
        for a, k in KINDS.items() for n in REPEAT_N
    ) + ", " + ", ".join(f"round(coalesce(sum(exp(-((now - p.ts) / 3600000::DOUBLE) / {h})) FILTER ({k}), 0), 9) AS repeat_{a}_h{h}_decay" for a, k in KINDS.items() for h in (1, 6, 24, 72))
    + " FROM cand_ c JOIN now_ USING (session) LEFT JOIN pre_ p ON p.session = c.session AND p.aid = c.aid GROUP BY 1, 2"
)


@add("feat_repeat", REPEAT_SQL)
def _(s: Steps) -> DataFrame:
    return rounded(features.repeat_features(s.cand, s.pre, REPEAT_N).drop("repeats"))


CONTEXT_SHARES = ", cx_ AS (SELECT session, " + ", ".join(f"count(*) FILTER ({KINDS[a]}) / count(*)::DOUBLE AS {a}_x" for a in ("clicks", "carts", "orders")) + " FROM pre_ GROUP BY 1), rp_ AS (SELECT session, aid, count(*) AS reps FROM pre_ GROUP BY 1, 2)"
INTERACTIONS = {f"intent_{c}_{a}": f"{c}_h * {a}_x" for c in graph.CHANNELS for a in ("clicks", "carts", "orders")} | {
    f"intent_repeat_{a}": f"coalesce(reps, 0) * coalesce(hist_{a}_all, 0) / (1::DOUBLE + coalesce(hist_clicks_all, 0))" for a in ("carts", "orders")
}


@add("feat_interaction", SHARES + CONTEXT_SHARES + f" SELECT session, aid, {sql_of(INTERACTIONS)} FROM sh_ JOIN cx_ USING (session) LEFT JOIN rp_ USING (session, aid) LEFT JOIN stats_ USING (aid)")
def _(s: Steps) -> DataFrame:
    return rounded(interaction(s, s.cand, s.pre))


def interaction(s: Steps, cand: DataFrame, pre: DataFrame) -> DataFrame:
    hist = features.history_features(items(s, cand, pre), s.stats).select("session", "aid", "hist_carts_all", "hist_orders_all", "hist_clicks_all")
    return features.interaction_features(features.source_features(cand), features.context_features(pre), features.repeat_features(cand, pre, (50,)), hist)


GRAPH_NAMES = [("time", "all", 3, "uniform"), ("cart", "carts", 10, "position"), ("order", "all", 50, "six_hours"), ("time", "clicks", 5, "hour")]
_W = {"uniform": "1::DOUBLE", "position": "1 / sqrt(pos::DOUBLE)", "six_hours": "exp(-((now - ts) / 3600000::DOUBLE) / 6)", "hour": "exp(-((now - ts) / 3600000::DOUBLE))"}
_UNIT = {"time": "1e9::DOUBLE", "cart": "2e10::DOUBLE", "order": "2e10::DOUBLE"}


def _graph_sql(c: str, a: str, n: int, w: str) -> tuple[str, str]:
    """Missing edges as explicit zeros: every prefix event meets every candidate, so this is another formulation than ours."""
    key = f"{c}_{a}_n{n}_{w}"
    on = f"FILTER ({KINDS[a]} AND pos <= {n})"
    v, x = f"(coalesce({c}_w, 0) / {_UNIT[c]})", _W[w]
    inner = f"sum({v} * {x}) {on} AS s_{key}, sum({v} * {v} * {x}) {on} AS q_{key}, max({v} * {x}) {on} AS x_{key}, sum({x}) {on} AS m_{key}"
    mass = f"greatest(coalesce(m_{key}, 0), 1e-12)"
    outer = sql_of({f"graph_{key}_sum": f"coalesce(s_{key}, 0)", f"graph_{key}_max": f"coalesce(x_{key}, 0)", f"graph_{key}_mean": f"coalesce(s_{key}, 0) / {mass}", f"graph_{key}_std": f"sqrt(greatest(0, coalesce(q_{key}, 0) / {mass} - (coalesce(s_{key}, 0) / {mass}) * (coalesce(s_{key}, 0) / {mass})))"}, 6)
    return inner, outer


_parts = [_graph_sql(*x) for x in GRAPH_NAMES]
GRAPH_SQL = (
    "SELECT session, aid, " + ", ".join(o for _, o in _parts) + " FROM (SELECT c.session, c.aid, " + ", ".join(i for i, _ in _parts)
    + " FROM cand_ c JOIN (SELECT *, max(ts) OVER (PARTITION BY session) AS now FROM pre_) p ON p.session = c.session LEFT JOIN graph_ g ON g.source_aid = p.aid AND g.target_aid = c.aid GROUP BY 1, 2)"
)


@add("feat_graph", GRAPH_SQL)
def _(s: Steps) -> DataFrame:
    return rounded(features.graph_features(s.cand, s.pre, graph.scaled(s.edges), GRAPH_NAMES), 6)


_core_hits = {a: f"count(p.pos) FILTER ({_hit(k, 50)})" for a, k in KINDS.items()}
CORE_SQL = (
    SHARES + ", qx_ AS (SELECT session, max(ts) AS now, count(*) AS query_events, count(DISTINCT aid) AS query_unique, round((max(ts) - min(ts)) / 3600000::DOUBLE, 6) AS query_duration_hours, "
    "round(1 - count(DISTINCT aid) / count(*)::DOUBLE, 6) AS query_repeat_share, " + ", ".join(f"round(count(*) FILTER ({KINDS[a]}) / count(*)::DOUBLE, 6) AS query_{a}_share" for a in features.BUYING)
    + " FROM pre_ GROUP BY 1), rx_ AS (SELECT c.session, c.aid, " + ", ".join(f"{h} AS repeat_{a}_n50_count" for a, h in _core_hits.items())
    + f", coalesce(min(p.pos) FILTER ({_hit('true', 50)}), -1) AS repeat_all_n50_last_position, round(coalesce(min((now - p.ts) / 3600000::DOUBLE) FILTER ({_hit('true', 50)}), -1), 6) AS repeat_all_n50_age_hours"
    " FROM cand_ c JOIN qx_ USING (session) LEFT JOIN pre_ p ON p.session = c.session AND p.aid = c.aid GROUP BY 1, 2) SELECT session, aid, "
    + ", ".join(f"round({c}_s / 1e9::DOUBLE, 6) AS source_{x}_score, {c}_r AS source_{x}_rank, round({c}_h, 6) AS source_{x}_share" for c, x in features.SOURCE_NAMES.items())
    + f", ({_n})::BIGINT AS source_count, " + ", ".join(n for n in features.CORE if not n.startswith("source_")) + " FROM sh_ JOIN qx_ USING (session) JOIN rx_ USING (session, aid)"
)


@add("core_feature_rows", CORE_SQL)
def _(s: Steps) -> DataFrame:
    rows = features.source_features(s.cand).join(features.context_features(s.pre), "session").join(features.repeat_features(s.cand, s.pre, (50,)), ["session", "aid"])
    return rounded(features.finite(rows, list(features.CORE)).select("session", "aid", *features.CORE), 6)


@add("feature_catalog")
def _(s: Steps) -> DataFrame:
    """Rows only: 1,482 features as data."""
    return s.spark.createDataFrame(features.catalog(), "name string, family string, definition string, availability string, dtype string")


#: Features that screening, rankers and studies of the registered queries look at, by family: the protected ones and some more of each.
STUDIED = {
    "source": [n for n in features.CORE if n.startswith("source_")] + ["source_rank_best", "source_rank_mean", "source_score_max", "source_time_cart_product"],
    "context": [n for n in features.CORE if n.startswith("query_")] + ["query_hour_sin", "query_hour_cos", "query_gap_mean", "query_clicks_last_age_hours"],
    "history": ["hist_all_all", "hist_clicks_h24", "hist_carts_h72", "hist_orders_h168", "hist_all_h24_share", "hist_clicks_trend_h1_h6", "hist_carts_per_click_all", "hist_orders_per_click_all", "history_known", "history_last_age_hours"],
    "repeat": [n for n in features.CORE if n.startswith("repeat_")] + ["repeat_all_n5_share", "repeat_all_h6_decay"],
    "interaction": [f"intent_{c}_{a}" for c in graph.CHANNELS for a in ("clicks", "carts", "orders")] + ["intent_repeat_carts", "intent_repeat_orders"],
    "graph": [f"graph_{c}_{a}_n{n}_{w}_{k}" for c, a, n, w in GRAPH_NAMES for k in features.STATISTICS],
}
ALL = [n for names in STUDIED.values() for n in names]
TARGETS = [f"target_{o}" for o in metrics.WEIGHTS]
ROLES = ("fit", "selection", "evaluation")


def unwritten(s: Steps, role: str) -> DataFrame:
    """Candidates of a role with their targets and the studied features of all six families, session by session."""
    return studied.matrix(s.candidates_of(role), s.role(role), graph.scaled(s.edges), s.stats, s.labels_of(role), ALL, GRAPH_NAMES)


def matrix(s: Steps, role: str) -> DataFrame:
    """The same, written once; for roles of a budget. Of the evaluation, which has none, only what the models make of the rows is written."""
    return s._kept(f"matrix-{role}{s.ending}", lambda: unwritten(s, role))


_LONG = CORE_SQL.replace(" SELECT session, aid, " + f"round({SRC[0]}_s", f", core_ AS (SELECT session, aid, round({SRC[0]}_s") + "), lg_ AS (" + " UNION ALL ".join(
    f"SELECT '{f}' AS feature, {f}::DOUBLE AS value, target_clicks, target_carts, target_orders FROM core_ JOIN tgt_ USING (session, aid)" for f in features.CORE) + ") "


def screened(s: Steps) -> DataFrame:
    """The protected features of the fit role as the SQL has them, with targets."""
    rows = matrix(s, "fit")
    return rounded(rows.select("session", "aid", *TARGETS, *features.CORE), 6)


@add("screen_quality", _LONG + "SELECT feature, sum(n)::BIGINT AS n, count(*) AS distinct_values, max(n) / sum(n)::DOUBLE AS mode_share, min(value) AS least, max(value) AS most FROM (SELECT feature, value, count(*) AS n FROM lg_ GROUP BY 1, 2) GROUP BY 1", role="fit")
def _(s: Steps) -> DataFrame:
    return screening.quality(screened(s), list(features.CORE))


@add("screen_correlations", _LONG + "SELECT feature, " + ", ".join(f"round(CASE WHEN min(value) < max(value) AND min(target_{o}) < max(target_{o}) THEN corr(value, target_{o}) ELSE 0 END, 6) + 0 AS rho_{o}" for o in metrics.WEIGHTS) + " FROM lg_ GROUP BY 1", role="fit")
def _(s: Steps) -> DataFrame:
    rows = screening.correlations(screened(s), list(features.CORE))
    return rows.select("feature", *[(F.round(f"rho_{o}", 6) + F.lit(0.0)).alias(f"rho_{o}") for o in metrics.WEIGHTS])


@add("screening_rejections")
def _(s: Steps) -> DataFrame:
    """Rows only: counts of statuses and families over the studied features and three planted ones."""
    rows = matrix(s, "fit").withColumns({"copy_of_time": F.col("source_time_score"), "constant_one": F.lit(1), "leak": F.col("target_orders")})
    family = {n: k for k, names in STUDIED.items() for n in names}
    named = F.coalesce(F.create_map(*[F.lit(x) for kv in family.items() for x in kv])[F.col("feature")], F.lit("planted"))
    return screening.statuses(rows, [*ALL, "copy_of_time", "constant_one", "leak"]).groupBy("status", named.alias("family")).count()


def training(s: Steps) -> DataFrame:
    return candidates.training_sample(matrix(s, "fit"))


PILOTS = "objective string, fold long, feature string, gain double, log_loss double"


def pilots(s: Steps) -> list[tuple]:
    """(objective, fold, feature, share of gain, log-loss on the fold) of nine models, fitted once; folds by session hash."""
    return [tuple(r) for r in s._kept("pilots", lambda: s.spark.createDataFrame(_pilots(s), PILOTS)).collect()]


def _pilots(s: Steps) -> list[tuple]:
    rows = training(s).withColumn("fold", portable_hash(F.col("session"), F.lit("fold")) % 3)
    made = []
    for objective in metrics.WEIGHTS:
        for fold in range(3):
            model = screening.Pilot(ALL, objective).fit(rows.where(F.col("fold") != fold))
            loss = model.log_loss(rows.where(F.col("fold") == fold))
            made += [(objective, fold, f, g, loss) for f, g in model.importance().items()]
    return made


def utilities(found: list[tuple]) -> dict[str, float]:
    """Mean share of gain over folds, weighted over objectives."""
    out = dict.fromkeys(ALL, 0.0)
    for objective, _, f, gain, _ in found:
        out[f] += metrics.WEIGHTS[objective] * gain / 3
    return out


@add("screen_pilot_importance")
def _(s: Steps) -> DataFrame:
    """Rows only: nine grouped pilots, three folds for each objective, with the share of pilots in which a feature has any gain."""
    found = pilots(s)
    used = {f: sum(g > 0 for _, _, x, g, _ in found if x == f) / 9 for f in ALL}
    return s.spark.createDataFrame([(*r, used[r[2]]) for r in found], PILOTS + ", stability double")


@add("screen_retained")
def _(s: Steps) -> DataFrame:
    """Rows only: features left by the redundancy filter, in order; the protected ones always stay."""
    kept = screening.retained(matrix(s, "fit"), utilities(pilots(s)), list(features.CORE))
    return s.spark.createDataFrame(list(enumerate(kept)), "place long, feature string")
