"""Feature families of (session, candidate) rows, each a table of name to expression; the catalogue is read off these tables.

Only requested graph features are built; sums are shared among them. Names of features are fixed values of the interface.
"""

from __future__ import annotations

import itertools
import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmix.canon import DAY
from trailmix.operators.candidates import SOURCES
from trailmix.operators.graph import CHANNELS, HORIZONS, HOUR, UNIT

LENGTHS = (1, 3, 5, 10, 20, 50)
ACTIONS = {"all": None, "clicks": 0, "carts": 1, "orders": 2}
BUYING = ("carts", "orders")
WEIGHTS = ("uniform", "position", "hour", "six_hours")
STATISTICS = ("sum", "mean", "max", "std")
DECAYS = (1, 6, 24, 72)
TRENDS = tuple(itertools.pairwise((1, 6, 24, 72, 168, 336)))
#: Columns of the candidates are named by these, features by the names on the right.
SOURCE_NAMES = dict(zip(SOURCES, ("time", "cart", "order", "revisit", "popularity"), strict=True))
NO_RANK = 1e6
#: The 28 features that screening never drops; fixed values.
CORE = (
    "source_time_score", "source_time_rank", "source_time_share", "source_cart_score", "source_cart_rank", "source_cart_share",
    "source_order_score", "source_order_rank", "source_order_share", "source_revisit_score", "source_revisit_rank", "source_revisit_share",
    "source_popularity_score", "source_popularity_rank", "source_popularity_share", "source_count",
    "query_events", "query_unique", "query_duration_hours", "query_repeat_share", "query_carts_share", "query_orders_share",
    "repeat_all_n50_count", "repeat_all_n50_last_position", "repeat_all_n50_age_hours",
    "repeat_clicks_n50_count", "repeat_carts_n50_count", "repeat_orders_n50_count",
)


def _of(action: str) -> Column:
    return F.lit(True) if ACTIONS[action] is None else F.col("event_type") == ACTIONS[action]


def _hours(ms: Column) -> Column:
    return ms / F.lit(float(HOUR))


def _sum(columns) -> Column:
    return reduce(lambda a, b: a + b, columns)


def _single() -> dict[str, Column]:
    """Score, rank, presence and pool-relative share of each source; a pool without the source has share 0."""
    out = {}
    for c, name in SOURCE_NAMES.items():
        top = F.max(f"{c}_s").over(Window.partitionBy("session"))
        out[f"source_{name}_score"] = F.col(f"{c}_s") / F.lit(float(UNIT))
        out[f"source_{name}_rank"] = F.col(f"{c}_r")
        out[f"source_{name}_present"] = (F.col(f"{c}_r") > 0).cast("bigint")
        out[f"source_{name}_share"] = F.when(top > 0, F.col(f"{c}_s") / top).otherwise(0.0)
    return out


def _summaries() -> dict[str, Column]:
    """Over the five sources: how many, their ranks (0 on average without any), their shares, and pairs of graph shares."""
    held = [F.when(F.col(f"{c}_r") > 0, F.col(f"{c}_r").cast("double")) for c in SOURCES]
    n = _sum(F.col(f"source_{x}_present") for x in SOURCE_NAMES.values())
    some = F.greatest(n, F.lit(1))
    mean_rank = _sum(F.coalesce(r, F.lit(0.0)) for r in held) / some
    shares = [F.col(f"source_{x}_share") for x in SOURCE_NAMES.values()]
    mean_share = _sum(shares) / 5
    out = {
        "source_count": n, "source_rank_best": F.coalesce(F.least(*held), F.lit(NO_RANK)), "source_rank_mean": mean_rank,
        "source_rank_std": F.sqrt(F.greatest(F.lit(0.0), _sum(F.coalesce(r * r, F.lit(0.0)) for r in held) / some - mean_rank * mean_rank)),
        "source_score_max": F.greatest(*shares), "source_score_mean": mean_share, "source_score_std": F.sqrt(_sum((s - mean_share) * (s - mean_share) for s in shares) / 5),
    }
    for a, b in itertools.combinations(CHANNELS, 2):
        x, y = F.col(f"source_{a}_share"), F.col(f"source_{b}_share")
        out |= {f"source_{a}_{b}_product": x * y, f"source_{a}_{b}_difference": x - y, f"source_{a}_{b}_ratio": x / (y + 0.01)}
    return out


def source_features(candidates: DataFrame) -> DataFrame:
    """The five sources' evidence of each candidate, relative to the session's pool, its summaries and pairwise combinations."""
    return candidates.withColumns(_single()).withColumns(_summaries())


def _context() -> dict[str, Column]:
    """Aggregates of a prefix with the gap to the event before in ``_gap`` (hours)."""
    last, events, unique = F.max("ts"), F.count("*"), F.countDistinct("aid")
    out = {"query_events": events, "query_unique": unique, "query_duration_hours": _hours(last - F.min("ts")), "query_repeat_share": 1.0 - unique / events}
    turns = {"hour": (_hours(last) % 24, 24), "weekday": ((last / F.lit(float(DAY)) + 3) % 7, 7)}
    for name, (value, length) in turns.items():
        out |= {f"query_{name}_{f.__name__}": f(2 * math.pi * value / length) for f in (F.sin, F.cos)}
    for name, f in (("mean", F.avg), ("std", F.stddev_pop), ("max", F.max), ("median", F.median)):
        out[f"query_gap_{name}"] = F.coalesce(f("_gap"), F.lit(0.0))
    for a in ACTIONS:
        newest = F.max(F.when(_of(a), F.col("ts")))
        out |= {f"query_{a}_count": F.count_if(_of(a)), f"query_{a}_share": F.count_if(_of(a)) / events, f"query_{a}_last_age_hours": F.coalesce(_hours(last - newest), F.lit(-1.0))}
    return out


def context_features(prefix: DataFrame) -> DataFrame:
    """One row per session: size, span, clock, gaps and action mix of the prefix."""
    before = F.lag("ts").over(Window.partitionBy("session").orderBy("event_index"))
    return prefix.withColumn("_gap", _hours(F.col("ts") - before)).groupBy("session").agg(*[v.alias(k) for k, v in _context().items()])


SPANS = ("all", *[f"h{x}" for x in HORIZONS])


def _counts() -> list[str]:
    return [f"hist_{a}_{h}" for a in ACTIONS for h in SPANS]


def _history(now: str) -> dict[str, Column]:
    """Ratios, trends and ages from the counts; an unknown item has an age of -1."""
    over = lambda x, y: F.col(x) / (1.0 + F.col(y))
    out = {}
    for a in ACTIONS:
        out |= {f"hist_{a}_{h}_share": over(f"hist_{a}_{h}", f"hist_{a}_all") for h in SPANS[1:]}
        out |= {f"hist_{a}_trend_h{s}_h{t}": over(f"hist_{a}_h{s}", f"hist_{a}_h{t}") * (t / s) for s, t in TRENDS}
    out |= {f"hist_{a}_per_click_{h}": over(f"hist_{a}_{h}", f"hist_clicks_{h}") for a in BUYING for h in SPANS}
    known = F.col("history_last_ts").isNotNull()
    return out | {
        "history_known": known.cast("bigint"),
        "history_last_age_hours": F.when(known, _hours(F.col(now) - F.col("history_last_ts"))).otherwise(-1.0),
        "history_lifetime_hours": F.when(known, _hours(F.col("history_last_ts") - F.col("history_first_ts"))).otherwise(0.0),
    }


def history_features(items: DataFrame, stats: DataFrame, query_ts: str = "query_ts") -> DataFrame:
    """Counts, ratios, trends and ages of each candidate item; an unknown item has zero counts."""
    rows = items.join(stats, "aid", "left").withColumns({c: F.coalesce(c, F.lit(0)).cast("bigint") for c in _counts()})
    return rows.withColumns(_history(query_ts))


def _repeat(lengths: tuple[int, ...]) -> dict[str, Column]:
    """Aggregates over the events that a candidate has in the prefix: ``pos`` from 1 for the newest, ``_now``, and ``_t_`` totals."""
    age, met = _hours(F.col("_now") - F.col("ts")), F.col("pos").isNotNull()
    out = {}
    for a, n in itertools.product(ACTIONS, lengths):
        hit = met & _of(a) & (F.col("pos") <= n)
        place = F.when(hit, F.col("pos"))
        values = {
            "count": F.count_if(hit), "share": F.count_if(hit) / F.greatest(F.lit(1), F.max(f"_t_{a}_{n}")),
            "last_position": F.coalesce(F.min(place), F.lit(-1)).cast("bigint"), "first_position": F.coalesce(F.max(place), F.lit(-1)).cast("bigint"),
            "span": F.coalesce(F.max(place) - F.min(place), F.lit(0)).cast("bigint"), "age_hours": F.coalesce(F.min(F.when(hit, age)), F.lit(-1.0)),
        }
        out |= {f"repeat_{a}_n{n}_{k}": v for k, v in values.items()}
    for a, h in itertools.product(ACTIONS, DECAYS):
        out[f"repeat_{a}_h{h}_decay"] = F.coalesce(F.sum(F.when(met & _of(a), F.exp(-age / h))), F.lit(0.0))
    return out


def repeat_features(candidates: DataFrame, prefix: DataFrame, lengths: tuple[int, ...] = LENGTHS) -> DataFrame:
    """Occurrences of the candidate in its session, in all (``repeats``) and among the last events: one join, one aggregation for all lengths and actions."""
    totals = prefix.groupBy("session").agg(
        F.max("ts").alias("_now"), *[F.count_if(_of(a) & (F.col("pos") <= n)).alias(f"_t_{a}_{n}") for a in ACTIONS for n in lengths]
    )
    met = candidates.select("session", "aid").join(prefix.select("session", "aid", "pos", "ts", "event_type"), ["session", "aid"], "left").join(totals, "session")
    return met.groupBy("session", "aid").agg(F.count("pos").alias("repeats"), *[v.alias(k) for k, v in _repeat(lengths).items()])


def _interaction() -> dict[str, Column]:
    out = {f"intent_{c}_{a}": F.col(f"source_{c}_share") * F.col(f"query_{a}_share") for c in CHANNELS for a in ("clicks", *BUYING)}
    return out | {f"intent_repeat_{a}": F.col("repeats") * F.col(f"hist_{a}_all") / (1.0 + F.col("hist_clicks_all")) for a in BUYING}


def interaction_features(source: DataFrame, context: DataFrame, repeat: DataFrame, hist: DataFrame) -> DataFrame:
    """Graph evidence times the session's action mix, and all repeats of an item times its history of buying."""
    rows = source.join(context, "session").join(repeat, ["session", "aid"]).join(hist, ["session", "aid"])
    return rows.select("session", "aid", *[v.alias(k) for k, v in _interaction().items()])


def event_weight(kind: str) -> Column:
    age = _hours(F.col("_now") - F.col("ts"))
    return {"uniform": F.lit(1.0), "position": 1.0 / F.sqrt(F.col("pos").cast("double")), "hour": F.exp(-age), "six_hours": F.exp(-age / 6.0)}[kind]


#: Every (channel, action, length, weight) of a graph feature.
GRAPH = tuple(itertools.product(CHANNELS, ACTIONS, LENGTHS, WEIGHTS))


def graph_features(candidates: DataFrame, prefix: DataFrame, edges: DataFrame, names=GRAPH) -> DataFrame:
    """sum, max, mean and std for each requested (channel, action, length, weight).

    Edges that are missing count as zeros: the mass of weights is taken over the prefix, not over the edges met,
    and the maximum is never below zero. One join of candidates, prefix and edges serves all requested features.
    """
    now = prefix.withColumn("_now", F.max("ts").over(Window.partitionBy("session"))).where(F.col("pos") <= max(LENGTHS))
    masses = {(a, n, w) for _, a, n, w in names}
    mass = now.groupBy("session").agg(*[F.coalesce(F.sum(F.when(_of(a) & (F.col("pos") <= n), event_weight(w))), F.lit(0.0)).alias(f"_m_{a}_{n}_{w}") for a, n, w in sorted(masses)])
    met = now.withColumnRenamed("aid", "source_aid").join(edges.withColumnRenamed("target_aid", "aid"), "source_aid")
    met = met.join(candidates.select("session", "aid"), ["session", "aid"])
    sums: list[Column] = []
    for c, a, n, w in names:
        hit, v, x = _of(a) & (F.col("pos") <= n), F.col(f"{c}_score"), event_weight(w)
        key = f"{c}_{a}_n{n}_{w}"
        sums += [F.sum(F.when(hit, v * x)).alias(f"_s_{key}"), F.sum(F.when(hit, v * v * x)).alias(f"_q_{key}"), F.max(F.when(hit, v * x)).alias(f"_x_{key}")]
    summed = met.groupBy("session", "aid").agg(*sums)
    rows = candidates.select("session", "aid").join(mass, "session").join(summed, ["session", "aid"], "left")
    return rows.select("session", "aid", *[v.alias(k) for x in names for k, v in _graph(*x).items()])


def _graph(channel: str, action: str, length: int, weight: str) -> dict[str, Column]:
    key, zero = f"{channel}_{action}_n{length}_{weight}", F.lit(0.0)
    mass = F.greatest(F.col(f"_m_{action}_{length}_{weight}"), F.lit(1e-12))
    total, squares, most = (F.coalesce(F.col(f"_{k}_{key}"), zero) for k in "sqx")
    values = {"sum": total, "mean": total / mass, "max": F.greatest(most, zero), "std": F.sqrt(F.greatest(zero, squares / mass - (total / mass) * (total / mass)))}
    return {f"graph_{key}_{s}": values[s] for s in STATISTICS}


def finite(rows: DataFrame, names: list[str]) -> DataFrame:
    """``rows``; a null, infinite or undefined value among ``names`` fails the job."""
    value = lambda n: F.col(n).cast("double")
    bad = reduce(lambda a, b: a | b, [value(n).isNull() | F.isnan(value(n)) | (F.abs(value(n)) == F.lit(float("inf"))) for n in names])
    return rows.where(F.when(bad, F.raise_error(F.lit("feature matrix contains non-finite values")).cast("boolean")).otherwise(True))


def catalog() -> list[tuple[str, str, str, str, str]]:
    """(name, family, definition, availability, dtype) of every feature, from the tables above; a definition is the expression itself."""
    graph = {k: v for x in GRAPH for k, v in _graph(*x).items()}
    history = {c: F.coalesce(c, F.lit(0)) for c in _counts()} | _history("query_ts")
    families = {"source": _single() | _summaries(), "context": _context(), "history": history, "repeat": _repeat(LENGTHS), "graph": graph, "interaction": _interaction()}
    seen, past = "observed prefix", "fixed historical cutoff and observed prefix"
    available = {"context": seen, "repeat": seen}
    return [(name, family, str(v)[8:-2], available.get(family, past), "float32") for family, columns in families.items() for name, v in columns.items()]
