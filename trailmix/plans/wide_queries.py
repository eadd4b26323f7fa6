"""Queries of the whole feature matrix and of its cache in parts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmix.canon import portable_hash
from trailmix.operators import candidates, features, graph, sealing, wide
from trailmix.plans.base import Steps, prelude
from trailmix.plans.feature_queries import _graph_sql
from trailmix.plans.study_queries import lineage
from trailmix.sources import files
from trailmix.sources.parts import Parts

QUERIES: dict[str, object] = {}
ORACLES: dict[str, str] = {}


def add(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = lambda spark, sf_dir: f(Steps(spark, sf_dir))
        if sql:
            ORACLES[name] = prelude() + sql
        return f

    return register


#: Added before rounding on both sides: sums of scores are multiples of 5e-11, of which none falls on a middle of two sixth digits then.
NUDGE = 3.33e-10


def _wide_sql() -> str:
    inner, outer = [], []
    for c, a, n, w in features.GRAPH:
        key = f"{c}_{a}_n{n}_{w}"
        mass, total = f"greatest(coalesce(m_{key}, 0), 1e-12)", f"coalesce(s_{key}, 0)"
        values = {"sum": total, "mean": f"{total} / {mass}", "max": f"coalesce(x_{key}, 0)", "std": f"sqrt(greatest(0, coalesce(q_{key}, 0) / {mass} - ({total} / {mass}) * ({total} / {mass})))"}
        inner.append(_graph_sql(c, a, n, w)[0])
        outer += [f"round({v} + 3.33e-10::DOUBLE, 5) AS graph_{key}_{k}" for k, v in values.items()]
    return (
        "SELECT session, aid, " + ", ".join(outer) + " FROM (SELECT c.session, c.aid, " + ", ".join(inner)
        + " FROM cand_ c JOIN (SELECT *, max(ts) OVER (PARTITION BY session) AS now FROM pre_) p ON p.session = c.session LEFT JOIN graph_ g ON g.source_aid = p.aid AND g.target_aid = c.aid GROUP BY 1, 2)"
    )


@add("feat_graph_wide", _wide_sql())
def _(s: Steps) -> DataFrame:
    """All 1,152 graph features, by the kernel."""
    return wide.graph_columns(s.cand.select("session", "aid"), s.pre, graph.scaled(s.edges), 5, NUDGE)


def wide_rows(s: Steps, role: str, sessions: DataFrame | None = None) -> DataFrame:
    """All features and targets of a role's candidates, or of those of some sessions; inputs are cut to them before the kernel."""
    cand, pre = s.candidates_of(role), s.role(role)
    if sessions is not None:
        cand, pre = cand.join(sessions, "session", "left_semi"), pre.join(sessions, "session", "left_semi")
    return candidates.with_targets(wide.matrix(cand, pre, graph.scaled(s.edges), s.stats), s.labels_of(role))


def cached(s: Steps, role: str, folder: str, sessions_per_part: int = 256, each: int = 64) -> tuple[Parts, int]:
    """The matrix of a role as parts of some ``sessions_per_part`` sessions, by a hash of them, and how many parts this call wrote."""
    sessions = s.candidates_of(role).select("session").distinct()
    total = max(1, -(-sessions.count() // sessions_per_part))
    contract = sealing.canonical({"data": lineage(s), "role": role, "features": wide.names(), "budget": candidates.BUDGET, "sessions_per_part": sessions_per_part})
    parts = Parts(s.spark, f"{folder}/{role}", contract, total)
    part = (portable_hash(F.col("session"), F.lit("part")) % total).cast("int")

    def rows_of(some: list[int]) -> DataFrame:
        mine = sessions.where(part.isin(some)) if len(some) < total else None
        return wide_rows(s, role, mine).withColumn("part", part)

    return parts, parts.write(rows_of, each, ("session", "candidate_position"))


#: Caches already made, by application and table.
_caches: dict[tuple, str] = {}


@add("wide_matrix")
def _(s: Steps) -> DataFrame:
    """Rows only: all 1,482 features of the selection role's candidates, from a cache of parts."""
    key = (s.spark.sparkContext.applicationId, s.dir, *lineage(s).values())
    if key not in _caches:
        _caches[key] = f"{files.scratch(s.spark)}/wide-{sealing.canonical(list(key))[:16]}"
        at, system = files.file_system(s.spark, _caches[key])
        system.mkdirs(at)
        system.deleteOnExit(at)
    parts, _ = cached(s, "selection", _caches[key])
    return parts.read().drop("part")
