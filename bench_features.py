"""Time of the feature kernel per session on $BENCH_SF_DIR: p50 and p95 in milliseconds, one warm process; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

import numpy as np
from pyspark.sql import functions as F

from trailmix.operators import graph, replay, wide
from trailmix.operators.features import ACTIONS
from trailmix.operators.graph import HOUR
from trailmix.plans.base import Steps
from trailmix.session import local_session

SESSIONS, REPEATS = 64, 3


def inputs(s: Steps) -> list[tuple]:
    """(candidates, items, times, actions of the prefix from the newest, edges met) of some sessions of least hash."""
    chosen = F.broadcast(replay.chosen(s.pre, SESSIONS))
    cand, pre = s.cand.join(chosen, "session", "left_semi"), s.pre.join(chosen, "session", "left_semi")
    near = pre.where(F.col("pos") <= wide.DEPTH).select("session", "pos", F.col("aid").alias("source_aid")).join(graph.scaled(s.edges), "source_aid")
    near = near.withColumnRenamed("target_aid", "aid").join(cand.select("session", "aid"), ["session", "aid"], "left_semi").toPandas()
    cand, pre, out = cand.select("session", "aid").toPandas(), pre.toPandas(), []
    for session, own in cand.groupby("session"):
        items = np.sort(own["aid"].to_numpy())
        seen, met = pre[pre["session"] == session].sort_values("pos"), near[near["session"] == session]
        edges = np.searchsorted(items, met["aid"]), met["pos"].to_numpy(), met[[f"{c}_score" for c in graph.CHANNELS]].to_numpy()
        out.append((items, seen["aid"].to_numpy(), seen["ts"].to_numpy(), seen["event_type"].to_numpy(), edges))
    return out


def timed(run, rows: list[tuple]) -> dict[str, float]:
    taken = []
    for repeat in range(REPEATS):
        for row in rows:
            began = time.perf_counter()
            run(*row)
            if repeat:  # the first turn warms up
                taken.append(1000 * (time.perf_counter() - began))
    return {"measured": len(taken), "p50_ms": round(float(np.median(taken)), 3), "p95_ms": round(float(np.quantile(taken, 0.95)), 3)}


def repeats_only(items, aid, ts, kind, _met):
    masks = np.stack([np.ones(len(aid), bool) if k is None else kind == k for k in ACTIONS.values()])
    return wide.repeat_values(items, aid, (ts.max() - ts) / float(HOUR), masks)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")), "bench-features")
    spark.sparkContext.setLogLevel("ERROR")
    rows = inputs(Steps(spark, sf_dir))
    modes = {"repeat_and_graph_1312": wide.session_values, "repeat_160": repeats_only}
    print(json.dumps({"metric": "feature_kernel", "sf": sf_dir.rsplit("sf", 1)[-1], "sessions": len(rows), "modes": {name: timed(run, rows) for name, run in modes.items()}}))


if __name__ == "__main__":
    main()
