"""Replay of single sessions from prefix to recommendations, written a second time over plain arrays, to audit the plans."""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trailmix.canon import portable_hash
from trailmix.operators.candidates import BUDGET, FUSED, FUSION, OBJECTIVES, POPULAR_WEIGHTS, SEEDS, TOP
from trailmix.operators.graph import UNIT
from trailmix.session import shipped


def half_up(x: float) -> int:
    return math.floor(x + 0.5)


def replayed(seen: list[tuple[int, int]], edges: list[tuple[int, int, int, int, int]], popular: dict[str, list[int]]) -> dict[str, list[int]]:
    """Items by objective for one prefix: ``seen`` as (position from the newest, item), ``edges`` as (position, target, three weights)."""
    evidence: dict[int, list[int]] = defaultdict(lambda: [0] * 5)
    for position, target, *weights in edges:
        if position <= SEEDS:
            for k, w in enumerate(weights):
                evidence[target][k] += half_up(w / math.sqrt(position))
    newest: dict[int, int] = {}
    for position, item in seen:
        evidence[item][3] += half_up(UNIT / math.sqrt(position))
        newest[item] = min(position, newest.get(item, position))
    for action, items in popular.items():
        for place, item in enumerate(items, 1):
            evidence[item][4] += half_up(POPULAR_WEIGHTS[action] * UNIT / place)
    ranks: dict[int, list[int]] = {item: [0] * 5 for item in evidence}
    for k in range(5):
        for place, item in enumerate(sorted((i for i, e in evidence.items() if e[k] > 0), key=lambda i: (-evidence[i][k], i)), 1):
            ranks[item][k] = place
    fused = lambda item, weights: sum(half_up(w * FUSED / (20 + r)) for w, r in zip(weights, ranks[item], strict=True) if r)
    pool = sorted(newest, key=newest.get) + sorted((i for i in evidence if i not in newest), key=lambda i: (-fused(i, FUSION), i))
    pool = pool[:BUDGET]
    return {o: sorted(pool, key=lambda i: (-fused(i, w), i))[:TOP] for o, w in OBJECTIVES.items()}


def chosen(prefix: DataFrame, count: int = 256) -> DataFrame:
    """The ``count`` sessions of least hash."""
    sessions = prefix.select("session").distinct()
    return sessions.orderBy(portable_hash(F.col("session"), F.lit("replay")), "session").limit(count)


def replay(prefix: DataFrame, edges: DataFrame, popular: DataFrame, count: int = 256) -> DataFrame:
    """(session_type, labels) of the chosen sessions. Their prefixes and the edges from them are all that is read for a session; the popular lists are three bounded ones."""
    shipped(prefix.sparkSession)
    mine = prefix.join(F.broadcast(chosen(prefix, count)), "session", "left_semi")
    seen = mine.groupBy("session").agg(F.collect_list(F.struct("pos", "aid")).alias("seen"))
    near = mine.where(F.col("pos") <= SEEDS).select("session", "pos", F.col("aid").alias("source_aid")).join(edges, "source_aid")
    near = near.groupBy("session").agg(F.collect_list(F.struct("pos", "target_aid", "time_w", "cart_w", "order_w")).alias("edges"))
    lists: dict[str, list[int]] = defaultdict(list)
    for r in popular.orderBy("action", "list_rank").collect():
        lists[r["action"]].append(r["aid"])
    popular_items = dict(lists)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for session, own, met in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = replayed([(r["pos"], r["aid"]) for r in own], [tuple(r.values()) for r in met or []], popular_items)
                out += [(f"{session}_{o}", " ".join(map(str, items))) for o, items in found.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.string()) for i in range(2)], names=["session_type", "labels"])

    return seen.join(near, "session", "left").mapInArrow(run, "session_type string, labels string")


def differences(found: DataFrame, submission: DataFrame) -> DataFrame:
    """(session_type, replayed, submitted) where the two disagree; rows of sessions that were not replayed are left out."""
    mine = found.withColumnRenamed("labels", "replayed")
    rows = mine.join(submission.withColumnRenamed("labels", "submitted"), "session_type", "left")
    return rows.where(~F.col("replayed").eqNullSafe(F.col("submitted")))
