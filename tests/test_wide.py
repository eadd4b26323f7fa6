"""The kernel of wide features against their expressions, and the cache of parts."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailmix.operators import features, graph, wide
from trailmix.plans import wide_queries
from trailmix.plans.base import Steps
from trailmix.sources import files
from trailmix.sources.parts import Parts

SMALL = "/root/testdata/sf0.001"


def close(a, b, name):
    """A deviation is a root of a difference, which turns a rounding of 1e-16 into 1e-8."""
    return a == b or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-6 if name.endswith("_std") else 1e-9)


def same(got, wanted, names, pick):
    mine = {(r["session"], r["aid"]): r for r in got}
    assert len(mine) == len(wanted) > 0
    for r in wanted:
        values = mine[r["session"], r["aid"]]
        for i, n in enumerate(names):
            assert close(pick(values, i, n), float(r[n]), n), (r["session"], r["aid"], n, pick(values, i, n), r[n])


def test_kernel_equals_the_expressions(spark):
    s = Steps(spark, SMALL)
    edges = graph.scaled(s.edges)
    got = wide.kernel(s.cand.select("session", "aid"), s.pre, edges).collect()
    for a in range(0, len(features.GRAPH), 24):
        names = features.GRAPH[a : a + 24]
        wanted = features.graph_features(s.cand, s.pre, edges, names).collect()
        same(got, wanted, [f"graph_{c}_{x}_n{n}_{w}_{k}" for c, x, n, w in names for k in features.STATISTICS], lambda r, i, n, a=a: r["graph"][4 * a + i])
    wanted = features.repeat_features(s.cand, s.pre).collect()
    same(got, wanted, wide.REPEAT_NAMES, lambda r, i, n: r["repeat"][i])
    same(got, wanted, ["repeats"], lambda r, i, n: r["repeats"])


def test_kernel_of_long_prefixes(spark):
    random = np.random.default_rng(6)
    prefix, cand, ts = [], [], 0
    for session, n in ((1, 130), (2, 1), (3, 51), (4, 6)):
        items = random.integers(1, 9, n)
        times = np.sort(random.integers(0, 10**8, n))
        prefix += [(session, int(a), int(t), int(random.integers(0, 3)), k, n - k) for k, (a, t) in enumerate(zip(items, times, strict=True))]
        cand += [(session, a) for a in range(1, 12)]
    prefix = spark.createDataFrame(prefix, "session long, aid long, ts long, event_type long, event_index long, pos long").repartition(3)
    cand = spark.createDataFrame(cand, "session long, aid long")
    edges = [(int(a), int(b), *map(float, random.random(3) * 9)) for a in range(1, 9) for b in range(1, 12) if a != b and random.random() < 0.5]
    edges = spark.createDataFrame(edges, "source_aid long, target_aid long, time_score double, cart_score double, order_score double")
    got = wide.kernel(cand, prefix, edges).collect()
    names = features.GRAPH[5::11]
    at = {n: i for i, n in enumerate(wide.GRAPH_NAMES)}
    wanted = features.graph_features(cand, prefix, edges, names).collect()
    same(got, wanted, [f"graph_{c}_{x}_n{n}_{w}_{k}" for c, x, n, w in names for k in features.STATISTICS], lambda r, i, n: r["graph"][at[n]])
    same(got, features.repeat_features(cand, prefix).collect(), wide.REPEAT_NAMES, lambda r, i, n: r["repeat"][i])


def test_the_whole_matrix_comes_in_parts_once(spark, tmp_path):
    s = Steps(spark, SMALL)
    parts, written = wide_queries.cached(s, "selection", str(tmp_path), sessions_per_part=3, each=2)
    assert written == parts.total > 2
    rows = parts.read().drop("part")
    names = [r[0] for r in features.catalog()]
    assert names == wide.names() and len(names) == 1482 and set(names) <= set(rows.columns)
    assert rows.count() == s.candidates_of("selection").count()
    again, written = wide_queries.cached(s, "selection", str(tmp_path), sessions_per_part=3, each=2)
    assert written == 0 and again.log == parts.log
    # a part that is lost from the log is made anew, what is left of it goes first
    key = sorted(parts.log["rows"])[1]
    del again.log["rows"][key]
    again._commit()
    third, written = wide_queries.cached(s, "selection", str(tmp_path), sessions_per_part=3, each=2)
    assert written == 1 and third.log == parts.log
    core = features.source_features(s.candidates_of("selection")).join(features.context_features(s.role("selection")), "session").collect()
    same(third.read().drop("part").collect(), core, [n for n in names if n.startswith(("source_", "query_"))], lambda r, i, n: r[n])
    with pytest.raises(ValueError, match="another contract"):
        wide_queries.cached(s, "selection", str(tmp_path), sessions_per_part=9)


def test_parts_are_compared_with_their_log(spark, tmp_path):
    folder = str(tmp_path / "t")
    rows = spark.range(100).withColumn("part", (F.col("id") % 4).cast("int"))
    made = Parts(spark, folder, "c", 5)
    assert made.write(lambda some: rows.where(F.col("part").isin(some)), 2, ("id",)) == 5 and made.log["rows"]["4"] == 0
    assert made.read().count() == 100
    at, system = files.file_system(spark, f"{folder}/part=9")
    system.mkdirs(at)
    Parts(spark, folder, "c", 5)
    assert "part=9" not in files.names(spark, folder)
    at, system = files.file_system(spark, f"{folder}/part=1")
    system.delete(at, True)
    with pytest.raises(RuntimeError, match="missing"):
        Parts(spark, folder, "c", 5)
    at, system = files.file_system(spark, f"{folder}/_parts.json")
    system.delete(at, False)
    with pytest.raises(RuntimeError, match="without a log"):
        Parts(spark, folder, "c", 5)


def test_candidates_without_events_are_refused(spark):
    cand = spark.createDataFrame([(1, 5)], "session long, aid long")
    prefix = spark.createDataFrame([], "session long, aid long, ts long, event_type long, event_index long, pos long")
    edges = spark.createDataFrame([], "source_aid long, target_aid long, time_score double, cart_score double, order_score double")
    with pytest.raises(Exception, match="without events"):
        wide.kernel(cand, prefix, edges).collect()
    assert wide.kernel(cand.where("aid = 6"), prefix, edges).collect() == []
