"""Refresh of the deployment state, replay audit, and the single-file submission."""

import gzip

import pytest
from pyspark.sql import functions as F

from trailmix.canon import FIT_END, HISTORY_END, SELECTION_END
from trailmix.operators import graph, refresh, replay
from trailmix.operators.graph import HOUR
from trailmix.plans.base import Steps
from trailmix.plans.retrieval_queries import submission as submitted
from trailmix.sources import files, submission

SMALL = "/root/testdata/sf0.001"


def rows(df):
    return sorted(tuple(r[c] for c in sorted(df.columns)) for r in df.collect())


def same(a: refresh.State, b: refresh.State) -> None:
    for x, y in ((a.statistics, b.statistics), (a.tail, b.tail), (a.totals, b.totals), (a.edges, b.edges), (a.hours, b.hours)):
        assert rows(x.select(*sorted(x.columns))) == rows(y.select(*sorted(x.columns))) and x.columns


def test_refreshed_states_equal_full_rebuilds(spark):
    ev = Steps(spark, SMALL).ev
    first = refresh.built(ev, HISTORY_END)
    assert rows(first.statistics) == rows(graph.item_statistics(ev.where(F.col("ts") < HISTORY_END)))
    at = first
    for cutoff in (FIT_END, SELECTION_END + 5 * HOUR):
        at = refresh.refreshed(at, ev, cutoff)
        same(at, refresh.built(ev, cutoff))
    same(refresh.refreshed(first, ev, HISTORY_END), first)
    with pytest.raises(ValueError, match="go back"):
        refresh.refreshed(at, ev, HISTORY_END)
    with pytest.raises(ValueError, match="whole hour"):
        refresh.refreshed(at, ev, at.cutoff + 1)


def test_a_refresh_reads_later_events_only(spark):
    ev = Steps(spark, SMALL).ev
    first = refresh.built(ev, HISTORY_END)
    kept = refresh.State(HISTORY_END, *[files.kept(df, "state") for df in (first.hours, first.tail, first.totals)])
    plan = refresh.refreshed(kept, ev, FIT_END).totals._jdf.queryExecution().toString()
    scans = [x for x in plan.splitlines() if "FileScan" in x and "event_index" in x and "PushedFilters" in x and "events-" in x]
    assert scans and all(f"GreaterThanOrEqual(ts,{HISTORY_END})" in x for x in scans)


def test_tails_of_long_sessions_go_on(spark):
    ev = [(1, k % 7, HISTORY_END - 30 * HOUR + k * HOUR, k % 3, k) for k in range(70)] + [(2, 5, HISTORY_END - HOUR, 0, 0), (2, 6, HISTORY_END - HOUR + 5, 1, 1), (3, 1, HISTORY_END + HOUR, 2, 0)]
    ev = spark.createDataFrame(ev, "session long, aid long, ts long, event_type long, event_index long")
    at = refresh.built(ev, HISTORY_END)
    for hours in (1, 2, 20, 60):
        at = refresh.refreshed(at, ev, HISTORY_END + hours * HOUR)
        same(at, refresh.built(ev, HISTORY_END + hours * HOUR))


def test_observed_input_must_follow_history(spark):
    ev = spark.createDataFrame([(1, 1, HISTORY_END - 5, 0, 0), (1, 2, HISTORY_END - 4, 0, 1)], "session long, aid long, ts long, event_type long, event_index long")
    at = refresh.built(ev, HISTORY_END)
    later = spark.createDataFrame([(2, 1, HISTORY_END, 0, 0)], ev.schema)
    assert tuple(refresh.deployable(at, later).first()) == (HISTORY_END - 4, HISTORY_END, 0)
    for bad in (later.withColumn("session", F.lit(1).cast("long")), later.withColumn("ts", F.lit(HISTORY_END - 4)), later.where("false")):
        with pytest.raises(Exception, match="disjoint"):
            refresh.deployable(at, bad).collect()


def test_replayed_sessions_equal_the_plans(spark):
    s = Steps(spark, SMALL)
    told = files.kept(submitted(s), "submission")
    found = replay.replay(s.pre, s.edges, s.pop, 256)
    assert found.count() == 3 * min(256, s.pre.select("session").distinct().count()) > 9
    assert replay.differences(found, told).collect() == []
    few = {r["session"] for r in replay.chosen(s.pre, 5).collect()}
    assert {r["session_type"].split("_")[0] for r in replay.replay(s.pre, s.edges, s.pop, 5).collect()} == {str(x) for x in few} and len(few) == 5
    # a fault in one row, and a missing row
    first = sorted(r["session_type"] for r in found.collect())[:2]
    swapped = F.when(F.col("session_type") == first[0], F.array_join(F.reverse(F.split("labels", " ")), " ")).otherwise(F.col("labels"))
    broken = told.where(F.col("session_type") != first[1]).withColumn("labels", swapped)
    assert sorted(r["session_type"] for r in replay.differences(found, broken).collect()) == first
    # a fault in the graph that the plans used
    wrong = replay.replay(s.pre, s.edges.withColumn("time_w", F.col("time_w") * F.col("target_aid")), s.pop)
    assert replay.differences(wrong, told).count() > 0


def test_one_file_one_header_same_bytes(spark, tmp_path):
    made = [(f"{s}_{o}", " ".join(str((s * 7 + k) % 100) for k in range(20))) for s in (*range(300), 10**7) for o in ("clicks", "carts", "orders")]
    df = spark.createDataFrame(made, "session_type string, labels string")
    first, second = str(tmp_path / "a.csv.gz"), str(tmp_path / "b.csv.gz")
    assert submission.write_single(df.repartition(5), first, 100) == 10
    submission.write_single(df.repartition(3), second, 100)
    data = open(first, "rb").read()
    assert data == open(second, "rb").read()
    text = gzip.decompress(data).decode()
    assert text.splitlines() == ["session_type,labels", *[f"{a},{b}" for a, b in made]]
    assert sorted(tuple(r) for r in submission.read_single(spark, first).collect()) == sorted(made)
    submission.write_single(df.where("false"), first)
    assert gzip.decompress(open(first, "rb").read()) == b"session_type,labels\n"
