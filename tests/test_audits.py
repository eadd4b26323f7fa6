"""Audits find planted faults."""

import pytest
from pyspark.sql import functions as F

from trailmix import canon
from trailmix.operators import audits, candidates
from trailmix.plans.base import Steps

SMALL = "/root/testdata/sf0.001"


def test_a_changed_prefix_or_label_is_found(spark):
    s = Steps(spark, SMALL)
    bounds = s.led.select("session", "split_role", "observed_last_index", "period_end").distinct()
    prefixes, labels = audits.rebuilt(s.ev, bounds)
    for kind, made, stored in (("prefixes", prefixes, s.obs), ("labels", labels, s.lab)):
        n = stored.count()
        assert tuple(audits.both_ways(kind, made, stored).first()) == (kind, n, n, 0, 0) and n > 5
        one = stored.limit(1)
        assert tuple(audits.both_ways(kind, made, stored.unionByName(one)).first()) == (kind, n, n + 1, 0, 1)
        moved = stored.withColumn("aid", F.col("aid") + (F.col("session") == one.first()["session"]).cast("long"))
        got = audits.both_ways(kind, made, moved).first()
        assert got["rebuilt_minus_stored"] == got["stored_minus_rebuilt"] > 0
    assert tuple(audits.both_ways("none", prefixes.where("false"), s.obs.where("false")).first()) == ("none", 0, 0, 0, 0)


def test_moved_boundaries_are_found(spark):
    s = Steps(spark, SMALL)
    bounds = s.led.select("session", "split_role", "first_ts", "query_ts", "observed_last_index", "period_end").distinct()
    n = bounds.count()
    assert tuple(audits.boundary_faults(s.ev, bounds).first()) == (n, 0, 0)
    assert audits.boundary_faults(s.ev, bounds.withColumn("query_ts", F.col("query_ts") + 1)).first()["moved"] == n
    twice = bounds.unionByName(bounds.limit(1).withColumn("split_role", F.lit("other")))
    assert audits.boundary_faults(s.ev, twice).first()["overlapping"] == 1


def ceilings(spark, rows):
    return spark.createDataFrame(rows, "session long, objective string, recall_denominator long, ceilings array<bigint>")


def hits(spark, rows):
    return spark.createDataFrame(rows, "session long, objective string, hits long, ndcg double, mrr double, hit_rate long, eligible long")


def test_ceilings_must_be_nested(spark):
    good = [(1, "orders", 3, [0, 1, 3]), (2, "orders", 0, [0, 0, 0]), (3, "orders", 2, [2, 2, 2])]
    own = [(1, "orders", 3, 1.0, 1.0, 1, 1), (2, "orders", 0, 0.0, 0.0, 0, 0), (3, "orders", 0, 0.0, 0.0, 0, 1)]
    check = lambda a, b: tuple(audits.ceiling_faults(ceilings(spark, a), hits(spark, b)).first())
    assert check(good, own) == ("orders", 3, 0, 0, 0, 0)
    assert check([(1, "orders", 3, [1, 0, 3]), *good[1:]], own)[2:] == (1, 0, 0, 0)
    assert check([(1, "orders", 2, [0, 1, 3]), *good[1:]], own)[2:] == (0, 1, 0, 0)
    assert check(good, [(1, "orders", 4, 1.0, 1.0, 1, 1), *own[1:]])[2:] == (0, 0, 1, 0)
    assert check(good, [(1, "orders", 3, 1.1, 1.0, 1, 1), *own[1:]])[2:] == (0, 0, 0, 1)
    assert check(good, [(1, "orders", 3, 1.0, 1.0, 0, 1), *own[1:]])[2:] == (0, 0, 0, 1)
    assert sum(check(good, own[:2])[2:]) > 0  # a query that the report lacks


def test_budgets_are_parameters(spark):
    cand = spark.createDataFrame([(1, a, a) for a in range(1, 31)], "session long, aid long, candidate_position long")
    labels = spark.createDataFrame([(1, "orders", a) for a in (2, 7, 25, 99)], "session long, objective string, aid long")
    ledger = spark.createDataFrame([(1, "orders", 4), (2, "orders", 1)], "session long, objective string, recall_denominator long")
    got = {r["session"]: r["ceilings"] for r in audits.frontier(cand, labels, ledger, (1, 2, 10, 30), top=2).collect()}
    assert got == {1: [0, 1, 2, 2], 2: [0, 0, 0, 0]}
    for wrong in ((), (0, 5), (5, 5), (10, 5)):
        with pytest.raises(ValueError, match="budgets"):
            audits.frontier(cand, labels, ledger, wrong)


def test_shortfalls_add_up(spark):
    rows = [(1, "orders", 3, 5, 4), (2, "orders", 9, 2, 1), (3, "orders", 4, 0, 0), (1, "clicks", 3, 1, 0), (2, "clicks", 9, 0, 0)]
    h = spark.createDataFrame(rows, "session long, objective string, observed_events long, recall_denominator long, hits long")
    pool = spark.createDataFrame([(1, "orders", 4), (2, "orders", 2)], "session long, objective string, n long")
    found = audits.shortfalls(h, pool)
    got = {(r["slice"], r["objective"]): tuple(r)[2:] for r in found.collect()}
    assert got["overall", "orders"] == (3, 2, 7, 5, 6, 1, 1) and got["0_to_4_events", "orders"] == (2, 1, 5, 4, 4, 0, 1)
    assert got["5_or_more_events", "orders"] == (1, 1, 2, 1, 2, 1, 0) and got["5_or_more_events", "clicks"] == (1, 0, 0, 0, 0, 0, 0)
    w = {r["slice"]: r for r in audits.weighted_shortfalls(found).collect()}
    assert w["overall"]["weighted_recall"] == pytest.approx(0.6 * 5 / 7) and w["overall"]["weighted_evaluable_mass"] == pytest.approx(0.7)
    assert w["5_or_more_events"]["weighted_evaluable_mass"] == pytest.approx(0.6) and w["5_or_more_events"]["weighted_ranking_shortfall"] == pytest.approx(0.3)
    with pytest.raises(Exception, match="reconcile"):
        audits.shortfalls(h.withColumn("hits", F.lit(6).cast("long")), pool).collect()


def test_evidence_must_follow_from_counts(spark):
    rows = [("clicks", 1, 2, 0.5, 0.65), ("carts", 1, 1, 1.0, 0.65), ("orders", 1, 2, 0.5, 0.65)]
    report = spark.createDataFrame(rows, "objective string, hits long, denominator long, recall double, weighted double")
    assert audits.evidence(report).count() == 3
    for bad in (report.withColumn("weighted", F.lit(0.66)), report.withColumn("recall", F.lit(0.6))):
        with pytest.raises(Exception, match="follow from its counts"):
            audits.evidence(bad).collect()
    assert audits.weighted_objective({"clicks": 0.5, "carts": 1.0, "orders": 0.5}) == pytest.approx(0.65)
    for recalls, weights in (({"clicks": 1.0}, None), ({"a": 1.0}, {"a": 0.9}), ({"a": 1.0, "b": 1.0}, {"a": 1.5, "b": -0.5})):
        with pytest.raises(ValueError, match="objective|weights"):
            audits.weighted_objective(recalls, weights)


def test_queries_before_the_cutoff_are_refused(spark):
    rows = spark.createDataFrame([(1, canon.HISTORY_END)], "session long, ts long")
    assert audits.available(rows, canon.HISTORY_END).count() == 1
    with pytest.raises(Exception, match="precedes the cutoff"):
        audits.available(rows, canon.HISTORY_END + 1).collect()
    for budget in (0, 401):
        with pytest.raises(ValueError, match="budget"):
            candidates.selected(rows, rows, budget)


def test_boundaries_from_iso_times(spark):
    assert audits.epoch_ms("2024-01-18T12:00:00+00:00") == canon.HISTORY_END == audits.epoch_ms("2024-01-18T14:00:00+02:00")
    made = audits.protocol("2024-01-18T12:00:00Z", "2024-01-24T00:00:00Z", "2024-01-27T00:00:00Z", "2024-01-30T12:00:00Z")
    assert made == (canon.HISTORY_END, canon.FIT_END, canon.SELECTION_END, canon.EVALUATION_END)
    with pytest.raises(ValueError, match="zone"):
        audits.epoch_ms("2024-01-18T12:00:00")
    with pytest.raises(ValueError, match="rise"):
        audits.protocol("2024-01-18T12:00:00Z", "2024-01-18T12:00:00Z", "2024-01-27T00:00:00Z", "2024-01-30T12:00:00Z")
    rows = spark.createDataFrame([("2024-01-18T12:00:00.005+00:00",), ("2024-01-18T14:00:00.005+02:00",)], "t string")
    assert {r[0] for r in rows.select(audits.iso_ms(F.col("t"))).collect()} == {canon.HISTORY_END + 5}
    with pytest.raises(Exception, match="without a zone"):
        rows.select(audits.iso_ms(F.lit("2024-01-18T12:00:00"))).collect()
