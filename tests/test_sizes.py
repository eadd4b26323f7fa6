"""What a task has to hold must not grow with the input."""

import itertools

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from trailmix.operators import boosting, candidates, features, graph, metrics, simple, wide
from trailmix.plans import base, feature_queries, registry, study_queries
from trailmix.plans.base import Steps
from trailmix.plans.wide_queries import NUDGE

EVENT = "session bigint, aid bigint, ts bigint, event_type bigint"


def test_explanations_take_more_tasks_for_more_sessions(spark):
    hist = spark.createDataFrame([(s, (s * 7 + k) % 40, k, k % 3) for s in range(60) for k in range(6)], EVENT)
    pairs, counts = simple.cooccurrence(hist), simple.popularity(hist)

    def made(n: int, task_rows: int):
        prefix = spark.range(n).select(F.col("id").alias("session"), F.explode(F.array(*[F.struct(((F.col("id") * k) % 40).alias("aid"), F.lit(k).cast("long").alias("ts"), F.lit(0).cast("long").alias("event_type")) for k in (1, 3, 11)])).alias("e"))
        return simple.explanations(prefix.select("session", "e.*"), pairs, counts, task_rows=task_rows)

    few, many = made(200, 1000), made(800, 1000)
    sizes = [r["n"] for r in many.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert few.rdd.getNumPartitions() >= 8 and many.rdd.getNumPartitions() >= 32
    assert max(sizes) <= 3 * 2000  # three objectives, and some play in the hash
    ordered = lambda df: sorted(map(tuple, simple.candidates(df).collect()))
    assert ordered(few) == ordered(made(200, 10**9))


def test_wide_graph_features_are_rounded_in_tasks(spark):
    """Spark's round makes a decimal of each of 1,152 values a row; arrays rounded in tasks must give the same numbers."""
    made = registry.QUERIES["feat_graph_wide"](spark, "/root/testdata/sf0.001")
    assert "round(" not in made._jdf.queryExecution().optimizedPlan().toString()
    s = Steps(spark, "/root/testdata/sf0.001")
    plain = wide.kernel(s.cand.select("session", "aid"), s.pre, graph.scaled(s.edges))
    some = range(0, len(wide.GRAPH_NAMES), 7)
    want = plain.select("session", "aid", *[F.round(F.col("graph")[i] + F.lit(NUDGE), 5).alias(wide.GRAPH_NAMES[i]) for i in some])
    assert sorted(map(tuple, made.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_wide_graph_features_are_joined_by_item_only_and_tasks_go_by_rows(spark):
    random = np.random.default_rng(5)
    events = [(s, p, int(random.integers(12)), 10**9 - 40_000 * p, int(random.integers(3))) for s in range(40) for p in range(1, (3, 9, 70)[s % 3])]
    pre = spark.createDataFrame(events, "session long, pos long, aid long, ts long, event_type long")
    cand = spark.createDataFrame([(s, i) for s in range(40) for i in range(s % 2, 30, 2)], "session long, aid long")
    edges = spark.createDataFrame([(a, b, *random.random(3).tolist()) for a in range(10) for b in range(40) if random.random() < 0.3], "source_aid long, target_aid long, time_score double, cart_score double, order_score double")
    made = wide.graph_columns(cand, pre, edges, 5, NUDGE, task_rows=50, batch_rows=7)
    assert made._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1  # it was a join by item, then one by session and item
    assert made.rdd.getNumPartitions() == cand.count() // 50
    names = ["session", "aid", *wide.GRAPH_NAMES]
    got = {(r[0], r[1]): r[2:] for r in made.select(names).collect()}
    want = {(r.session, r.aid): tuple(np.floor((np.array(r.graph) + NUDGE) * 1e5 + 0.5) / 1e5) for r in wide.kernel(cand, pre, edges).collect()}
    assert got == want and len(got) == 600


def joined(s: Steps, role: str):
    """The studied matrix by a join for each family, as its parts are defined."""
    cand, pre = s.candidates_of(role), s.role(role)
    source, context, repeat = features.source_features(cand), features.context_features(pre), features.repeat_features(cand, pre, (5, 50))
    hist = features.history_features(feature_queries.items(s, cand, pre), s.stats)
    both = [repeat, hist.drop("query_ts"), features.interaction_features(source, context, repeat, hist), features.graph_features(cand, pre, graph.scaled(s.edges), feature_queries.GRAPH_NAMES)]
    rows = source.join(context, "session")
    for other in both:
        rows = rows.join(other, ["session", "aid"])
    return candidates.with_targets(rows.select("session", "aid", "candidate_position", *feature_queries.ALL), s.labels_of(role))


@pytest.mark.parametrize("role", ["fit", "evaluation"])
def test_studied_matrix_is_that_of_the_joins_with_one_wide_shuffle(spark, role):
    s = Steps(spark, "/root/testdata/sf0.001")
    made = feature_queries.unwritten(s, role)
    assert made._jdf.queryExecution().optimizedPlan().toString().count("Join ") <= 2  # statistics and edges by item; the joins of families were a dozen
    want = joined(s, role)
    assert made.dtypes == want.dtypes
    got, told = (df.toPandas().sort_values(["session", "aid"]).reset_index(drop=True) for df in (made, want))
    assert len(got) == len(told) > 0
    for name, kind in want.dtypes:
        # where a variance cancels out, its root keeps half the digits
        np.testing.assert_allclose(got[name], told[name], rtol=0 if kind == "bigint" else 1e-12, atol=3e-5 if name.endswith("_std") else 1e-12, err_msg=name)


def test_batches_are_cut_between_sessions_only():
    column = np.repeat([3, 4, 9], [5, 1, 6])
    for size in range(1, 13):
        batches = [pa.RecordBatch.from_arrays([pa.array(column[a : a + size])], names=["session"]) for a in range(0, 12, size)]
        parts = [t.column(0).to_numpy() for t in wide.whole_sessions(iter(batches))]
        assert np.concatenate(parts).tolist() == column.tolist()
        assert all(not set(a) & set(b) for a, b in itertools.combinations(parts, 2))


def _stump(feature: int, threshold: float, low: float, high: float) -> boosting.Tree:
    return boosting.Tree(np.array([feature, -1, -1]), np.array([threshold, 0.0, 0.0]), np.zeros(3, int), np.array([1, 0, 0]), np.array([2, 0, 0]), np.array([0.0, low, high]), np.ones(3), np.ones(3))


def test_scores_read_only_features_of_splits_and_ranks_need_no_shuffle(spark):
    rows = spark.range(60).selectExpr("id div 7 AS session", "(id * 11) % 60 AS aid", "cast(id % 5 AS double) AS x", "cast(id % 3 AS double) AS y", "cast(id AS double) AS unused")
    models = {"one": boosting.Ensemble(["unused", "x", "y"], [_stump(1, 2.0, 0.5, -1.0), _stump(2, 0.0, 0.25, 1.0), _stump(0, 3.0, 9.0, 99.0)], 2, 0.5), "none": boosting.Ensemble(["unused"], [], 0, 0.0)}
    made = boosting.scored(rows, models, ["session", "aid"])
    assert "_unused" not in made._jdf.queryExecution().analyzed().toString()
    score = "(CASE WHEN x <= 2 THEN 0.5D ELSE -1.0D END + CASE WHEN y <= 0 THEN 0.25D ELSE 1.0D END)"
    want = {(r.session, r.aid): (r.s, r.r) for r in rows.selectExpr("session", "aid", f"{score} AS s", f"row_number() OVER (PARTITION BY session ORDER BY {score} DESC, aid) AS r").collect()}
    assert {(r.session, r.aid): r.score for r in made.where("model = 'one'").collect()} == {k: v[0] for k, v in want.items()}
    placed = boosting.placed(rows.coalesce(1).sortWithinPartitions("session", "aid"), models, ["y"])
    assert "Exchange" not in placed._jdf.queryExecution().executedPlan().toString()
    assert {(r.session, r.aid): (r.scores[0], r.ranks[0]) for r in placed.collect()} == want


def test_evaluation_writes_places_but_no_matrix(spark):
    names = lambda: {k[-1] for k in base._written if k[1].startswith("/root/testdata/sf0.01/")}
    rows = registry.QUERIES["ranker_scores"](spark, "/root/testdata/sf0.01")
    assert rows.columns == ["session", "aid", "candidate_position", "objective", "score"]
    assert rows.count() == 3 * Steps(spark, "/root/testdata/sf0.01").cand.count()
    assert "standings" in names() and "matrix-evaluation" not in names()


def test_rankers_are_fitted_on_all_rows_of_all_sessions(spark):
    s = Steps(spark, "/root/testdata/sf0.01")
    sessions = {r["split_role"]: r["count"] for r in s.qs.groupBy("split_role").count().collect()}
    for role in ("fit", "selection"):
        assert s.whole.candidates_of(role).select("session").distinct().count() == sessions[role] > s.candidates_of(role).select("session").distinct().count()
    rows = s.whole.candidates_of("fit").count()
    for group in study_queries.sealed(s).values():
        assert {int(tree.cover[0]) for model in group.values() for tree in model.trees} == {rows}
    assert registry.QUERIES["ablation_audit"](spark, s.dir).count() == 24  # raises if a recall is not that of all selection sessions


def test_systems_meet_labels_without_scoring_or_ranking_again(spark):
    s = Steps(spark, "/root/testdata/sf0.01")
    made = study_queries.systems(s).where("system = 'selected'").select("session", "objective", "hits", "ndcg", "mrr")
    assert "MapInArrow" not in made._jdf.queryExecution().optimizedPlan().toString()
    order = Window.partitionBy("session", "objective").orderBy(F.desc("score"), "aid")
    ranked = registry.QUERIES["ranker_scores"](spark, s.dir).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= metrics.K)
    want = metrics.hits(ranked, s.labels_of("evaluation"), s.ledger_of("evaluation")).select(*made.columns)
    rounded = lambda df: sorted((r[0], r[1], r[2], round(r[3], 12), r[4]) for r in df.collect())
    assert rounded(made) == rounded(want) and any(r[2] for r in rounded(made))
