"""Hand-calculated cases of the session engine, and its queries against DuckDB."""

import json
import math
import os
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from trailmix.canon import SCHEMA
from trailmix.operators import corpus, features, graph, metrics, screening, simple
from trailmix.plans import registry
from trailmix.sources import files, sessions
from trailmix.streaming.ingest import ingest

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Of each area some; every query is compared at the larger size by the driver.
COMPARED = [
    "scan_jsonl_roundtrip", "fixture_sessions", "processed_validation_summary", "session_hash_folds", "query_ledger", "labels", "audit_rebuild_labels", "setop_except_all_audit",
    "covisit_pairs", "covisit_pairs_lead", "covisit_graph", "item_statistics", "source_ranks", "candidates_topn", "negative_sampling", "demo_recommendations", "feat_source", "feat_context",
    "feat_history", "feat_repeat", "feat_interaction", "feat_graph", "core_feature_rows", "query_sampling", "demo_candidates", "demo_explanations", "demo_evaluation", "demo_contract_violations", "join_anti_coverage", "query_metrics", "official_score", "poisson_bootstrap", "candidate_frontier", "shortfall_accounting", "submission_validation",
]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", COMPARED)
def test_against_duckdb(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    result = duck.execute(registry.ORACLES[name])
    order = [[d[0] for d in result.description].index(c) for c in columns]
    want = Counter(tuple(repr(r[i]) for i in order) for r in result.fetchall())
    assert Counter(tuple(repr(v) for v in r) for r in df.select(*columns).collect()) == want


def test_every_query_has_an_oracle_or_says_why():
    without = set(registry.QUERIES) - set(registry.ORACLES)
    assert without == {"file_manifest", "bootstrap_interval", "screening_rejections", "feature_catalog", "screen_pilot_importance", "screen_retained", "ranker_scores", "ablation_choice", "permutation_importance", "evaluation_by_system", "paired_bootstrap", "shap_importance", "wide_matrix", "dataset_manifest", "input_attestation", "ablation_audit"}


EVENTS = [(1, 10, 10, 0, 0), (1, 20, 20, 1, 1), (1, 30, 30, 2, 2), (2, 10, 40, 0, 0), (2, 20, 50, 1, 1)]


def test_hand_calculated_graph(spark, monkeypatch):
    monkeypatch.setattr(graph, "POSITIONS", 1)
    ev = spark.createDataFrame(EVENTS, SCHEMA).repartition(3)
    got = {(r.source_aid, r.target_aid): (r.time_score, r.cart_score, r.order_score) for r in graph.scaled(graph.covisit(ev)).collect()}
    assert set(got) == {(10, 20), (20, 10), (20, 30), (30, 20)}
    assert got[10, 20] == pytest.approx((2, 6, 4), rel=1e-5)
    by_join = graph.pairs_by_join(ev).collect()
    assert Counter(by_join) == Counter(graph.pairs(ev).select("session", "source_aid", "target_aid", "target_type", "w").collect())


def test_catalog(spark):
    rows = features.catalog()
    names = [r[0] for r in rows]
    assert len(names) == len(set(names)) == 1482 and set(features.CORE) < set(names) and len(features.CORE) == 28
    assert Counter(r[1] for r in rows) == {"context": 24, "graph": 1152, "history": 99, "interaction": 11, "repeat": 160, "source": 36}
    assert {r[3] for r in rows if r[1] in ("context", "repeat")} == {"observed prefix"} and {r[4] for r in rows} == {"float32"}


def test_graph_features_count_missing_edges_as_zero(spark):
    prefix = spark.createDataFrame([(1, 1, 100, 0, 3), (1, 2, 200, 1, 2), (1, 1, 300, 0, 1)], "session long, aid long, ts long, event_type long, pos long")
    edges = spark.createDataFrame([(1, 2, 8.0, 4.0, 2.0), (1, 3, 4.0, 2.0, 1.0), (2, 3, 2.0, 1.0, 0.5)], "source_aid long, target_aid long, time_score double, cart_score double, order_score double")
    cand = spark.createDataFrame([(1, 3), (1, 1)], "session long, aid long")
    rows = {r.aid: r for r in features.graph_features(cand, prefix, edges, [("time", "all", 3, "uniform"), ("time", "carts", 3, "uniform")]).collect()}
    r = rows[3]
    assert (r.graph_time_all_n3_uniform_sum, r.graph_time_carts_n3_uniform_sum) == (10, 2)
    assert r.graph_time_all_n3_uniform_mean == pytest.approx(10 / 3)
    assert r.graph_time_all_n3_uniform_std == pytest.approx(math.sqrt((16 + 4 + 16) / 3 - (10 / 3) ** 2))
    assert rows[1].graph_time_all_n3_uniform_max == 0
    again = {r.aid: r for r in features.repeat_features(cand, prefix, (3,)).collect()}[1]
    assert (again.repeat_all_n3_count, again.repeat_all_n3_last_position, again.repeat_all_n3_span) == (2, 1, 2)


def test_recall_cuts_then_dedupes_and_ceiling_the_other_way(spark):
    lists = spark.createDataFrame([(1, 1, 5), (1, 2, 5), (1, 3, 6), (1, 4, 7)], "session long, rank long, aid long")
    truth = spark.createDataFrame([(1, 5), (1, 6), (1, 7)], "session long, aid long")
    assert tuple(metrics.recall_at_k(lists, truth, 2).first())[1:] == (1, 2)
    assert tuple(metrics.ceiling_at_k(lists, truth, 2).first())[1:] == (2, 3)


def test_pooled_recall_is_no_mean(spark):
    rows = spark.createDataFrame([("orders", 20, 20), ("orders", 0, 1)], "objective string, hits long, recall_denominator long")
    assert metrics.pooled(rows).first().recall == pytest.approx(20 / 21)


def test_screening_statuses(spark):
    rows = spark.createDataFrame([(i, 1, 1.0, float(i % 7), float(i % 7), i % 3 // 2, i % 3 // 2, i % 2, i % 5 // 4) for i in range(60)], "session long, aid long, one double, signal double, copy double, leak long, target_orders long, target_clicks long, target_carts long")
    got = {r.feature: r.status for r in screening.statuses(rows, ["one", "signal", "copy", "leak"]).collect()}
    assert got == {"one": "constant", "signal": "eligible", "copy": "duplicate", "leak": "target_equivalent"}


def test_protected_features_stay(spark):
    rows = spark.createDataFrame([(float(i), float(2 * i), float(i % 3)) for i in range(30)], "a double, b double, c double")
    assert screening.retained(rows, {"a": 0.0, "b": 0.9, "c": 0.1}, ["a"]) == ["a", "c"]  # b repeats a
    assert screening.retained(rows, {"a": 0.2, "b": 0.9, "c": 0.0}, []) == ["b"]
    assert screening.retained(rows, {}, ["a", "b"]) == ["a", "b"]


def test_undefined_scores_fail(spark):
    rows = spark.createDataFrame([("orders", 1, 2), ("carts", 0, 1), ("clicks", 1, 1)], "objective string, hits long, recall_denominator long")
    assert metrics.official(rows).first().score == pytest.approx(0.6 * 0.5 + 0.1)
    for bad in (rows.where("objective <> 'clicks'"), rows.withColumn("recall_denominator", F.lit(0)), rows.withColumn("hits", F.lit(5))):
        with pytest.raises(Exception, match="denominator"):
            metrics.official(bad).collect()


def test_matrix_must_be_finite(spark):
    rows = spark.createDataFrame([(1.0,), (float("nan"),)], "x double")
    assert features.finite(rows.where("x = 1"), ["x"]).count() == 1
    with pytest.raises(Exception, match="non-finite"):
        features.finite(rows, ["x"]).collect()


def test_future_items_do_not_change_prefixes(spark):
    ev = registry.QUERIES["scan_events"](spark, SF)
    cut = corpus.query_events(ev)
    future = cut.where("event_position > prefix_events").select("session", "event_index", F.lit(True).alias("later"))
    changed = ev.join(future, ["session", "event_index"], "left").withColumn("aid", F.when(F.col("later"), F.col("aid") + 1000).otherwise(F.col("aid"))).drop("later")
    assert Counter(corpus.observed(corpus.query_events(changed)).collect()) == Counter(corpus.observed(cut).collect())


def test_records_are_rejected(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text(json.dumps({"session": 1, "events": [{"aid": 1, "ts": 5, "type": "views"}]}) + "\n")
    with pytest.raises(Exception, match="unknown action"):
        sessions.flatten(sessions.read_jsonl(spark, str(tmp_path / "a.jsonl"))).collect()


def test_streamed_files_are_read_once(spark, tmp_path):
    source, target, done = (str(tmp_path / x) for x in ("in", "out", "done"))
    os.makedirs(source)
    for k in range(2):
        (tmp_path / "in" / f"{k}.jsonl").write_text(json.dumps({"session": k, "events": [{"aid": 1, "ts": 5, "type": "clicks"}, {"aid": 2, "ts": 6, "type": "orders"}]}) + "\n")
        ingest(spark, source, target, done).awaitTermination()
    assert spark.read.parquet(target).count() == 4


def test_csv_sink(spark, tmp_path):
    rows = spark.createDataFrame([("1_clicks", "1 2 3")], "session_type string, labels string")
    files.write_csv(rows, str(tmp_path / "x"))
    assert files.read_csv(spark, str(tmp_path / "x"), "session_type string, labels string").collect() == rows.collect()


def test_cooccurrence_of_long_sessions_in_blocks(spark):
    rows = [(1, a) for a in range(23)] + [(1, 3), (2, 5), (3, 5), (3, 22), (4, 22), (4, 5)]
    hist = spark.createDataFrame(rows, "session long, aid long")
    wanted = Counter((a, b) for own in (set(range(23)), {5}, {5, 22}, {5, 22}) for a in own for b in own if a != b)
    for block in (1, 5, 23, 256):
        assert {(r["item"], r["other"]): r["n"] for r in simple.cooccurrence(hist, block).collect()} == wanted
