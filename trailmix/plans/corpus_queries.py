"""Queries of ingestion, validation and the chronological corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trailmix import canon
from trailmix.operators import corpus, graph
from trailmix.plans.base import Steps, prelude
from trailmix.sources import files, manifests, sessions

QUERIES: dict[str, object] = {}
ORACLES: dict[str, str] = {}


def add(name: str, sql: str | None = None, role: str = "evaluation"):
    """Register a query; ``sql`` is its final SELECT over the shared expressions."""

    def register(f):
        QUERIES[name] = lambda spark, sf_dir: f(Steps(spark, sf_dir))
        if sql:
            ORACLES[name] = prelude(role) + sql
        return f

    return register


EV = "session, aid, ts, event_type, event_index"
EV_ALL = f"SELECT {EV} FROM ev_"


@add("scan_events", EV_ALL)
def _(s: Steps) -> DataFrame:
    return s.raw.select(*EV.split(", "))


@add("scan_pruned_filtered", "SELECT event_id, ts AS ts, aid FROM act_ WHERE event_type = 2")
def _(s: Steps) -> DataFrame:
    return canon.raw_actions(s.spark, s.dir).where("event_type = 2").select("event_id", "ts", "aid")


@add("scan_jsonl_roundtrip", EV_ALL)
def _(s: Steps) -> DataFrame:
    return sessions.flatten(sessions.parsed(sessions.to_lines(s.raw)))


@add("flatten_events", EV_ALL)
def _(s: Steps) -> DataFrame:
    return sessions.flatten(sessions.nested(s.raw))


@add("sink_parquet_roundtrip", EV_ALL)
def _(s: Steps) -> DataFrame:
    return files.round_trip(s.raw, canon.SCHEMA)


@add("file_manifest")
def _(s: Steps) -> DataFrame:
    """Rows only: name, size and digest of each file of the tables."""
    return manifests.hashed(s.spark, f"{s.dir}/*.parquet").select("name", "size_bytes", "sha256")


@add("fixture_sessions", """
SELECT s AS session, aid, ts, event_type, j AS event_index FROM (SELECT *, (j >= n - 2)::INT + (j = n - 1)::INT AS event_type FROM (SELECT s, p, i, j, n, 1661000000000 + p * 86400000 + i * 1000 + j * 10 AS ts,
    CASE WHEN p = 3 AND i % 11 = 0 AND j = n - 1 THEN 999 ELSE 1 + (i * 7 + j // 2) % 128 END AS aid
    FROM (SELECT s, CASE WHEN s < 256 THEN 0 WHEN s < 384 THEN 1 WHEN s < 448 THEN 2 ELSE 3 END AS p, CASE WHEN s < 256 THEN s WHEN s < 384 THEN s - 256 WHEN s < 448 THEN s - 384 ELSE s - 448 END AS i,
        6 + CASE WHEN s < 256 THEN s WHEN s < 384 THEN s - 256 WHEN s < 448 THEN s - 384 ELSE s - 448 END % 5 AS n FROM range(512) r(s)), LATERAL (SELECT unnest(range(n)) AS j)))""")
def _(s: Steps) -> DataFrame:
    return sessions.fixture(s.spark)


@add("raw_validation_summary", """
SELECT count(DISTINCT session) AS sessions, count(*) AS n_events, count(*) FILTER (event_type = 0) AS clicks, count(*) FILTER (event_type = 1) AS carts, count(*) FILTER (event_type = 2) AS orders,
    min(ts) AS min_ts, max(ts) AS max_ts, count(*) FILTER (ts < before) AS time_reversals, count(*) FILTER (aid < 0 OR ts < 0) AS bad_values
FROM (SELECT *, lag(ts) OVER (PARTITION BY session ORDER BY event_index) AS before FROM ev_)""")
def _(s: Steps) -> DataFrame:
    return sessions.raw_summary(s.ev)


@add("processed_validation_summary", """
SELECT count(*) AS n_events, count(DISTINCT session) AS sessions, count(*) FILTER (before IS NULL AND event_index <> 0) AS bad_starts, count(*) FILTER (event_index <> before + 1) AS index_gaps,
    count(*) FILTER (ts < ts_before) AS time_reversals, min(ts) AS min_ts, max(ts) AS max_ts FROM (SELECT *, lag(event_index) OVER w AS before, lag(ts) OVER w AS ts_before FROM ev_ WINDOW w AS (PARTITION BY session ORDER BY event_index))""")
def _(s: Steps) -> DataFrame:
    return sessions.processed_summary(s.ev)


@add("event_value_violations", "SELECT count(*) FILTER (session IS NULL OR aid IS NULL OR ts IS NULL) AS nulls, count(*) FILTER (session < 0 OR aid < 0 OR ts < 0) AS negatives, count(*) FILTER (event_type NOT IN (0, 1, 2)) AS bad_types FROM ev_")
def _(s: Steps) -> DataFrame:
    return s.ev.agg(F.count_if(F.expr("session IS NULL OR aid IS NULL OR ts IS NULL")).alias("nulls"), F.count_if(F.expr("session < 0 OR aid < 0 OR ts < 0")).alias("negatives"), F.count_if(~F.col("event_type").isin(0, 1, 2)).alias("bad_types"))


@add("session_contiguity", "SELECT session, count(*) AS n, min(event_index) = 0 AND max(event_index) + 1 = count(*) AS contiguous FROM hist_ GROUP BY 1")
def _(s: Steps) -> DataFrame:
    return s.hist.groupBy("session").agg(F.count("*").alias("n"), ((F.min("event_index") == 0) & (F.max("event_index") + 1 == F.count("*"))).alias("contiguous"))


@add("history_cutoff_guard", "SELECT max(ts) AS last_ts, max(ts) < 1705579200000 AS before_cutoff, count(*) AS n FROM hist_")
def _(s: Steps) -> DataFrame:
    return s.hist.agg(F.max("ts").alias("last_ts"), (F.max("ts") < canon.HISTORY_END).alias("before_cutoff"), F.count("*").alias("n"))


@add("label_boundary_violations", """SELECT split_role, objective, count(*) AS checked, count(*) FILTER (label_ts < query_ts) AS early, count(*) FILTER (label_ts >= period_end) AS late,
    count(*) FILTER (label_event_index <= observed_last_index) AS observed FROM lab_ JOIN led_ USING (session, split_role, objective) GROUP BY 1, 2""")
def _(s: Steps) -> DataFrame:
    rows = s.lab.join(s.led.select("session", "split_role", "objective", "query_ts", "period_end", "observed_last_index"), ["session", "split_role", "objective"])
    return rows.groupBy("split_role", "objective").agg(
        F.count("*").alias("checked"), F.count_if(F.expr("label_ts < query_ts")).alias("early"), F.count_if(F.expr("label_ts >= period_end")).alias("late"), F.count_if(F.expr("label_event_index <= observed_last_index")).alias("observed")
    )


@add("deployment_bounds", """SELECT (SELECT max(ts) FROM hist_) AS history_last_ts, (SELECT min(ts) FROM ev_ JOIN roles_ USING (session) WHERE split_role <> 'history') AS test_first_ts,
    (SELECT count(*) FROM (SELECT DISTINCT session FROM hist_) h JOIN (SELECT DISTINCT session FROM roles_ WHERE split_role <> 'history') t USING (session)) AS shared_sessions""")
def _(s: Steps) -> DataFrame:
    later = s.ev.join(s.roles.where("split_role <> 'history'").select("session"), "session", "left_semi")
    shared = later.select("session").distinct().join(s.hist.select("session"), "session", "left_semi").agg(F.count("*").alias("n")).scalar()
    return s.hist.agg(F.max("ts").alias("history_last_ts")).select("history_last_ts", later.agg(F.min("ts").alias("t")).scalar().alias("test_first_ts"), shared.alias("shared_sessions"))


@add("observed_contract", """SELECT count(DISTINCT session) AS sessions, count(*) AS n, count(*) FILTER (aid IS NULL OR ts IS NULL OR aid < 0) AS bad_values, count(*) FILTER (before IS NULL AND event_index <> 0) AS bad_starts,
    count(*) FILTER (event_index <> before + 1) AS gaps, count(*) FILTER (ts < ts_before) AS reversals, count(*) FILTER (event_type NOT IN (0, 1, 2)) AS bad_types FROM (SELECT *, lag(event_index) OVER w AS before, lag(ts) OVER w AS ts_before FROM obs_ WINDOW w AS (PARTITION BY session ORDER BY event_index))""")
def _(s: Steps) -> DataFrame:
    w = Window.partitionBy("session").orderBy("event_index")
    rows = s.obs.withColumn("before", F.lag("event_index").over(w)).withColumn("ts_before", F.lag("ts").over(w))
    c = lambda e, n: F.count_if(F.expr(e)).alias(n)
    return rows.agg(F.countDistinct("session").alias("sessions"), F.count("*").alias("n"), c("aid IS NULL OR ts IS NULL OR aid < 0", "bad_values"), c("before IS NULL AND event_index <> 0", "bad_starts"), c("event_index <> before + 1", "gaps"), c("ts < ts_before", "reversals"), c("event_type NOT IN (0, 1, 2)", "bad_types"))


@add("role_query_matrix", """SELECT session, split_role, sum(true_items) FILTER (objective = 'clicks')::BIGINT AS true_clicks, sum(true_items) FILTER (objective = 'carts')::BIGINT AS true_carts, sum(true_items) FILTER (objective = 'orders')::BIGINT AS true_orders,
    sum(recall_denominator) FILTER (objective = 'clicks')::BIGINT AS denominator_clicks, sum(recall_denominator) FILTER (objective = 'carts')::BIGINT AS denominator_carts, sum(recall_denominator) FILTER (objective = 'orders')::BIGINT AS denominator_orders FROM led_ GROUP BY 1, 2""")
def _(s: Steps) -> DataFrame:
    of = lambda c, o: F.sum(F.when(F.col("objective") == o, F.col(c)))
    return s.led.groupBy("session", "split_role").agg(*[of("true_items", o).alias(f"true_{o}") for o in canon.ACTIONS], *[of("recall_denominator", o).alias(f"denominator_{o}") for o in canon.ACTIONS])


@add("session_hash_folds", "SELECT session, hh::VARCHAR AS h, (hh % 3)::BIGINT AS fold FROM (SELECT session, (xor(session, 20260908::BIGINT)::HUGEINT * 11400714819323198485::HUGEINT) % 18446744073709551616::HUGEINT AS hh FROM roles_)")
def _(s: Steps) -> DataFrame:
    product = F.col("session").bitwiseXOR(F.lit(20260908).cast("bigint")).cast("decimal(18,0)") * F.lit("11400714819323198485").cast("decimal(20,0)")
    hashed = (product % F.lit("18446744073709551616").cast("decimal(20,0)")).cast("decimal(20,0)")
    return s.roles.select("session", hashed.cast("string").alias("h"), (hashed % 3).cast("bigint").alias("fold"))


@add("expr_role_case", "SELECT session, ts, CASE WHEN ts < 1705579200000 THEN 'history' WHEN ts < 1706054400000 THEN 'fit' WHEN ts < 1706313600000 THEN 'selection' WHEN ts < 1706616000000 THEN 'evaluation' ELSE 'excluded' END AS role, event_type IN (1, 2) AS strong FROM ev_")
def _(s: Steps) -> DataFrame:
    return s.ev.select("session", "ts", corpus.role_of(F.col("ts")).alias("role"), F.col("event_type").isin(1, 2).alias("strong"))


@add("expr_pair_weight", "SELECT session, event_index, round(exp(-(ts % 86400000)::DOUBLE / 21600000::DOUBLE) / sqrt((event_index + 1)::DOUBLE) * 1e9::DOUBLE)::BIGINT AS w FROM ev_")
def _(s: Steps) -> DataFrame:
    return s.ev.select("session", "event_index", graph.weight(F.col("ts") % canon.DAY, F.col("event_index") + 1).alias("w"))


@add("expr_time_encoding", "SELECT session, event_index, round(sin(2 * pi() * ((ts / 3600000::DOUBLE) % 24) / 24), 6) AS hour_sin, round(cos(2 * pi() * ((ts / 3600000::DOUBLE) % 24) / 24), 6) AS hour_cos, round(sin(2 * pi() * ((ts / 86400000::DOUBLE + 3) % 7) / 7), 6) AS day_sin FROM ev_")
def _(s: Steps) -> DataFrame:
    hour, day = (F.col("ts") / F.lit(3_600_000.0)) % 24, (F.col("ts") / F.lit(86_400_000.0) + 3) % 7
    turn = lambda f, x, n: F.round(f(2 * F.pi() * x / n), 6)
    return s.ev.select("session", "event_index", turn(F.sin, hour, 24).alias("hour_sin"), turn(F.cos, hour, 24).alias("hour_cos"), turn(F.sin, day, 7).alias("day_sin"))


@add("expr_submission_keys", "SELECT session || '_' || objective AS session_type, regexp_matches(session::VARCHAR, '^[0-9]+$') AS decimal_key FROM led_")
def _(s: Steps) -> DataFrame:
    return s.led.select(F.concat_ws("_", "session", "objective").alias("session_type"), F.col("session").cast("string").rlike("^[0-9]+$").alias("decimal_key"))


@add("join_events_roles", "SELECT session, aid, ts, split_role, first_ts FROM ev_ JOIN roles_ USING (session)")
def _(s: Steps) -> DataFrame:
    return s.ev.join(s.roles, "session").select("session", "aid", "ts", "split_role", "first_ts")


@add("join_query_events", "SELECT session, split_role, event_index, event_position, n_events, prefix_events FROM qev_")
def _(s: Steps) -> DataFrame:
    return s.qev.select("session", "split_role", "event_index", "event_position", "n_events", "prefix_events")


@add("query_ledger", "SELECT session, split_role, period_end, first_ts, query_ts, observed_last_index, observed_events, objective, true_items, recall_denominator FROM led_")
def _(s: Steps) -> DataFrame:
    return s.led


@add("audit_label_join", "SELECT l.objective, count(*) AS n, count(*) FILTER (q.session IS NULL) AS orphans FROM lab_ l LEFT JOIN (SELECT * FROM led_ WHERE observed_events > 1) q USING (session, objective) GROUP BY 1")
def _(s: Steps) -> DataFrame:
    known = s.led.where("observed_events > 1").select("session", "objective", F.lit(True).alias("known"))
    return s.lab.join(known, ["session", "objective"], "left").groupBy("objective").agg(F.count("*").alias("n"), F.count_if(F.col("known").isNull()).alias("orphans"))


@add("join_semi_overlap", "SELECT session FROM roles_ WHERE split_role <> 'history' AND session // 1000 IN (SELECT session // 1000 FROM hist_)")
def _(s: Steps) -> DataFrame:
    user = F.floor(F.col("session") / 1000)
    return s.roles.where("split_role <> 'history'").withColumn("user", user).join(s.hist.select(user.alias("user")), "user", "left_semi").select("session")


@add("join_anti_coverage", "SELECT 'unsampled' AS side, session FROM qs_ ANTI JOIN samp_ USING (session) UNION ALL SELECT 'unknown', session FROM samp_ ANTI JOIN qs_ USING (session)")
def _(s: Steps) -> DataFrame:
    one = s.qs.join(s.samp.select("session"), "session", "left_anti").select(F.lit("unsampled").alias("side"), "session")
    return one.unionByName(s.samp.join(s.qs.select("session"), "session", "left_anti").select(F.lit("unknown").alias("side"), "session"))


@add("session_bounds", "SELECT session, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n FROM ev_ GROUP BY 1")
def _(s: Steps) -> DataFrame:
    return s.ev.groupBy("session").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n"))


@add("role_summary", "SELECT split_role, count(DISTINCT session) AS sessions, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM ev_ JOIN roles_ USING (session) GROUP BY 1")
def _(s: Steps) -> DataFrame:
    return s.ev.join(s.roles, "session").groupBy("split_role").agg(F.countDistinct("session").alias("sessions"), F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@add("distinct_boundaries", "SELECT DISTINCT split_role, period_end FROM elig_")
def _(s: Steps) -> DataFrame:
    return s.elig.select("split_role", "period_end").distinct()


@add("audit_boundary_mismatch", "SELECT session, max(ts) AS last_ts, max(ts) FILTER (ts < period_end) AS last_inside FROM ev_ JOIN rolend_ USING (session) GROUP BY 1 HAVING max(ts) IS DISTINCT FROM max(ts) FILTER (ts < period_end)")
def _(s: Steps) -> DataFrame:
    rows = s.ev.join(s.roles, "session").groupBy("session").agg(F.max("ts").alias("last_ts"), F.max(F.when(F.col("ts") < F.col("period_end"), F.col("ts"))).alias("last_inside"))
    return rows.where(~F.col("last_ts").eqNullSafe(F.col("last_inside")))


@add("label_lists", "SELECT session, objective, string_agg(aid::VARCHAR, ' ' ORDER BY aid) AS items, count(DISTINCT aid) AS n FROM lab_ GROUP BY 1, 2")
def _(s: Steps) -> DataFrame:
    return s.lab.groupBy("session", "objective").agg(F.array_join(F.transform(F.array_sort(F.collect_list("aid")), lambda x: x.cast("string")), " ").alias("items"), F.countDistinct("aid").alias("n"))


@add("win_event_position", "SELECT session, event_index, event_position, n_events FROM elig_")
def _(s: Steps) -> DataFrame:
    return s.elig.select("session", "event_index", "event_position", "n_events")


@add("query_sampling", "SELECT session, split_role, prefix_events FROM samp_")
def _(s: Steps) -> DataFrame:
    return s.samp.select("session", "split_role", "prefix_events")


@add("session_roles", "SELECT session, first_ts, split_role, period_end FROM rolend_")
def _(s: Steps) -> DataFrame:
    return s.roles


@add("history_events", f"SELECT {EV} FROM hist_")
def _(s: Steps) -> DataFrame:
    return s.hist.select(*EV.split(", "))


@add("eligible_events", f"SELECT {EV}, split_role, period_end, event_position, n_events FROM elig_")
def _(s: Steps) -> DataFrame:
    return s.elig.select(*EV.split(", "), "split_role", "period_end", "event_position", "n_events")


@add("query_sessions", "SELECT session, split_role, period_end, n_events, prefix_events FROM qs_")
def _(s: Steps) -> DataFrame:
    return s.qs


@add("observed_events", f"SELECT {EV}, split_role FROM obs_")
def _(s: Steps) -> DataFrame:
    return s.obs.drop("period_end")


@add("labels", "SELECT session, split_role, objective, aid, label_ts, label_event_index FROM lab_")
def _(s: Steps) -> DataFrame:
    return s.lab


def _rebuilt_prefixes(s: Steps) -> DataFrame:
    """Prefixes rebuilt from raw events by filters on the sampled sessions, not by windows over clipped ones."""
    keys = s.samp.select("session", "split_role", "period_end", "prefix_events")
    return s.ev.join(keys, "session").where("event_index < prefix_events AND ts < period_end").select(*EV.split(", "), "split_role")


@add("audit_rebuild_prefixes", f"SELECT {EV}, split_role FROM obs_")
def _(s: Steps) -> DataFrame:
    return _rebuilt_prefixes(s)


@add("audit_rebuild_labels", """SELECT session, 'clicks' AS objective, aid, ts AS label_ts FROM qev_ WHERE event_position > prefix_events AND event_type = 0 QUALIFY row_number() OVER (PARTITION BY session ORDER BY event_index) = 1
    UNION ALL SELECT session, CASE event_type WHEN 1 THEN 'carts' ELSE 'orders' END, aid, min(ts) FROM qev_ WHERE event_position > prefix_events AND event_type > 0 GROUP BY session, event_type, aid""")
def _(s: Steps) -> DataFrame:
    rows = s.ev.join(s.samp.select("session", "period_end", "prefix_events"), "session").where("event_index >= prefix_events AND ts < period_end")
    click = rows.where("event_type = 0").groupBy("session").agg(F.min_by(F.struct("aid", "ts"), "event_index").alias("x")).select("session", F.lit("clicks").alias("objective"), "x.aid", F.col("x.ts").alias("label_ts"))
    rest = rows.where("event_type > 0").groupBy("session", corpus.objective_of(F.col("event_type")).alias("objective"), "aid").agg(F.min("ts").alias("label_ts"))
    return click.unionByName(rest)


@add("setop_except_all_audit", ", rebuilt_ AS (SELECT e.session, aid, ts, event_type, event_index, split_role FROM ev_ e JOIN samp_ USING (session) WHERE event_index < prefix_events AND ts < period_end), stored_ AS (SELECT session, aid, ts, event_type, event_index, split_role FROM obs_) SELECT 'missing' AS side, count(*) AS n FROM (SELECT session, aid, event_index FROM hist_ EXCEPT ALL SELECT session, aid, event_index FROM tail_) UNION ALL SELECT 'extra', count(*) FROM (SELECT session, aid, event_index FROM tail_ EXCEPT ALL SELECT session, aid, event_index FROM hist_) UNION ALL SELECT 'prefixes', (SELECT count(*) FROM ((FROM rebuilt_ EXCEPT ALL FROM stored_) UNION ALL (FROM stored_ EXCEPT ALL FROM rebuilt_)))")
def _(s: Steps) -> DataFrame:
    k = ["session", "aid", "event_index"]
    a, b = s.hist.select(*k), s.tail.select(*k)
    rebuilt, kept = _rebuilt_prefixes(s), s.obs.drop("period_end")
    differ = rebuilt.exceptAll(kept).unionByName(kept.exceptAll(rebuilt))
    sides = [("missing", a.exceptAll(b)), ("extra", b.exceptAll(a)), ("prefixes", differ)]
    out = [d.agg(F.count("*").alias("n")).select(F.lit(name).alias("side"), "n") for name, d in sides]
    return out[0].unionByName(out[1]).unionByName(out[2])


@add("history_tail", f"SELECT {EV} FROM tail_")
def _(s: Steps) -> DataFrame:
    return s.tail.select(*EV.split(", "))

