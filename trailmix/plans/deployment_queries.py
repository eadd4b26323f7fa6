"""Queries of ingestion with parts, deployment refresh, replay audit and the single-file submission."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from trailmix import canon
from trailmix.operators import graph, refresh, replay
from trailmix.plans.base import Steps, prelude
from trailmix.plans.corpus_queries import EV, EV_ALL
from trailmix.plans.retrieval_queries import COUNTS
from trailmix.plans.retrieval_queries import submission as submitted
from trailmix.sources import conversion, files, manifests, sessions, submission

QUERIES: dict[str, object] = {}
ORACLES: dict[str, str] = {}


def add(name: str, sql: str | None = None, cutoff: int | None = None):
    def register(f):
        QUERIES[name] = lambda spark, sf_dir: f(Steps(spark, sf_dir))
        if sql:
            ORACLES[name] = (prelude().replace(str(canon.HISTORY_END), str(cutoff)) if cutoff else prelude()) + sql
        return f

    return register


def scratch(s: Steps, name: str) -> str:
    """A folder of this session on shared storage; it goes with the JVM."""
    path = f"{files.scratch(s.spark)}/{name}-{uuid.uuid4().hex}"
    at, system = files.file_system(s.spark, path)
    system.mkdirs(at)
    system.deleteOnExit(at)
    return path


@add("convert_sessions", EV_ALL)
def _(s: Steps) -> DataFrame:
    """Session lines to parts in two calls, the first of which stops at a session limit; read back against their manifest."""
    base = scratch(s, "conversion")
    sessions.to_lines(s.raw).write.text(f"{base}/raw")
    told = manifests.build(s.spark, [f"{base}/raw"], "events")
    identity = (told["manifest_id"], manifests.manifest_id("files", told["files"]))
    half = max(1, s.roles.count() // 2)
    conversion.convert(s.spark, f"{base}/raw", f"{base}/events", identity, 5_000, half)
    done = conversion.convert(s.spark, f"{base}/raw", f"{base}/events", identity, 5_000)
    return conversion.converted(s.spark, f"{base}/events", done)


@add("dataset_manifest")
def _(s: Steps) -> DataFrame:
    """Rows only: the identity of the tables' files, with how many there are and their bytes."""
    told = manifests.build(s.spark, [f"{s.dir}/*.parquet"], "tables")
    row = (told["source"], told["manifest_id"], len(told["files"]), sum(r["size_bytes"] for r in told["files"]))
    return s.spark.createDataFrame([row], "source string, manifest_id string, n_files long, size_bytes long")


@add("input_attestation")
def _(s: Steps) -> DataFrame:
    """Rows only: the events' files against a manifest written before; a file that is missing, unknown or changed fails the job."""
    base, pattern = scratch(s, "attestation"), f"{s.dir}/events.parquet"
    manifests.write(s.spark, manifests.build(s.spark, [pattern], "events"), f"{base}/manifest.json")
    told = manifests.read(s.spark, f"{base}/manifest.json")
    row = (manifests.attested(s.spark, told, pattern), len(told["files"]))
    return s.spark.createDataFrame([row], "manifest_id string, n_files long")


def refreshed(s: Steps) -> refresh.State:
    """The state of the history's end, kept, and taken to the end of the selection period in two steps."""
    state = refresh.built(s.ev, canon.HISTORY_END)
    state = refresh.State(state.cutoff, *[s._kept(f"state-{name}", lambda df=df: df) for name, df in (("hours", state.hours), ("tail", state.tail), ("totals", state.totals))])
    for cutoff in (canon.FIT_END, canon.SELECTION_END):
        state = refresh.refreshed(state, s.ev, cutoff)
    return state


@add("refreshed_statistics", f"SELECT aid, history_first_ts, history_last_ts, {COUNTS} FROM stats_", canon.SELECTION_END)
def _(s: Steps) -> DataFrame:
    return refreshed(s).statistics


@add("refreshed_tail", f"SELECT {EV} FROM tail_", canon.SELECTION_END)
def _(s: Steps) -> DataFrame:
    return refreshed(s).tail.select(*EV.split(", "))


@add("refreshed_graph", "SELECT source_aid, target_aid, time_w / 1e9::DOUBLE AS time_score, cart_w / 2e10::DOUBLE AS cart_score, order_w / 2e10::DOUBLE AS order_score FROM graph_", canon.SELECTION_END)
def _(s: Steps) -> DataFrame:
    return graph.scaled(refreshed(s).edges)


SUBMITTED = "SELECT session || '_' || objective AS session_type, string_agg(aid::VARCHAR, ' ' ORDER BY rank) AS labels FROM recs_ "


@add("replay_audit", SUBMITTED + """WHERE session IN (SELECT session FROM (SELECT DISTINCT session FROM pre_)
    ORDER BY ('0x' || substr(md5(session || '|replay'), 1, 12))::BIGINT, session LIMIT 256) GROUP BY session, objective""")
def _(s: Steps) -> DataFrame:
    """256 sessions replayed over plain arrays; a difference from the submitted rows fails the job."""
    found = files.kept(replay.replay(s.pre, s.edges, s.pop), "replayed")
    wrong = replay.differences(found, submitted(s)).limit(1).collect()
    if wrong:
        raise RuntimeError(f"the replay differs from the submission at {wrong[0]['session_type']}")
    return found


@add("single_file_submission", SUBMITTED + "GROUP BY session, objective")
def _(s: Steps) -> DataFrame:
    """The submission as one gzip file, read back."""
    path = f"{scratch(s, 'submission')}/submission.csv.gz"
    submission.write_single(submitted(s), path)
    return submission.read_single(s.spark, path)


@add("csv_export", SUBMITTED + "GROUP BY session, objective")
def _(s: Steps) -> DataFrame:
    """The submission as CSV parts, read back."""
    path = f"{scratch(s, 'export')}/csv"
    files.write_csv(submitted(s), path)
    return files.read_csv(s.spark, path, "session_type string, labels string")
