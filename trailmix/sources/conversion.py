"""Session lines to typed Parquet parts: numbered in order of the source, cut at session ends, committed one after the other."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trailmix.sources import files
from trailmix.sources.parts import Parts
from trailmix.sources.sessions import RAW, code_of

#: The index of an event within its session has 16 bits.
MOST_EVENTS = 65_535
EVENTS = "session bigint, aid bigint, ts bigint, event_type bigint, event_index bigint"


def _fails(condition, text) -> F.Column:
    return F.when(condition, F.raise_error(text).cast("boolean")).otherwise(F.lit(True))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Session records with their place in the source: file, block of the file, and line within it.

    An empty or malformed line, and a session or event that breaks the contract, fails the job.
    """
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line")
    )
    lines = lines.where(_fails(F.trim("value") == "", F.lit("empty source line")))
    rows = lines.select("file", "block", "line", F.from_json("value", RAW, {"mode": "FAILFAST"}).alias("r")).select("file", "block", "line", "r.*")
    named = lambda text: F.concat(F.lit("session "), F.coalesce(F.col("session").cast("string"), F.lit("?")), F.lit(f": {text}"))
    bad = lambda f: F.coalesce(F.exists("events", f), F.lit(False))
    rules = [
        (F.col("session").isNull() | (F.col("session") < 0), "invalid session identifier"),
        (F.col("events").isNull() | (F.size("events") < 1), "no events"),
        (F.size("events") > MOST_EVENTS, "more events than an index holds"),
        (bad(lambda e: e["aid"].isNull() | (e["aid"] < 0)), "invalid item"),
        (bad(lambda e: e["ts"].isNull() | (e["ts"] < 0)), "invalid timestamp"),
        (bad(lambda e: code_of(e["type"]).isNull()), "invalid action"),
    ]
    for condition, text in rules:
        rows = rows.where(_fails(condition, named(text)))
    return rows.withColumn("n", F.size("events").cast("long"))


def cut(rows: DataFrame, events_per_part: int, done: tuple[int, int, int] = (0, 0, 0), max_sessions: int | None = None) -> DataFrame:
    """``rows`` with ``place`` (sessions before, in source order), ``part`` and ``total`` (sessions of the source), from where ``done`` (sessions, events, parts) ends to the session limit.

    Two levels of running sums: over the blocks of the source (one row each), and over the lines of a block. A part is what begins between two
    multiples of a step of events. As the step is the asked size and the longest session but one event, every part but the last
    has at least the asked number of events, and no session is split.
    """
    inside = Window.partitionBy("file", "block").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("file", "block").agg(F.sum("n").alias("_events"), F.count("*").alias("_sessions"), F.max("n").alias("_longest"))
    before = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)  # a row a block
    sums = {f"_{c}_before": F.coalesce(F.sum(f"_{c}").over(before), F.lit(0)) for c in ("events", "sessions")}
    known = blocks.select("file", "block", *[v.alias(k) for k, v in sums.items()], F.max("_longest").over(Window.partitionBy()).alias("_most"), F.sum("_sessions").over(Window.partitionBy()).alias("total"))
    own = rows.withColumns({"_e": F.coalesce(F.sum("n").over(inside), F.lit(0)), "_s": F.coalesce(F.count("n").over(inside), F.lit(0))})
    placed = own.join(known, ["file", "block"]).withColumn("place", F.col("_s") + F.col("_sessions_before"))
    sessions, events, parts = done
    since = F.col("_e") + F.col("_events_before") - events
    placed = placed.where((F.col("place") >= sessions) & (F.lit(max_sessions is None) | (F.col("place") < (max_sessions or 0))))
    return placed.select("place", (parts + F.floor(since / (F.col("_most") + (events_per_part - 1)))).cast("int").alias("part"), "total", "session", "events")


def flat(rows: DataFrame) -> DataFrame:
    """Events of numbered sessions with their part."""
    each = rows.select("part", "place", "session", F.posexplode("events").alias("event_index", "e"))
    return each.select("session", "e.aid", "e.ts", code_of(F.col("e.type")).cast("long").alias("event_type"), F.col("event_index").cast("long").alias("event_index"), "place", "part")


def convert(spark: SparkSession, source: str, folder: str, identity: tuple[str, str], events_per_part: int = 1_000_000, max_sessions: int | None = None, each: int = 64) -> dict:
    """Convert the lines of ``source`` into parts under ``folder``; the manifest of the conversion.

    Parts are written ``each`` a job and committed in a log; a broken run goes on from there. At ``max_sessions`` in all it stops with
    status ``partial``, and a later call goes on behind them; once ``complete``, a call does nothing. ``identity`` (manifest id, digest) names the
    source: a folder that was begun from another source or with another part size is refused. The numbered sessions of
    a run are staged on the same storage, sorted by part, so that each job reads only its parts.
    """
    if events_per_part < 1 or max_sessions is not None and max_sessions < 1:
        raise ValueError("part sizes and session limits must be positive")
    contract = json.dumps({"source": source, "identity": list(identity), "events_per_part": events_per_part}, sort_keys=True)
    folder = folder.rstrip("/")
    parent, name = f"{folder}.manifest.json".rsplit("/", 1)
    told = {"contract": contract, "sessions": 0, "events": 0, "parts": 0, "status": "running", "run": None}
    if files.names(spark, parent, name):
        told = json.loads(files.read_text(spark, f"{parent}/{name}"))
    if told["contract"] != contract:
        raise RuntimeError("the conversion was begun from another source or with another part size")
    parts = Parts(spark, folder, contract, told["parts"])
    if told["status"] == "complete":
        return told
    schema = "place bigint, part int, total bigint, session bigint, " + RAW.split(", ", 1)[1]
    if told["run"] is None:
        staged = f"{folder}.staged-{told['sessions']}"
        done = (told["sessions"], told["events"], told["parts"])
        placed = cut(numbered_lines(spark, source), events_per_part, done, max_sessions)
        placed.repartitionByRange("part", "place").sortWithinPartitions("part", "place").write.mode("overwrite").option("compression", "zstd").parquet(staged)
        n = spark.read.schema(schema).parquet(staged).agg(F.max("part").alias("last"), F.count("*").alias("sessions"), F.sum(F.size("events")).alias("events"), F.max("total").alias("total")).first()
        sessions = told["sessions"] + n["sessions"]
        told["run"] = {"staged": staged, "sessions": sessions, "events": told["events"] + (n["events"] or 0), "parts": told["parts"] if n["last"] is None else n["last"] + 1}
        told["run"]["status"] = "complete" if n["total"] is None and not (max_sessions and sessions >= max_sessions) or n["total"] == sessions else "partial"
        files.write_text(spark, f"{parent}/{name}", json.dumps(told, sort_keys=True))
    run = told["run"]
    table = spark.read.schema(schema).parquet(run["staged"])
    parts = Parts(spark, folder, contract, run["parts"])
    parts.write(lambda some: flat(table.where(F.col("part").between(some[0], some[-1]) & F.col("part").isin(some))), each, ("place", "event_index"))
    told |= {k: run[k] for k in ("sessions", "events", "parts", "status")} | {"run": None}
    files.write_text(spark, f"{parent}/{name}", json.dumps(told, sort_keys=True))
    at, system = files.file_system(spark, run["staged"])
    system.delete(at, True)
    return told


def converted(spark: SparkSession, folder: str, told: dict) -> DataFrame:
    """The events of a conversion; their number must be that of its manifest."""
    rows = Parts(spark, folder, told["contract"], told["parts"]).read(EVENTS + ", place bigint, part int")
    if (n := rows.count()) != told["events"]:
        raise RuntimeError(f"{n} events, {told['events']} in the manifest")
    return rows.drop("place", "part")
