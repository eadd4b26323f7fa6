"""The whole matrix of features: a kernel per session for those that look at every event of a prefix, expressions for the others.

The kernel orders a prefix once and takes all six lengths from running sums, counts and maxima, where ``features.graph_features`` has
an aggregate for each; both give the same numbers.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from trailmix.operators import features
from trailmix.operators.features import ACTIONS, DECAYS, GRAPH, LENGTHS, STATISTICS, WEIGHTS
from trailmix.operators.graph import CHANNELS, HOUR
from trailmix.session import shipped

DEPTH = max(LENGTHS)
REPEAT_NAMES = [f"repeat_{a}_n{n}_{k}" for a, n in itertools.product(ACTIONS, LENGTHS) for k in ("count", "share", "last_position", "first_position", "span", "age_hours")]
REPEAT_NAMES += [f"repeat_{a}_h{h}_decay" for a, h in itertools.product(ACTIONS, DECAYS)]
GRAPH_NAMES = [f"graph_{c}_{a}_n{n}_{w}_{k}" for c, a, n, w in GRAPH for k in STATISTICS]


def names() -> list[str]:
    """All names in the order of the catalogue, without the expressions of the kernel's families."""
    history = [*features._counts(), *features._history("query_ts")]
    return [*features._single(), *features._summaries(), *features._context(), *history, *REPEAT_NAMES, *GRAPH_NAMES, *features._interaction()]


OUT = "session long, aid long, repeats long, repeat array<double>, graph array<double>"


def repeat_values(items: np.ndarray, aid: np.ndarray, age: np.ndarray, masks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(all occurrences, values in the order of REPEAT_NAMES) of each item in a prefix, newest event first."""
    top, n = min(len(aid), DEPTH), len(items)
    cut = np.minimum(LENGTHS, top) - 1
    place = np.arange(1, top + 1)[:, None]
    same = aid[:top, None] == items[None, :]
    parts = []
    for mask in masks:
        hit = same & mask[:top, None]
        count = np.cumsum(hit, axis=0)[cut].astype(float)
        met = count > 0
        first = np.maximum.accumulate(np.where(hit, place, 0), axis=0)[cut]
        last = np.minimum.accumulate(np.where(hit, place, DEPTH + 1), axis=0)[cut]
        youngest = np.minimum.accumulate(np.where(hit, age[:top, None], np.inf), axis=0)[cut]
        share = count / np.maximum(1, np.cumsum(mask[:top])[cut])[:, None]
        values = (count, share, np.where(met, last, -1), np.where(met, first, -1), np.where(met, first - last, 0), np.where(met, youngest, -1.0))
        parts.append(np.stack(values, axis=1).reshape(len(LENGTHS) * len(values), n))
    order = np.argsort(items)
    at = np.minimum(np.searchsorted(items, aid, sorter=order), n - 1)
    whose = order[at]
    known = np.flatnonzero(items[whose] == aid)
    for mask in masks:
        mine = known[mask[known]]
        parts.append(np.stack([np.bincount(whose[mine], np.exp(-age[mine] / h), n) for h in DECAYS]))
    return np.bincount(whose[known], minlength=n), np.concatenate(parts).T


def graph_values(n: int, age: np.ndarray, masks: np.ndarray, met: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """Values in the order of GRAPH_NAMES: items by features. ``met`` has the edges as (item, position, scores by channel); those that are missing are zeros."""
    top = min(len(age), DEPTH)
    cut = np.minimum(LENGTHS, top) - 1
    edges = np.zeros((top, n, len(CHANNELS)))
    item, position, scores = met
    edges[position - 1, item] = scores
    place = np.arange(1, top + 1)
    weights = {"uniform": np.ones(top), "position": 1.0 / np.sqrt(place), "hour": np.exp(-age[:top]), "six_hours": np.exp(-age[:top] / 6.0)}
    out = np.zeros((n, len(CHANNELS), len(masks), len(LENGTHS), len(WEIGHTS), len(STATISTICS)))
    for i, mask in enumerate(masks):
        for j, w in enumerate(WEIGHTS):
            x = weights[w] * mask[:top]
            weighed = edges * x[:, None, None]
            mass = np.maximum(np.cumsum(x)[cut], 1e-12)[:, None, None]
            total = np.cumsum(weighed, axis=0)[cut]
            mean = total / mass
            spread = np.sqrt(np.maximum(0.0, np.cumsum(edges * weighed, axis=0)[cut] / mass - mean * mean))
            most = np.maximum.accumulate(weighed, axis=0)[cut]
            for k, values in enumerate((total, mean, most, spread)):
                out[:, :, i, :, j, k] = values.transpose(1, 2, 0)
    return out.reshape(n, -1)


def _seen(ts: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hours before the newest event, and a mask of each action."""
    return (ts.max() - ts) / float(HOUR), np.stack([np.ones(len(ts), bool) if k is None else kind == k for k in ACTIONS.values()])


def session_values(candidates: np.ndarray, aid: np.ndarray, ts: np.ndarray, kind: np.ndarray, met: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Occurrences, repeat and graph values of a session's candidates; its events newest first."""
    age, masks = _seen(ts, kind)
    return *repeat_values(candidates, aid, age, masks), graph_values(len(candidates), age, masks, met)


def whole_sessions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows in order of their first column, session, cut between sessions only."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        session = batch.column(0).to_numpy()
        cut = int(np.searchsorted(session, session[-1]))  # the last session may go on in the next batch
        if cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        elif held and held[-1].column(0)[-1].as_py() != session[0]:
            yield pa.Table.from_batches(held)
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def _by_session(candidates: DataFrame, prefix: DataFrame, edges: DataFrame, values: Callable[..., tuple], output: Callable[..., pa.RecordBatch], schema: str | StructType) -> DataFrame:
    """``output`` of (session, aid, *values) of every candidate, where ``values`` gives arrays of a session's candidates, as session_values does.

    Candidates, events and the edges between them go to their session as rows of one table, in one shuffle; tasks take a session at a time.
    Candidates of a session are bounded by their budget, and edges by DEPTH events times the candidates.
    """
    shipped(candidates.sparkSession)
    zero, none = F.lit(0).cast("long"), F.lit(0.0)
    recent = prefix.where(F.col("pos") <= DEPTH).select("session", "pos", F.col("aid").alias("source_aid"))
    met = recent.join(edges.withColumnRenamed("target_aid", "aid"), "source_aid").join(candidates.select("session", "aid"), ["session", "aid"], "left_semi")
    scores = [f"{c}_score" for c in CHANNELS]
    rows = candidates.select("session", F.lit(0).alias("kind"), "aid", zero.alias("pos"), zero.alias("ts"), zero.alias("event_type"), *[none.alias(c) for c in scores])
    rows = rows.unionAll(prefix.select("session", F.lit(1), "aid", F.col("pos").cast("long"), "ts", F.col("event_type").cast("long"), none, none, none))
    rows = rows.unionAll(met.select("session", F.lit(2), "aid", F.col("pos").cast("long"), zero, zero, *scores))
    rows = rows.repartition("session").sortWithinPartitions("session", "kind", "pos", "aid")

    def solved(t: pa.Table) -> pa.RecordBatch | None:
        session, kind, aid, pos, ts, action = (t.column(i).to_numpy() for i in range(6))
        score = np.column_stack([t.column(6 + i).to_numpy() for i in range(len(CHANNELS))])
        starts = np.flatnonzero(np.append(True, session[1:] != session[:-1]))
        made = []
        for a, b in zip(starts, [*starts[1:], len(session)], strict=True):
            mine, seen, edge = (np.flatnonzero(kind[a:b] == k) + a for k in range(3))
            if not len(mine):
                continue
            if not len(seen):
                raise ValueError(f"session {session[a]} has candidates without events")
            items = aid[mine]
            where = np.searchsorted(items, aid[edge])  # candidates are in order of aid
            made.append((session[mine], items, *values(items, aid[seen], ts[seen], action[seen], (where, pos[edge], score[edge]))))
        if not made:
            return None
        return output(*(np.concatenate(x) for x in zip(*made, strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_sessions(batches):
            if (out := solved(t)) is not None:
                yield out

    return rows.mapInArrow(run, schema)


def kernel(candidates: DataFrame, prefix: DataFrame, edges: DataFrame) -> DataFrame:
    """(session, aid, repeats, repeat, graph) of every candidate, arrays in the order of REPEAT_NAMES and GRAPH_NAMES."""

    def output(s, i, n, r, g) -> pa.RecordBatch:
        as_lists = lambda m: pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, m.shape[1], dtype=np.int32)), pa.array(m.ravel()))
        return pa.RecordBatch.from_arrays([pa.array(s), pa.array(i), pa.array(n, pa.int64()), as_lists(r), as_lists(g)], names=["session", "aid", "repeats", "repeat", "graph"])

    return _by_session(candidates, prefix, edges, session_values, output, OUT)


def graph_sums(session: np.ndarray, pos: np.ndarray, age: np.ndarray, masks: np.ndarray, whose: np.ndarray, edges: tuple[np.ndarray, np.ndarray, np.ndarray], sessions: int) -> np.ndarray:
    """``graph_values`` of many sessions at once: features by items, for items that have an edge.

    ``session``, ``pos``, ``age`` and ``masks`` are of the events, in order of session and pos, ``whose`` has the items' sessions. ``edges`` are (item, event, scores
    by channel) in order of item, then event, and every item has one; so numbers are added in the order of positions, as in ``graph_values``.
    """
    item, event, scores = edges
    n, width = len(whose), len(CHANNELS)
    key = (item[:, None] * width + np.arange(width)).ravel()
    starts = np.flatnonzero(np.append(True, item[1:] != item[:-1]))
    weights = {"uniform": np.ones(len(pos)), "position": 1.0 / np.sqrt(pos), "hour": np.exp(-age), "six_hours": np.exp(-age / 6.0)}
    out = np.empty((width, len(masks), len(LENGTHS), len(WEIGHTS), len(STATISTICS), n))
    shorter = (0, *LENGTHS)
    for i, mask in enumerate(masks):
        for k, length in enumerate(LENGTHS):
            some = mask & (pos <= length)
            if k and not (mask & (pos > shorter[k]) & (pos <= length)).any():
                out[:, i, k] = out[:, i, k - 1]  # nothing is added
                continue
            for j, w in enumerate(WEIGHTS):
                x = np.where(some, weights[w], 0.0)
                mass = np.maximum(np.bincount(session, x, sessions), 1e-12)[whose][:, None]
                weighed = scores * x[event][:, None]
                total = np.bincount(key, weighed.ravel(), n * width).reshape(n, width)
                squares = np.bincount(key, (scores * weighed).ravel(), n * width).reshape(n, width)
                mean = total / mass
                values = (total, mean, np.maximum(np.maximum.reduceat(weighed, starts), 0.0), np.sqrt(np.maximum(0.0, squares / mass - mean * mean)))
                for at, v in enumerate(values):
                    out[:, i, k, j, at] = v.T
    return out.reshape(-1, n)


def graph_columns(candidates: DataFrame, prefix: DataFrame, edges: DataFrame, digits: int, nudge: float, task_rows: int = 25_000, batch_rows: int = 512) -> DataFrame:
    """session, aid and all graph features, rounded after ``nudge`` is added. Tasks round arrays: Spark's round takes a decimal of every value, which at 1,152 a row is most of the job.

    Events bring the edges that leave their item along and meet the candidates in the session's task, so that nothing is joined by session. Items without an edge
    are zeros and are not computed. Tasks go by the number of ``candidates``; batches are small, as the JVM takes them row by row out of 1,154 columns.
    """
    spark, scale = candidates.sparkSession, 10.0**digits
    shipped(spark)
    zero, none, no_aids = F.lit(0).cast("long"), F.lit(None).cast("array<double>"), F.lit(None).cast("array<long>")
    leaving = edges.groupBy(F.col("source_aid").alias("aid")).agg(F.collect_list(F.struct("target_aid", *[f"{c}_score" for c in CHANNELS])).alias("_out"))
    scores = F.flatten(F.transform("_out", lambda x: F.array(*[x[f"{c}_score"] for c in CHANNELS])))
    met = prefix.join(leaving.select("aid", F.col("_out.target_aid").alias("to"), scores.alias("scores")), "aid", "left")
    near = F.col("pos") <= DEPTH
    rows = candidates.select("session", F.lit(0).alias("kind"), "aid", zero.alias("pos"), zero.alias("ts"), zero.alias("event_type"), no_aids.alias("to"), none.alias("scores"))
    rows = rows.unionAll(met.select("session", F.lit(1), "aid", F.col("pos").cast("long"), "ts", F.col("event_type").cast("long"), F.when(near, F.col("to")), F.when(near, F.col("scores"))))
    tasks = max(spark.sparkContext.defaultParallelism, -(-candidates.count() // task_rows))
    rows = rows.repartition(tasks, "session").sortWithinPartitions("session", "kind", "pos", "aid")
    schema = candidates.select("session", "aid").schema
    for name in GRAPH_NAMES:
        schema = schema.add(name, "double")

    def solved(t: pa.Table) -> pa.RecordBatch | None:
        session, kind, aid, pos, ts, action = (t.column(i).to_numpy() for i in range(6))
        index = np.cumsum(np.append(False, session[1:] != session[:-1]))
        mine, seen = np.flatnonzero(kind == 0), np.flatnonzero(kind == 1)
        if not len(mine):
            return None
        sessions, whose, at = int(index[-1]) + 1, index[mine], index[seen]
        if len(lost := whose[np.bincount(at, minlength=sessions)[whose] == 0]):
            raise ValueError(f"session {session[np.searchsorted(index, lost[0])]} has candidates without events")
        newest = np.full(sessions, np.iinfo(np.int64).min)
        np.maximum.at(newest, at, ts[seen])
        age = (newest[at] - ts[seen]) / float(HOUR)
        masks = np.stack([np.ones(len(seen), bool) if k is None else action[seen] == k for k in ACTIONS.values()])
        lists, values = (t.column(i).combine_chunks() for i in (6, 7))
        event = np.repeat(np.arange(len(seen)), lists.value_lengths().fill_null(0).to_numpy()[seen])
        to, items = lists.flatten().to_numpy(), np.unique(aid[mine])
        # candidates are in order of session and aid
        key, code = whose * len(items) + np.searchsorted(items, aid[mine]), np.minimum(np.searchsorted(items, to), len(items) - 1)
        wanted = at[event] * len(items) + code
        place = np.minimum(np.searchsorted(key, wanted), len(key) - 1)
        found = np.flatnonzero((key[place] == wanted) & (items[code] == to))
        found = found[np.argsort(place[found], kind="stable")]
        columns = np.zeros((len(GRAPH_NAMES), len(mine)))
        if len(found):
            some, item = np.unique(place[found], return_inverse=True)
            given = values.flatten().to_numpy().reshape(-1, len(CHANNELS))[found]
            made = graph_sums(at, pos[seen], age, masks, whose[some], (item, event[found], given), sessions)
            columns[:, some] = np.floor((made + nudge) * scale + 0.5) / scale
        return pa.RecordBatch.from_arrays([pa.array(session[mine]), pa.array(aid[mine]), *map(pa.array, columns)], names=["session", "aid", *GRAPH_NAMES])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_sessions(batches):
            session = t.column(0).to_numpy()
            starts = np.flatnonzero(np.append(True, session[1:] != session[:-1]))
            cuts = starts[np.flatnonzero(np.diff(starts // (4 * batch_rows), prepend=-1))]  # some sessions at a time
            for a, b in zip(cuts, [*cuts[1:], len(session)], strict=True):
                if (out := solved(t.slice(a, b - a))) is not None:
                    for k in range(0, out.num_rows, batch_rows):
                        yield out.slice(k, batch_rows)

    return rows.mapInArrow(run, schema)


def matrix(candidates: DataFrame, prefix: DataFrame, edges: DataFrame, stats: DataFrame) -> DataFrame:
    """session, aid, candidate_position and all 1,482 features in the order of the catalogue; a value that is not finite fails the job. ``edges`` are scaled.

    The columns are put together in tasks: a plan of so many expressions would take longer to optimise than to run.
    """
    wanted = names()
    query = prefix.groupBy("session").agg(F.max("ts").alias("query_ts"))
    source, context = features.source_features(candidates), features.context_features(prefix)
    history = features.history_features(candidates.select("session", "aid").join(query, "session"), stats).drop("query_ts")
    found = kernel(candidates, prefix, edges)
    rows = source.join(context, "session").join(history, ["session", "aid"]).join(found, ["session", "aid"])
    rows = rows.select("*", *[v.alias(k) for k, v in features._interaction().items()])
    where = {n: ("repeat", i) for i, n in enumerate(REPEAT_NAMES)} | {n: ("graph", i) for i, n in enumerate(GRAPH_NAMES)}
    plain = [n for n in wanted if n not in where]
    rows = rows.select("session", "aid", "candidate_position", "repeat", "graph", *[F.col(n).cast("double").alias(n) for n in plain])
    schema = rows.select("session", "aid", "candidate_position").schema
    for n in wanted:
        schema = schema.add(n, "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            arrays = {c: np.asarray(batch.column(3 + i).flatten()).reshape(n, -1) if n else np.zeros((0, 2000)) for i, c in enumerate(("repeat", "graph"))}
            at = {name: 5 + i for i, name in enumerate(plain)}
            values = [arrays[where[name][0]][:, where[name][1]] if name in where else batch.column(at[name]).to_numpy(zero_copy_only=False) for name in wanted]
            if not all(np.isfinite(v).all() for v in values):
                raise ValueError("feature matrix contains non-finite values")
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *map(pa.array, values)], names=schema.names)

    return rows.mapInArrow(run, schema)
