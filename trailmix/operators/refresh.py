"""Deployment state that later events are merged into: counts by item, action and hour, session tails, and edge totals that add by session."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmix.operators import graph
from trailmix.operators.features import ACTIONS
from trailmix.operators.graph import CHANNELS, HORIZONS, HOUR


@dataclass
class State:
    """All that candidates and features need of the past, as of a cutoff on a whole hour."""

    cutoff: int
    hours: DataFrame
    tail: DataFrame
    totals: DataFrame

    @property
    def statistics(self) -> DataFrame:
        return statistics(self.hours, self.cutoff)

    @property
    def edges(self) -> DataFrame:
        return graph.pruned(self.totals)


def _whole(cutoff: int) -> int:
    if cutoff % HOUR:
        raise ValueError("a cutoff must lie on a whole hour")
    return cutoff // HOUR


def hour_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("aid", "event_type", F.floor(F.col("ts") / HOUR).alias("hour")).agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def merged_hours(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).groupBy("aid", "event_type", "hour").agg(F.sum("n").alias("n"), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"))


def statistics(hours: DataFrame, cutoff: int) -> DataFrame:
    """The columns of ``graph.item_statistics`` as of any whole hour that the counts reach."""
    now, n = _whole(cutoff), F.col("n")

    def count(of: Column, name: str) -> Column:
        return F.coalesce(F.sum(F.when(of, n)), F.lit(0)).alias(name)

    aggs = [F.min("first_ts").alias("history_first_ts"), F.max("last_ts").alias("history_last_ts")]
    for name, kind in ACTIONS.items():
        of = F.lit(True) if kind is None else F.col("event_type") == kind
        aggs.append(count(of, f"hist_{name}_all"))
        aggs += [count(of & (F.col("hour") >= now - h), f"hist_{name}_h{h}") for h in HORIZONS]
    return hours.groupBy("aid").agg(*aggs)


def _contributions(tails: DataFrame, sign: int) -> DataFrame:
    pairs = graph.unique_pairs(graph.pairs(tails))
    return pairs.select("source_aid", "target_aid", *[(F.col(f"{c}_w") * sign).alias(f"{c}_w") for c in CHANNELS])


def built(events: DataFrame, cutoff: int) -> State:
    """The state from all events before the cutoff."""
    _whole(cutoff)
    past = events.where(F.col("ts") < cutoff)
    tail = graph.tail(past)
    return State(cutoff, hour_counts(past), tail, graph.totals(graph.unique_pairs(graph.pairs(tail))))


def refreshed(state: State, events: DataFrame, cutoff: int) -> State:
    """The state as of a later cutoff; of ``events`` only those between the two are read.

    Sessions that go on take their old contribution out of the totals and put the new one in; weights are whole numbers, so nothing is
    left of the old one. All other rows stay as they are. Events before the state's cutoff are not looked at again.
    """
    if cutoff < state.cutoff:
        raise ValueError("a state cannot go back")
    _whole(cutoff)
    later = events.where((F.col("ts") >= state.cutoff) & (F.col("ts") < cutoff)).select("session", "aid", "ts", "event_type", "event_index")
    touched = later.select("session").distinct()
    before = state.tail.join(touched, "session", "left_semi")
    after = graph.tail(before.select(*later.columns).unionByName(later))
    tail = state.tail.join(touched, "session", "left_anti").select(*later.columns).unionByName(after.select(*later.columns))
    changes = state.totals.select("source_aid", "target_aid", *[f"{c}_w" for c in CHANNELS]).unionByName(_contributions(before, -1)).unionByName(_contributions(after, 1))
    totals = graph.totals(changes).where(F.col("time_w") > 0)  # every session's weight is above zero
    return State(cutoff, merged_hours(state.hours, hour_counts(later)), tail, totals)


def deployable(state: State, observed: DataFrame) -> DataFrame:
    """(history_last_ts, first_ts, shared_sessions) for an observed input; it must begin at or after the cutoff with sessions of its own, or the job fails."""
    shared = observed.select("session").distinct().join(state.tail.select("session").distinct(), "session").agg(F.count("*").alias("n")).scalar()
    first = observed.agg(F.min("ts").alias("t")).scalar()
    rows = state.hours.agg(F.max("last_ts").alias("history_last_ts")).select("history_last_ts", first.alias("first_ts"), shared.alias("shared_sessions"))
    bad = F.col("history_last_ts").isNull() | F.col("first_ts").isNull() | (F.col("history_last_ts") >= F.col("first_ts")) | (F.col("shared_sessions") > 0)
    return rows.where(F.when(bad, F.raise_error(F.lit("history must precede disjoint observed sessions")).cast("boolean")).otherwise(True))
