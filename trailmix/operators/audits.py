"""Audits that rebuild from raw events what is stored, and recompute reported numbers from counts."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmix.operators.corpus import objective_of
from trailmix.operators.metrics import K, WEIGHTS, weight_of


def rebuilt(events: DataFrame, boundaries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(prefixes, labels) from raw events and the ledger's boundaries alone: session, split_role, observed_last_index, period_end."""
    rows = events.join(boundaries, "session").where(F.col("ts") < F.col("period_end"))
    prefixes = rows.where(F.col("event_index") <= F.col("observed_last_index")).select("session", "aid", "ts", "event_type", "event_index", "split_role")
    future = rows.where(F.col("event_index") > F.col("observed_last_index"))
    # a click counts once a session, other actions once a session and item: the key of a click leaves the item out
    key = F.when(F.col("event_type") != 0, F.col("aid"))
    first = Window.partitionBy("session", "event_type", key).orderBy("event_index")
    labels = future.withColumn("_n", F.row_number().over(first)).where("_n = 1")
    return prefixes, labels.select("session", "split_role", objective_of(F.col("event_type")).alias("objective"), "aid", F.col("ts").alias("label_ts"), F.col("event_index").alias("label_event_index"))


def both_ways(kind: str, made: DataFrame, stored: DataFrame) -> DataFrame:
    """(kind, rebuilt, stored, rebuilt_minus_stored, stored_minus_rebuilt): rows of each side, and those without a match on the other, repeats counted."""
    columns = made.columns
    sides = made.withColumns({"_m": F.lit(1), "_s": F.lit(0)}).unionByName(stored.select(*columns).withColumns({"_m": F.lit(0), "_s": F.lit(1)}))
    sums = sides.groupBy(*columns).agg(F.sum("_m").alias("m"), F.sum("_s").alias("s"))
    zero = F.lit(0).cast("bigint")
    total = lambda c, n: F.coalesce(F.sum(c), zero).alias(n)
    return sums.agg(
        total(F.col("m"), "rebuilt"), total(F.col("s"), "stored"),
        total(F.greatest(F.col("m") - F.col("s"), zero), "rebuilt_minus_stored"), total(F.greatest(F.col("s") - F.col("m"), zero), "stored_minus_rebuilt"),
    ).select(F.lit(kind).alias("kind"), "rebuilt", "stored", "rebuilt_minus_stored", "stored_minus_rebuilt")


def boundary_faults(events: DataFrame, boundaries: DataFrame) -> DataFrame:
    """(sessions, overlapping, moved): sessions of the ledger, those of more than one role or boundary, and those whose first or query time the events do not have."""
    rows = events.join(boundaries, "session").where(F.col("ts") < F.col("period_end"))
    seen = rows.groupBy("session").agg(F.min("ts").alias("a"), F.min("first_ts").alias("b"), F.max(F.when(F.col("event_index") <= F.col("observed_last_index"), F.col("ts"))).alias("c"), F.min("query_ts").alias("d"))
    moved = seen.where(~(F.col("a").eqNullSafe(F.col("b")) & F.col("c").eqNullSafe(F.col("d")))).agg(F.count("*").alias("n")).scalar()
    each = boundaries.groupBy("session").agg(F.count("*").alias("k"))
    return each.agg(F.count("*").alias("sessions"), F.count_if(F.col("k") > 1).alias("overlapping")).withColumn("moved", moved)


def frontier(candidates: DataFrame, labels: DataFrame, ledger: DataFrame, budgets: tuple[int, ...], top: int = K) -> DataFrame:
    """(session, objective, recall_denominator, ceilings): hits within each budget of candidates, capped at ``top``, in the order of ``budgets``."""
    if not budgets or any(b < 1 for b in budgets) or list(budgets) != sorted(set(budgets)):
        raise ValueError("budgets must be positive and rise")
    met = candidates.select("session", "aid", "candidate_position").join(labels.select("session", "objective", "aid"), ["session", "aid"])
    counts = met.groupBy("session", "objective").agg(*[F.count_if(F.col("candidate_position") <= b).alias(f"_{b}") for b in budgets])
    rows = ledger.select("session", "objective", "recall_denominator").join(counts, ["session", "objective"], "left")
    capped = [F.least(F.lit(top), F.coalesce(f"_{b}", F.lit(0))).cast("bigint") for b in budgets]
    return rows.select("session", "objective", "recall_denominator", F.array(*capped).alias("ceilings"))


def ceiling_faults(ceilings: DataFrame, hits: DataFrame) -> DataFrame:
    """Per objective: queries, those whose ceilings fall as budgets rise or exceed the denominator, those with more hits than the last ceiling, and metrics out of their bounds."""
    rows = ceilings.join(hits.select("session", "objective", "hits", "ndcg", "mrr", "hit_rate", "eligible"), ["session", "objective"], "full")
    c = F.col("ceilings")
    falling = F.exists(F.zip_with(F.slice(c, 1, F.size(c) - 1), F.slice(c, 2, F.size(c) - 1), lambda a, b: a > b), lambda x: x)
    bounded = [F.col(m).between(-1e-12, 1 + 1e-12) for m in ("ndcg", "mrr", "hit_rate")]
    odd = ~(bounded[0] & bounded[1] & bounded[2]) | (F.col("hit_rate") != (F.col("hits") > 0).cast("bigint")) | (F.col("eligible") != (F.col("recall_denominator") > 0).cast("bigint"))
    count = lambda e, n: F.count_if(F.coalesce(e, F.lit(True))).alias(n)  # noqa: E731  a row that one side lacks is a fault
    return rows.groupBy("objective").agg(
        F.count("*").alias("queries"), count(falling, "not_nested"), count(F.element_at(c, -1) > F.col("recall_denominator"), "beyond_denominator"),
        count(F.col("hits") > F.element_at(c, -1), "beyond_ceiling"), count(odd, "odd_metrics"),
    )


SLICES = {"overall": (0, None), "0_to_4_events": (0, 4), "5_or_more_events": (5, None)}


def shortfalls(hits: DataFrame, pool: DataFrame, top: int = K) -> DataFrame:
    """Per slice of prefix lengths and objective: what the candidates could reach, what the ranking missed of it, and what retrieval missed.

    ``pool`` counts labels among the candidates of a (session, objective). Hits, ranking and retrieval shortfall add up to the denominator.
    """
    rows = hits.join(pool.select("session", "objective", F.col("n").alias("_pool")), ["session", "objective"], "left")
    rows = rows.withColumn("_reach", F.least(F.lit(top), F.coalesce("_pool", F.lit(0))).cast("bigint"))
    fits = [F.when((F.col("observed_events") >= low) & (F.lit(high is None) | (F.col("observed_events") <= (high or 0))), F.lit(name)) for name, (low, high) in SLICES.items()]
    sliced = rows.withColumn("slice", F.explode(F.array_compact(F.array(*fits))))
    sums = sliced.groupBy("slice", "objective").agg(
        F.count("*").alias("sessions"), F.count_if(F.col("recall_denominator") > 0).alias("active"), F.sum("recall_denominator").alias("denominator"),
        F.sum("hits").alias("hits"), F.sum("_reach").alias("candidate_hits"),
    )
    fault = (F.col("hits") > F.col("candidate_hits")) | (F.col("candidate_hits") > F.col("denominator"))
    sums = sums.where(F.when(fault, F.raise_error(F.lit("counts of hits do not reconcile")).cast("boolean")).otherwise(True))
    return sums.withColumns({"ranking_shortfall": F.col("candidate_hits") - F.col("hits"), "retrieval_shortfall": F.col("denominator") - F.col("candidate_hits")})


def weighted_shortfalls(found: DataFrame) -> DataFrame:
    """Per slice the weighted recall, candidate oracle and shortfalls, and the weighted mass of objectives that have a denominator."""
    some, weight = F.col("denominator") > 0, weight_of(F.col("objective"))
    share = lambda c: F.sum(F.when(some, weight * F.col(c) / F.col("denominator")).otherwise(0.0))
    return found.groupBy("slice").agg(
        share("hits").alias("weighted_recall"), share("candidate_hits").alias("weighted_candidate_oracle"), share("ranking_shortfall").alias("weighted_ranking_shortfall"),
        share("retrieval_shortfall").alias("weighted_retrieval_shortfall"), F.sum(F.when(some, weight).otherwise(0.0)).alias("weighted_evaluable_mass"),
    )


def weighted_objective(recalls: dict[str, float], weights: dict[str, float] | None = None) -> float:
    """The weighted sum of recalls; weights must name the same objectives and add up to one."""
    weights = WEIGHTS if weights is None else weights
    if set(recalls) != set(weights):
        raise ValueError("every objective needs a recall and a weight")
    if abs(sum(weights.values()) - 1.0) > 1e-9 or any(w < 0 for w in weights.values()):
        raise ValueError("weights must not be negative and add up to one")
    return sum(weights[o] * recalls[o] for o in weights)


def evidence(report: DataFrame) -> DataFrame:
    """(objective, hits, denominator, recall) of a published report recomputed from its counts; a recall or weighted score that does not follow from them fails the job."""
    again = F.col("hits") / F.col("denominator")
    whole = F.sum(weight_of(F.col("objective")) * again).over(Window.partitionBy())  # three rows
    wrong = (F.abs(again - F.col("recall")) > 1e-12) | (F.abs(whole - F.col("weighted")) > 1e-9)
    rows = report.withColumn("_wrong", wrong)
    return rows.where(F.when(F.col("_wrong"), F.raise_error(F.lit("the report does not follow from its counts")).cast("boolean")).otherwise(True)).drop("_wrong")


def available(prefix: DataFrame, cutoff: int) -> DataFrame:
    """``prefix``; an event before the cutoff of the fitted history fails the job, as history would hold what a query shows."""
    early = F.col("ts") < cutoff
    return prefix.where(F.when(early, F.raise_error(F.lit("a query precedes the cutoff of the fitted history")).cast("boolean")).otherwise(True))


_OFFSET = r"(Z|[+-]\d{2}:?\d{2})$"


def epoch_ms(text: str) -> int:
    """Milliseconds of an ISO-8601 time, which must name its zone."""
    moment = datetime.fromisoformat(text)
    if moment.utcoffset() is None:
        raise ValueError("times need an explicit zone")
    return round(moment.timestamp() * 1000)


def protocol(history_end: str, fit_end: str, selection_end: str, evaluation_end: str) -> tuple[int, int, int, int]:
    """Four boundaries from ISO-8601 times; they must rise."""
    made = tuple(map(epoch_ms, (history_end, fit_end, selection_end, evaluation_end)))
    if any(a >= b for a, b in zip(made, made[1:], strict=False)):
        raise ValueError("boundaries must rise")
    return made


def iso_ms(text: Column) -> Column:
    """Milliseconds of a column of ISO-8601 times; one without a zone fails the job."""
    named = F.when(text.rlike(_OFFSET), text).otherwise(F.raise_error(F.concat(F.lit("a time without a zone: "), text)))
    return F.unix_millis(F.to_timestamp(named))
