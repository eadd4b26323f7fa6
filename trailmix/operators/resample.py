"""Paired bootstrap over whole sessions: exact multinomial draws, the same whatever the partitions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmix.canon import portable_hash
from trailmix.operators.metrics import WEIGHTS
from trailmix.session import shipped

#: Sessions that a bucket has on average; a bucket's draws are made in one go.
BUCKET = 4096


def drawn_by(ends: np.ndarray, bucket: int, n: int, seed: int, replicate: int) -> int:
    """How many of the n draws of a replicate fall in a bucket.

    The range of buckets is halved until one is left; of what falls in a range, a binomial number falls in its left half, by a
    generator of that range alone, so that every bucket finds its own number without the others. ``ends`` are cumulated sizes.
    """
    low, high, left = 0, len(ends), n
    while high - low > 1 and left:
        middle = (low + high) // 2
        before = ends[low - 1] if low else 0
        share = (ends[middle - 1] - before) / max(1, ends[high - 1] - before)
        first = int(np.random.default_rng([seed, replicate, low, high]).binomial(left, share))
        if bucket < middle:
            high, left = middle, first
        else:
            low, left = middle, left - first
    return left


def weights_of(ends: np.ndarray, bucket: int, n: int, seed: int, replicate: int) -> np.ndarray:
    """How often each session of a bucket is drawn, in order of sessions."""
    size = int(ends[bucket] - (ends[bucket - 1] if bucket else 0))
    drawn = drawn_by(ends, bucket, n, seed, replicate)
    return np.random.default_rng([seed, replicate, bucket]).multinomial(drawn, np.full(size, 1.0 / size)) if size else np.zeros(0, np.int64)


def replicates(rows: DataFrame, seed: int, count: int) -> DataFrame:
    """(replicate, sessions, hits, base, denominator): sums over n sessions drawn with replacement, arrays by objective.

    ``rows`` has one row per session: session, and arrays hits, base and denominator in the order of the objectives. Buckets go by a hash of
    the session, and their number by how many sessions there are; the driver gets one size a bucket.
    """
    spark = rows.sparkSession
    shipped(spark)
    n = rows.count()
    n_buckets = max(1, -(-n // BUCKET))
    kept = rows.select((portable_hash(F.col("session"), F.lit("bucket")) % n_buckets).cast("int").alias("bucket"), "session", "hits", "base", "denominator")
    sizes = np.zeros(n_buckets, np.int64)
    for r in kept.groupBy("bucket").count().collect():
        sizes[r["bucket"]] = r["count"]
    ends = np.cumsum(sizes)
    k = len(WEIGHTS)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:  # in order of bucket and session
            held.append(batch)
        if not held:
            return
        table = pa.Table.from_batches(held)
        bucket = table["bucket"].to_numpy()
        values = np.column_stack([np.asarray(table[c].combine_chunks().flatten()).reshape(-1, k) for c in ("hits", "base", "denominator")])
        starts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
        sums = np.zeros((count, 1 + 3 * k), np.int64)
        for a, b in zip(starts, [*starts[1:], len(bucket)], strict=True):
            for r in range(count):
                w = weights_of(ends, int(bucket[a]), n, seed, r)
                sums[r, 0] += w.sum()
                sums[r, 1:] += w @ values[a:b]
        out = [pa.array(np.arange(count, dtype=np.int32)), pa.array(sums[:, 0])]
        out += [pa.array(list(sums[:, 1 + k * i : 1 + k * (i + 1)]), pa.list_(pa.int64())) for i in range(3)]
        yield pa.RecordBatch.from_arrays(out, names=["replicate", "sessions", "hits", "base", "denominator"])

    schema = "replicate int, sessions long, " + ", ".join(f"{c} array<bigint>" for c in ("hits", "base", "denominator"))
    parts = kept.repartition(max(1, min(n_buckets, 4 * spark.sparkContext.defaultParallelism)), "bucket").sortWithinPartitions("bucket", "session")
    found = parts.mapInArrow(draw, schema)
    sums = [F.array(*[F.sum(F.col(c)[i]) for i in range(k)]).alias(c) for c in ("hits", "base", "denominator")]
    return found.groupBy("replicate").agg(F.sum("sessions").alias("sessions"), *sums)


def paired(rows: DataFrame, seed: int, count: int = 1000) -> DataFrame:
    """One row: score, gain over the base, their 95 % intervals by percentiles, requested and valid replicates.

    A replicate in which an objective has no denominator is not valid; under 95 % valid ones it raises, and so do zero
    denominators of the whole or fewer than 100 replicates.
    """
    if count < 100:
        raise ValueError("use at least 100 bootstrap replicates")
    w = np.array(list(WEIGHTS.values()))
    whole = rows.agg(*[F.sum(F.col(c)[i]).alias(f"{c}{i}") for c in ("hits", "base", "denominator") for i in range(len(w))]).first()
    total = {c: np.array([whole[f"{c}{i}"] or 0 for i in range(len(w))], float) for c in ("hits", "base", "denominator")}
    if (total["denominator"] == 0).any() or (total["hits"] > total["denominator"]).any() or (total["base"] > total["denominator"]).any():
        raise ValueError("every objective needs a denominator that hits do not exceed")
    scores, gains = [], []
    for r in replicates(rows, seed, count).orderBy("replicate").collect():
        den = np.array(r["denominator"], float)
        if (den > 0).all():
            scores.append(float((np.array(r["hits"]) / den) @ w))
            gains.append(float(((np.array(r["hits"]) - np.array(r["base"])) / den) @ w))
    if len(scores) < 0.95 * count:
        raise ValueError("too many bootstrap samples lack an objective's denominator")
    score = float((total["hits"] / total["denominator"]) @ w)
    gain = score - float((total["base"] / total["denominator"]) @ w)
    low, high = (np.quantile(x, [0.025, 0.975]).tolist() for x in (scores, gains))
    row = (score, *low, gain, *high, count, len(scores))
    return rows.sparkSession.createDataFrame([row], "score double, score_low double, score_high double, gain double, gain_low double, gain_high double, requested long, valid long")
