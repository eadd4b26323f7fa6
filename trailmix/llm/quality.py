"""Quality rules: an isolation forest over rule statistics, its threshold calibrated from labelled rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from trailmix.llm.common import lowest, stored, table

NAME = "op7_quality_rules"
SYMBOLS = "#*$%&|<>"
BLANKS = "\t\n\x0b\x0c\r "
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("chars_per_word", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "digit_share", "top_word_share")
#: What usual text stays within. A rule's statistic is the amount by which a text is outside, so that usual texts of
#: whatever length and language agree in it and splits isolate the others.
USUAL = {"chars_per_word": (3.0, 10.0), "symbol_share": (0.0, 0.01), "dup_line_share": (0.0, 0.3), "repeat_share": (0.0, 0.3), "upper_share": (0.0, 0.1), "digit_share": (0.0, 0.15), "top_word_share": (0.0, 0.2)}


def repeated_words(ids: np.ndarray, kinds: int, size: int = 3) -> int:
    """How many words lie in windows of ``size`` words that the text has twice or more."""
    if len(ids) < size:
        return 0
    codes = ids[: len(ids) - size + 1].astype(np.int64)
    for k in range(1, size):
        if kinds > 1 << 20:  # keep the product below 2**63
            codes = np.unique(codes, return_inverse=True)[1].astype(np.int64)
        codes = codes * kinds + ids[k : len(ids) - size + 1 + k]
    _, back, counts = np.unique(codes, return_inverse=True, return_counts=True)
    starts = (counts[back] > 1).astype(np.int8)
    covered = np.zeros(len(ids), np.int8)
    for k in range(size):
        covered[k : k + len(starts)] |= starts
    return int(covered.sum())


def statistics(text: str | None) -> tuple[tuple[int, ...], tuple[float, ...]]:
    """The five counts and the rule statistics of one text."""
    if not text:
        return (0,) * len(COUNTS), (0.0,) * len(FEATURES)
    words = text.encode("utf-8", "replace").split()
    if not words:
        return (0, 0, sum(map(text.count, SYMBOLS)), 0, 0), (0.0,) * len(FEATURES)
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    chars = len(text) - sum(map(text.count, BLANKS))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    duplicates = len(lines) - len(set(lines))
    repeats = repeated_words(ids, len(known))
    raw = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")
    upper = int((((raw >= 65) & (raw <= 90)) | ((raw >= 192) & (raw <= 222))).sum())
    digits = int(((raw >= 48) & (raw <= 57)).sum())
    top = int(np.bincount(ids).max()) if len(ids) >= 20 else 0
    n = len(words)
    shares = (chars / n, symbols / chars, duplicates / len(lines), repeats / n, upper / chars, digits / chars, top / n)
    outside = tuple(max(0.0, low - x, x - high) for x, (low, high) in zip(shares, USUAL.values(), strict=True))
    return (n, chars, symbols, duplicates, repeats), outside


def measured(docs: DataFrame, seed: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` with a hash of key and text (``drawn``), counts and rule statistics of every whole text; a map over the scan."""
    chosen = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"))
    chosen = chosen.withColumn("drawn", F.xxhash64(F.lit(seed), "doc_id", "text"))
    schema = chosen.select("doc_id", "drawn").schema
    for c in COUNTS:
        schema = schema.add(c, "long")
    for c in FEATURES:
        schema = schema.add(c, "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [statistics(t) for t in batch.column(1).to_pylist()]
            counts = [pa.array([r[0][k] for r in rows], pa.int64()) for k in range(len(COUNTS))]
            shares = [pa.array([r[1][k] for r in rows], pa.float64()) for k in range(len(FEATURES))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *counts, *shares], names=schema.names)

    return chosen.mapInArrow(run, schema)


class IsolationForest:
    """Random splits over samples of rows; a short average path means that a row is easy to isolate."""

    def __init__(self, rows: np.ndarray, trees: int = 100, sample: int = 256, seed: int = 7):
        random = np.random.default_rng(seed)
        size = min(sample, len(rows))
        self.depth = int(np.ceil(np.log2(max(size, 2))))
        self.norm = self.average(size)
        self.trees = []
        for _ in range(trees):
            nodes: list[list[float]] = []
            self.grow(rows[random.choice(len(rows), size, replace=False)] if size else rows, 0, nodes, random)
            self.trees.append(np.array(nodes))

    @staticmethod
    def average(n: int) -> float:
        """Average path length of an unsuccessful search in a binary tree of n rows."""
        return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n

    def grow(self, rows: np.ndarray, depth: int, nodes: list[list[float]], random: np.random.Generator) -> int:
        """Nodes are (feature or -1, split, left, right, path length at a leaf)."""
        at = len(nodes)
        nodes.append([-1, 0, 0, 0, depth + self.average(len(rows))])
        if depth < self.depth and len(rows) > 1:
            low, high = rows.min(axis=0), rows.max(axis=0)
            usable = np.flatnonzero(high > low)
            if len(usable):
                f = int(random.choice(usable))
                split = float(random.uniform(low[f], high[f]))
                under = rows[:, f] < split
                nodes[at][:2] = [f, split]
                nodes[at][2] = self.grow(rows[under], depth + 1, nodes, random)
                nodes[at][3] = self.grow(rows[~under], depth + 1, nodes, random)
        return at

    def scores(self, rows: np.ndarray) -> np.ndarray:
        total = np.zeros(len(rows))
        line = np.arange(len(rows))
        for tree in self.trees:
            at = np.zeros(len(rows), np.int64)
            for _ in range(self.depth + 1):
                f = tree[at, 0].astype(np.int64)
                inner = f >= 0
                if not inner.any():
                    break
                left = rows[line, np.maximum(f, 0)] < tree[at, 1]
                at = np.where(inner, np.where(left, tree[at, 2], tree[at, 3]).astype(np.int64), at)
            total += tree[at, 4]
        return 2.0 ** (-total / max(1, len(self.trees)) / max(self.norm, 1e-9))


def calibrated(scored: DataFrame, labels: DataFrame, max_good_loss: float, bins: int = 1000) -> float:
    """The threshold that best separates labelled good from bad rows, losing at most ``max_good_loss`` of the good ones.

    All labelled rows count, as a histogram of ``bins`` scores by label. Without labels of both kinds nothing is rejected.
    """
    marked = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    shown = (
        scored.where("NOT base_failed").join(marked, "doc_id")
        .groupBy(F.least(F.floor(F.col("anomaly") * bins), F.lit(bins - 1)).cast("int").alias("bin"), "quality").count()
    )
    good, bad = np.zeros(bins + 1), np.zeros(bins + 1)
    for r in shown.collect():
        (good if r["quality"] > 0 else bad)[r["bin"]] += r["count"]
    if not good.sum() or not bad.sum():
        return float("inf")
    over = lambda x: np.cumsum(x[::-1])[::-1] / x.sum()  # noqa: E731  share at or over each bin
    lost, caught = over(good), over(bad)
    gain = np.where(lost <= max_good_loss, caught - lost, -1.0)
    best = np.flatnonzero(gain == gain.max())
    return float(best[0] + best[-1]) / 2 / bins  # amid equals, away from either kind


def quality(
    docs: DataFrame, labels: DataFrame, trees: int = 100, sample: int = 256, max_good_loss: float = 0.005,
    min_words: int = 50, max_repeat_percent: int = 50, seed: int = 7,
) -> DataFrame:
    """One row per document: counts, rule statistics, base_failed, anomaly (0 to 1) and kept.

    The forest is fitted on at most trees * sample rows, those of least hash of doc_id and text, so that rows enter
    whatever their statistics are; rows equal in both enter together. The threshold comes
    from all rows of ``labels`` (doc_id, quality; where a document has several, the worst counts). Statistics
    are taken once and stored. Null and empty texts have zero counts and fail the base rule; rows with a null
    doc_id are judged but match no label; repeated rows are judged alike; extra columns are left out.
    """
    base = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    measures = stored(measured(docs, seed).withColumn("base_failed", base), "quality")
    picked = lowest(measures.where("NOT base_failed").select("drawn", *FEATURES), "drawn", trees * sample, "quality-sample").select(*FEATURES).collect()
    rows = measures.drop("drawn")
    forest = IsolationForest(np.array([tuple(r) for r in picked], float).reshape(-1, len(FEATURES)), trees, sample, seed)
    shared = docs.sparkSession.sparkContext.broadcast(forest)
    schema = StructType([*rows.schema.fields]).add("anomaly", DoubleType())

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            matrix = np.column_stack([batch.column(batch.schema.get_field_index(f)).to_numpy() for f in FEATURES])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shared.value.scores(matrix))], names=schema.names)

    scored = rows.mapInArrow(score, schema)
    threshold = calibrated(scored, labels.select("doc_id", "quality"), max_good_loss)
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("anomaly") < F.lit(threshold)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", *COUNTS, "base_failed", "kept", "anomaly")
