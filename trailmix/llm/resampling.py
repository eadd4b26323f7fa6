"""Importance resampling towards a target distribution: a document-by-bucket count matrix in CSR blocks, its column sums and its product with the gains."""

from __future__ import annotations

import itertools
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trailmix.llm.common import lean, stored, table

NAME = "op12_importance_resampling"
#: Bytes of words: digits, small letters, and all of any character beyond ASCII; others part words.
WORD_BYTES = bytes(b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
CSR = "ids array<bigint>, n_words array<bigint>, n_features array<bigint>, starts array<int>, columns binary, counts binary"
#: Entries of a block, but for its last document's. A Parquet writer looks at its memory once in 100 rows, and a reader takes a row group's rows
#: at once, so that blocks and row groups are small: memory does not depend on how many blocks a task has.
BLOCK_ENTRIES = 1 << 14
GROUP_BYTES = 8 << 20


def codes(data: bytes | None) -> tuple[int, np.ndarray]:
    """The number of words of a text in UTF-8, and the crc32 of each of its words and pairs of words."""
    words = data.lower().translate(WORD_BYTES).split() if data else []
    single = list(map(zlib.crc32, words))
    pairs = map(zlib.crc32, words[1:], map(zlib.crc32, itertools.repeat(b" "), single))  # a checksum goes on where the word's ended
    n = max(0, 2 * len(words) - 1)
    return len(words), np.fromiter(itertools.chain(single, pairs), np.uint32, n)


def count_matrix(docs: DataFrame, buckets: int = 10_000, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The CSR blocks of the count matrix, one row each: ids, words and features of its documents, where the entries of each document start, and the entries' columns and counts (little-endian, 32 bits).

    A map over the scan. A document has at most ``buckets`` entries however long it is, so that blocks stay small.
    """

    def block(rows: list[tuple]) -> pa.RecordBatch:
        ids, words, features, columns, counts = zip(*rows, strict=True)
        starts = np.cumsum([0, *map(len, columns)]).tolist()
        data = [list(ids), list(words), list(features), starts, *(np.concatenate(x).astype("<u4").tobytes() for x in (columns, counts))]
        kinds = [*[pa.list_(pa.int64())] * 3, pa.list_(pa.int32()), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(data, kinds, strict=True)], names=["ids", "n_words", "n_features", "starts", "columns", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for i, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                n, found = codes(value.as_py())
                columns, counts = np.unique(found % buckets, return_counts=True)
                held.append((i, n, len(found), columns, counts))
                size += len(columns) + 8
                if size >= BLOCK_ENTRIES:
                    yield block(held)
                    held, size = [], 0
        if held:
            yield block(held)

    return docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").cast("binary").alias("text")).mapInArrow(lean(run), CSR)


def column_sums(matrix: DataFrame, buckets: int) -> np.ndarray:
    """How often each bucket occurs: summed within tasks, then between them; the driver gets one number a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for columns, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                np.add.at(total, np.frombuffer(columns, "<u4"), np.frombuffer(counts, "<u4").astype(np.int64))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], names=["bucket", "n"])

    sums = np.zeros(buckets, np.int64)
    for r in matrix.select("columns", "counts").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        sums[r["bucket"]] = r["n"]
    return sums


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln ((t+1)(S+B) / ((s+1)(T+B)))) of each of the B buckets."""
    b, whole_s, whole_t = len(source), int(source.sum()), int(target.sum())
    return np.array([
        math.floor(1000 * math.log(float(t + 1) * float(whole_s + b) / (float(s + 1) * float(whole_t + b))))
        for s, t in zip(source.tolist(), target.tolist(), strict=True)
    ], np.int64)


def weighted(matrix: DataFrame, gains: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight): the product of the count matrix with the gains, floored over the features of each document."""
    shared = matrix.sparkSession.sparkContext.broadcast(gains)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, words, features, starts, columns, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                terms = shared.value[np.frombuffer(columns, "<u4")] * np.frombuffer(counts, "<u4").astype(np.int64)
                running = np.concatenate([[0], np.cumsum(terms)])
                sums = running[starts[1:]] - running[starts[:-1]]
                weights = sums // np.maximum(np.array(features), 1)  # floors go down
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (ids, words, features, weights)], names=["doc_id", "n_words", "n_features", "weight"])

    return matrix.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def resampled(
    docs: DataFrame, target: DataFrame, percent: int = 25, min_words: int = 20, buckets: int = 10_000, seed: int = 7,
    key: str = "doc_id", text: str = "text", target_text: str = "text",
) -> DataFrame:
    """One row per document: doc_id, n_words, n_features, weight, score, and rank where it is drawn.

    Features are words and pairs of words, hashed to ``buckets``; the mean gain of a document's features plus a Gumbel
    number of its id is its score, and of the N documents of at least ``min_words`` words the floor(percent * N / 100) of highest
    score are drawn, ties to smaller ids.

    Scores are whole numbers of a bounded range, so a histogram of them gives the least score that can be drawn; only rows from
    there on are sorted, by ranges of (score, doc_id, row), so that a hot score or id is split. Null and empty texts have no
    features and weight 0. Rows with a null doc_id have no score, do not count in N and are not drawn. Repeated rows are drawn
    each by itself, with ranks of their own; extra columns are left out. Without target texts gains tell how common a bucket is.
    """
    matrix = stored(count_matrix(docs, buckets, key, text), "resampling-counts", GROUP_BYTES)
    other = count_matrix(target.select(F.lit(None).cast("long").alias("id"), F.col(target_text).alias("text")), buckets, "id")
    gains = bucket_gains(column_sums(matrix, buckets), column_sums(other, buckets))
    drawn_h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    gumbel = F.floor(-1000 * F.log(-F.log((drawn_h + 0.5) / 4294967296.0)))
    rows = stored(weighted(matrix, gains).withColumn("score", F.col("weight") + gumbel), "resampling-scores")
    open_to = F.coalesce((F.col("n_words") >= min_words) & F.col("score").isNotNull(), F.lit(False))
    rows = rows.withColumn("_open", open_to)

    by_score = Window.orderBy(F.desc("score"))  # of a bounded number of scores
    levels = rows.where("_open").groupBy("score").count().withColumn("up_to", F.sum("count").over(by_score))
    n = rows.where("_open").count() * percent // 100
    least = levels.where(F.col("up_to") >= n).agg(F.max("score")).first()[0] if n else None
    reach = F.col("_open") & (F.col("score") >= F.lit(least)) if least is not None else F.lit(False)
    order = [F.desc("score"), F.col("doc_id"), F.col("_row")]
    ranged = rows.where(reach).withColumn("_row", F.monotonically_increasing_id())
    ranged = stored(ranged.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "resampling-ranges")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a part
    offsets = ranged.groupBy("_part").count().select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    placed = ranged.join(F.broadcast(offsets), "_part").withColumn("rank", F.row_number().over(Window.partitionBy("_part").orderBy(*order)) + F.col("_before"))
    columns = ["doc_id", "n_words", "n_features", "weight", "score"]
    ranked = placed.select(*columns, F.when(F.col("rank") <= n, F.col("rank")).cast("long").alias("rank"))
    return ranked.union(rows.where(~reach).select(*columns, F.lit(None).cast("long").alias("rank")))


def drawn(docs: DataFrame, found: DataFrame, key: str = "doc_id") -> DataFrame:
    """The documents that ``found`` (of resampled) drew, with all their columns; rows that share an id come or go together."""
    ids = found.where("rank IS NOT NULL").select(F.col("doc_id").alias("_drawn")).distinct()
    return docs.join(ids, F.col(key).cast("long") == F.col("_drawn"), "left_semi")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank", "n_words")


ORACLE = None
