"""Exact top-k search: tiled matrix products of queries and shards, selection per tile, a tree of merges per query."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trailmix.llm.common import lean, stored, table
from trailmix.llm.vectors import packed, unpacked, usable

NAME = "op11_exact_topk_search"
LONG = np.iinfo(np.int64)
#: Entries of a product that a task holds at once.
TILE_ENTRIES = 1 << 21


def products(queries: np.ndarray, shard: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers: in floats where no partial sum can exceed their whole numbers, else by Python's integers, held within a long."""
    most = [float(np.abs(x.astype(np.float64)).max()) if x.size else 0.0 for x in (queries, shard)]
    bound = most[0] * most[1] * queries.shape[1]
    for kind, exact in ((np.float32, 2.0**24), (np.float64, 2.0**53)):
        if bound < exact:
            return queries.astype(kind) @ shard.astype(kind).T
    whole = [np.array([[int(x) for x in row] for row in m.tolist()], object).reshape(m.shape) for m in (queries, shard)]
    return np.clip(whole[0].dot(whole[1].T), LONG.min, LONG.max).astype(np.int64)


def chosen(scores: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of each row's k highest scores, ties to smaller columns; pairs in ``own`` take no part."""
    wanted = ~own
    if scores.shape[1] > k:
        lowest = -np.inf if scores.dtype.kind == "f" else LONG.min
        held = np.where(wanted, scores, lowest)
        bar = np.partition(held, held.shape[1] - k, axis=1)[:, held.shape[1] - k][:, None]
        above, level = held > bar, (held == bar) & wanted
        room = k - above.sum(axis=1, dtype=np.int32)[:, None]
        wanted = above | (level & (np.cumsum(level, axis=1, dtype=np.int32) <= room))
    return np.nonzero(wanted)


class TopLists:
    """The best ``k`` (score, vec_id) of each query of a block, as tiles come in."""

    def __init__(self, ids: np.ndarray, k: int):
        self.ids, self.k = ids, k
        self.line, self.found, self.scores = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)

    def add(self, queries: np.ndarray, ids: np.ndarray, shard: np.ndarray) -> None:
        step = max(1, TILE_ENTRIES // max(1, len(ids)))
        for a in range(0, len(self.ids), step):
            scores = products(queries[a : a + step], shard)
            line, column = chosen(scores, self.ids[a : a + step, None] == ids[None, :], self.k)
            self.line = np.concatenate([self.line, line + a])
            self.found = np.concatenate([self.found, ids[column]])
            self.scores = np.concatenate([self.scores, scores[line, column].astype(np.int64)])
        order = np.lexsort((self.found, ~self.scores, self.line))  # ~ falls as scores rise, without overflow
        line = self.line[order]
        place = np.arange(len(line)) - np.searchsorted(line, line)
        order = order[place < self.k]
        self.line, self.found, self.scores = self.line[order], self.found[order], self.scores[order]

    def batches(self, group: int) -> Iterator[pa.RecordBatch]:
        for a in range(0, len(self.line), 1 << 16):
            some = slice(a, a + (1 << 16))
            line = self.line[some]
            columns = [self.ids[line], np.full(len(line), group, np.int64), self.found[some], self.scores[some]]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["query_id", "node", "vec_id", "score"])


def scored_tiles(tiles: DataFrame, k: int) -> DataFrame:
    """(query_id, node, vec_id, score) of the best k of each query in each group of shards; tiles of one block and group that follow each other share a list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, lists, queries = None, None, None
        for batch in batches:
            for i in range(batch.num_rows):
                r = {c: batch.column(j)[i].as_py() for j, c in enumerate(batch.schema.names) if c not in ("q_ids", "q_data")}
                key = (r["block"], r["group"], r["width"])
                if key != at:
                    if lists is not None:
                        yield from lists.batches(at[1])
                    q_ids, q_data = (batch.column(batch.schema.get_field_index(c))[i].as_py() for c in ("q_ids", "q_data"))
                    at, lists = key, TopLists(np.frombuffer(q_ids, "<i8"), k)
                    queries = unpacked(r["width"], r["q_n"], r["q_kind"], q_data)
                lists.add(queries, np.frombuffer(r["ids"], "<i8"), unpacked(r["width"], r["n"], r["kind"], r["data"]))
        if lists is not None:
            yield from lists.batches(at[1])

    return tiles.mapInArrow(lean(run), "query_id long, node long, vec_id long, score long")


def best(lists: DataFrame, k: int, *keys: str) -> DataFrame:
    """The k best rows of each key; Spark keeps no more than k of a key before the shuffle, too."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id")
    return lists.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(
    rows: DataFrame, queries: DataFrame, k: int = 20, scale: float = 64.0, key: str = "vec_id", vector: str = "embedding",
    query_rows: int = 8192, shard_rows: int = 4096, group_rows: int = 1 << 20, tiles: int = 64, fan_in: int = 16,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of highest inner product for each row of ``queries``, over all ``rows``.

    Vectors become floor(scale * x). Both sides are packed in blocks; every block of queries meets every group of
    shards in one keyed join, whose tiles are multiplied and cut to k at once. A task keeps one list a query
    for the shards of a group, and lists meet in a tree of ``fan_in``. A block has up to ``query_rows`` queries and a group some
    ``group_rows`` rows, fewer where the input is small, so that there are some ``tiles`` tiles.

    A row never finds its own id. Null ids, and vectors that are null or hold null or non-finite components (also after scaling),
    take no part. Vectors of another width than a query's are not compared with it. Repeated rows are found once each; queries
    that share an id are one, by the least vector. Scores beyond a long are held at its ends. A query without partners has no rows;
    an empty table gives none. Extra columns are left out.
    """
    wanted = lambda df: df.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).alias("vector")).where(F.col("vec_id").isNotNull() & usable("vector", scale))
    asked = stored(wanted(queries).groupBy("vec_id").agg(F.min("vector").alias("vector")), "topk-queries")
    shards = stored(packed(wanted(rows), scale, shard_rows), "topk-shards")
    n_queries = asked.count()
    n_rows, n_shards = shards.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    groups = max(1, -(-n_rows // group_rows), min(n_shards, -(-n_rows // (8 * shard_rows))))
    blocks = max(1, -(-n_queries // query_rows), min(-(-n_queries // 256), -(-tiles // groups)))
    spread = asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks))).repartition(blocks, "block")
    q = packed(spread, scale, 2 * query_rows, ("block",)).withColumnsRenamed({"n": "q_n", "kind": "q_kind", "ids": "q_ids", "data": "q_data"})
    # A block that hashing made larger than twice the mean comes in two rows, which meet the shards as blocks of their own.
    q = stored(q.withColumn("block", F.monotonically_increasing_id()), "topk-blocks")
    marks = [r[0] for r in q.select("block").collect()]  # one number for up to query_rows queries
    there = shards.withColumn("group", F.pmod(F.monotonically_increasing_id() % (1 << 33) + F.spark_partition_id(), F.lit(groups)))
    there = stored(there, "topk-groups").withColumn("block", F.explode(F.lit(marks).cast("array<bigint>")))
    here = q.withColumn("group", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
    lists = stored(scored_tiles(there.join(here.hint("merge"), ["block", "group", "width"]), k), "topk-lists")
    while groups > fan_in:
        groups = -(-groups // fan_in)
        lists = best(lists.withColumn("node", F.floor(F.col("node") / fan_in)), k, "query_id", "node").drop("rank")
    return best(lists, k, "query_id").select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return top_k(rows, rows.where("vec_id % 20 = 0"))


ORACLE = """
WITH whole AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
    SELECT q.vec_id AS query_id, e.vec_id,
           CAST(coalesce(list_sum(list_transform(list_zip(q.v, e.v), lambda p: p[1] * p[2])), 0) AS BIGINT) AS score
    FROM whole q JOIN whole e ON q.vec_id <> e.vec_id AND len(q.v) = len(e.v)
    WHERE q.vec_id % 20 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM pairs
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20
"""
