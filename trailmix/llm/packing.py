"""Cost-balanced packing of token streams into training sequences."""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType
from tokenizers import Tokenizer

from trailmix.llm.common import STABLE_CHARACTERS, ByteBPE, read_small, table

NAME = "op10_packing"


class Encoder:
    """Ids as the ``tokenizers`` library gives them without special tokens added, by a faster engine where both agree."""

    def __init__(self, spec: str, pattern: str):
        bpe = ByteBPE(spec)
        self.engine = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=bpe.ids, special_tokens=bpe.added)
        self.library = Tokenizer.from_str(spec)

    def ids(self, text: str) -> np.ndarray:
        if not text.isascii() and STABLE_CHARACTERS.search(text):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.array(self.engine.encode(text, allowed_special="all"), np.uint32)


def capacities(total: int, limit: int) -> list[int]:
    """Sequence sizes that hold ``total`` tokens without padding: full ones, then distinct powers of two."""
    tail = total % limit
    return [limit] * (total // limit) + [1 << b for b in reversed(range(tail.bit_length())) if tail >> b & 1]


def balanced(lengths: list[int], limit: int, linear: float, quadratic: float) -> list[tuple[int, int, int, int, int]]:
    """Place pieces so that sequences are filled and their costs are even.

    A piece of length L costs linear * L + quadratic * L * L (attention stays within a piece). Pieces go in
    descending length to the cheapest sequence with room. When no sequence has room for a whole piece, it is
    cut at the room of the cheapest one that has any, and its rest queues again. Ties: earlier piece, then
    lower sequence. Returns (piece, start in it, length, sequence, offset).
    """
    room = np.array(capacities(sum(lengths), limit), np.int64)
    size, cost = room.copy(), np.zeros(len(room))
    queue = [(-n, i, 0) for i, n in enumerate(lengths) if n]
    heapq.heapify(queue)
    placed = []
    while queue:
        negative, i, start = heapq.heappop(queue)
        n = -negative
        fits = np.flatnonzero(room >= n)
        if not len(fits):
            fits = np.flatnonzero(room > 0)
        s = int(fits[np.argmin(cost[fits])])
        take = min(n, int(room[s]))
        placed.append((i, start, take, s, int(size[s] - room[s])))
        room[s] -= take
        cost[s] += linear * take + quadratic * take * take
        if take < n:
            heapq.heappush(queue, (take - n, i, start + take))
    return placed


_FIELDS = [
    ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()),
    ("sequence_id", pa.int64()), ("offset", pa.int64()),
]
_encoders: dict[tuple[str, str], Encoder] = {}


def pack(
    docs: DataFrame, vocabulary: str, pattern: str, limit: int = 1024, end_id: int = 0, linear: float = 1.0,
    quadratic: float = 1.0 / 1024, window_tokens: int = 1 << 20, with_ids: bool = False, key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """One row per piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids if asked for.

    ``limit`` must be a power of two. Each document is its ids and ``end_id``; whole sequences are cut off it
    at once, and the rests wait until ``window_tokens`` of them fill a packing window. A window belongs to one
    task, so there is no shuffle, memory is bounded, and a recomputed task gives the same sequences.
    sequence_id joins the partition and a running number. Null and empty texts are the end id alone; a null
    key stays null; repeated rows are documents of their own; extra columns are left out, whatever their names.
    """
    if limit & (limit - 1):
        raise ValueError("limit must be a power of two")
    spec = docs.sparkSession.sparkContext.broadcast(read_small(vocabulary))
    chosen = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"))
    schema = chosen.select("doc_id").schema
    for name, _ in _FIELDS:
        schema = schema.add(name, "long")
    if with_ids:
        schema = schema.add("ids", ArrayType(IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = (vocabulary, pattern)
        encoder = _encoders.get(cache)
        if encoder is None:
            _encoders.clear()
            encoder = _encoders[cache] = Encoder(spec.value, pattern)
        base, sequences = TaskContext.get().partitionId() << 40, 0
        rests: list[tuple[object, int, int, np.ndarray]] = []
        waiting = 0
        columns: list[list] = [[] for _ in range(8)]
        kind = None

        def put(doc: object, start: int, ids: np.ndarray, tokens: int, sequence: int, offset: int) -> None:
            data = ids.astype("<u4")
            row = (doc, start, len(ids), zlib.crc32(data.tobytes()), tokens, base + sequence, offset, ids.astype(np.int32) if with_ids else None)
            for column, value in zip(columns, row, strict=True):
                column.append(value)

        def close() -> None:
            nonlocal sequences, waiting
            lengths = [len(r[3]) for r in rests]
            for i, start, n, s, offset in balanced(lengths, limit, linear, quadratic):
                doc, skipped, tokens, ids = rests[i]
                put(doc, skipped + start, ids[start : start + n], tokens, sequences + s, offset)
            sequences += len(capacities(waiting, limit))
            waiting = 0
            rests.clear()

        def flush() -> Iterator[pa.RecordBatch]:
            arrays = [pa.array(columns[0], kind)] + [pa.array(c, t) for c, (_, t) in zip(columns[1:7], _FIELDS, strict=True)]
            if with_ids:
                arrays.append(pa.array(columns[7], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)
            for column in columns:
                column.clear()

        for batch in batches:
            kind = batch.schema.field(0).type
            keys = batch.column(0).to_pylist()
            for doc, value in zip(keys, batch.column(1), strict=True):
                ids = np.append(encoder.ids(value.as_py() or ""), np.uint32(end_id))
                whole = len(ids) // limit * limit
                for start in range(0, whole, limit):
                    put(doc, start, ids[start : start + limit], len(ids), sequences, 0)
                    sequences += 1
                if whole < len(ids):
                    rests.append((doc, whole, len(ids), ids[whole:].copy()))
                    waiting += len(ids) - whole
                    if waiting >= window_tokens:
                        close()
                if len(columns[0]) >= 20_000:
                    yield from flush()
        if rests:
            close()
        if columns[0]:
            yield from flush()

    return chosen.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
