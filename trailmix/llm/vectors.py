"""Vectors as whole numbers, packed in blocks of rows that tasks can multiply at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PACKED = "width int, n int, kind string, ids binary, data binary"


def usable(vector: str, scale: float) -> Column:
    """Whether the column holds a vector without null or non-finite components, before and after scaling."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double") * scale) == float("inf")))
    return F.col(vector).isNotNull() & ~F.coalesce(odd, F.lit(True))


def narrow(values: np.ndarray) -> np.ndarray:
    """``values`` (whole numbers as doubles) in the smallest type that holds them; doubles beyond 32 bits."""
    most = float(np.abs(values).max()) if values.size else 0.0
    for kind in (np.int8, np.int16, np.int32):
        if most <= np.iinfo(kind).max:
            return values.astype(kind)
    return values


def packed(rows: DataFrame, scale: float, block_rows: int, by: tuple[str, ...] = ()) -> DataFrame:
    """Blocks of floor(scale * x) of ``rows`` (vec_id, vector and the long columns ``by``), at most ``block_rows`` each.

    Blocks are formed within tasks, as rows come, so a hot id is spread like any other; a block has vectors
    of one width and, where given, of one value of ``by``. Rows are in order of vec_id within it.
    """
    schema = "".join(f"{c} long, " for c in by) + PACKED

    def block(key: tuple, ids: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
        order = np.argsort(ids, kind="stable")
        data = narrow(np.floor(values[order] * scale))
        row = [*key, len(ids), data.dtype.str, ids[order].astype("<i8").tobytes(), data.tobytes()]
        kinds = [pa.int64()] * len(by) + [pa.int32(), pa.int32(), pa.string(), pa.binary(), pa.binary()]
        names = [*by, "width", "n", "kind", "ids", "data"]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list[tuple[np.ndarray, np.ndarray]]] = {}
        sizes: dict[tuple, int] = {}
        for batch in batches:
            vectors = batch.column(1)
            ids = batch.column(0).to_numpy()
            flat = np.asarray(vectors.flatten().to_numpy(zero_copy_only=False), np.float64)
            widths = vectors.value_lengths().to_numpy()
            starts = np.cumsum(widths) - widths
            keys = np.column_stack([*(batch.column(2 + i).to_numpy() for i in range(len(by))), widths])
            for key in map(tuple, np.unique(keys, axis=0).tolist()):
                at = np.flatnonzero((keys == key).all(axis=1))
                for some in np.split(at, range(block_rows, len(at), block_rows)):
                    values = flat[starts[some][:, None] + np.arange(key[-1])].reshape(len(some), key[-1])
                    held.setdefault(key, []).append((ids[some], values))
                    sizes[key] = sizes.get(key, 0) + len(some)
                    while sizes[key] >= block_rows:
                        i, v = (np.concatenate(x) for x in zip(*held.pop(key), strict=True))
                        yield block(key, i[:block_rows], v[:block_rows])
                        sizes[key] -= block_rows
                        held[key] = [(i[block_rows:], v[block_rows:])]
        for key, parts in held.items():
            if sizes[key]:
                yield block(key, *(np.concatenate(x) for x in zip(*parts, strict=True)))

    return rows.select("vec_id", "vector", *by).mapInArrow(run, schema)


def unpacked(width: int, n: int, kind: str, data: bytes) -> np.ndarray:
    return np.frombuffer(data, kind).reshape(n, width)
