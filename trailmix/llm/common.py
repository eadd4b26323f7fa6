"""What several operators share: tables, shared storage and tokenizer files."""

from __future__ import annotations

import ctypes
import functools
import gc
import json
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


BATCH_BYTES = "8m"
#: Of tables between steps. Snappy's codec keeps buffers outside the heap until a collection finds them; these are smaller, too.
CODEC = "zstd"


def shipped(spark: SparkSession) -> None:
    """Let the executors' Python import this package, wherever the driver runs; once a context. Arrow batches are kept small, as several are in memory in each task, and Parquet is written with CODEC."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    spark.conf.set("spark.sql.parquet.compression.codec", CODEC)
    context = spark.sparkContext
    if getattr(context, "_trailmix_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="trailmix-code-")) / "trailmix-code.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(package.parent))
    context.addPyFile(str(archive))
    context._trailmix_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it; a fresh one where it is unset (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="trailmix-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def _hadoop(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def made_dir(spark: SparkSession, path: str) -> None:
    """Make a folder in shared storage, which goes when the session's JVM ends."""
    at, system = _hadoop(spark, path)
    system.mkdirs(at)
    system.deleteOnExit(at)


def stored(df: DataFrame, name: str, group_bytes: int | None = None) -> DataFrame:
    """Write ``df`` to shared storage and read it back: lineage ends there, and a lost executor costs no recomputation. The files go when the session's JVM ends.

    ``group_bytes`` bounds Parquet's row groups, for rows of many KB: a reader has up to 4,096 rows of a group in memory at once, uncompressed.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write if group_bytes is None else df.write.option("parquet.block.size", group_bytes)
    writer.parquet(path, compression=CODEC)
    at, system = _hadoop(spark, path)
    system.deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def lowest(df: DataFrame, key: str, n: int, name: str) -> DataFrame:
    """The ``n`` rows of least ``key``, a hash of 64 bits, further ties by the other columns. Written once; it never has more than ``n`` rows.

    A histogram over the first bits of the hash tells from where on rows can be left out, so that few more than ``n`` meet in the one task that
    orders them, and the driver gets the bound alone.
    """
    bits = F.shiftright(key, 48)
    classes = df.where(F.col(key).isNotNull()).groupBy(bits.alias("_class")).count()
    so_far = F.sum("count").over(Window.orderBy("_class").rowsBetween(Window.unboundedPreceding, -1))  # 65,536 rows at most
    bound = classes.withColumn("_before", F.coalesce(so_far, F.lit(0))).where(F.col("_before") < n).agg(F.max("_class")).first()[0]
    some = df.where(bits <= F.lit(bound)) if bound is not None else df.where("false")
    return stored(some.orderBy(key, *[c for c in df.columns if c != key]).limit(n), name)


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` for mapInArrow; when a task ends, its Python worker, which serves further tasks, gives freed memory back."""

    @functools.wraps(run)
    def inner(batches: Iterator) -> Iterator:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)

    return inner


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level BPE files: character to byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class ByteBPE:
    """A byte-level BPE vocabulary of a ``tokenizers`` JSON file: tokens as bytes, ranked merges, added tokens."""

    def __init__(self, text: str):
        spec = json.loads(text)
        alphabet = byte_alphabet()
        self.added: dict[str, int] = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.ids: dict[bytes, int] = {
            bytes(alphabet[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in self.added
        }
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            a, b = (bytes(alphabet[c] for c in side) for side in (left, right))
            self.merges.setdefault((self.ids[a], self.ids[b]), (rank, self.ids[a + b]))
        self.byte_ids = [self.ids[bytes([b])] for b in range(256)]
        self.split_added = regex.compile("(" + "|".join(map(regex.escape, self.added)) + ")") if self.added else None


def read_small(path: str) -> str:
    """A tokenizer file's text, read by the driver; these files are a few MB."""
    return Path(path).read_text(encoding="utf-8")


#: Characters whose classes are the same in every Unicode version in use. A text with others is split by the tokenizer library itself.
STABLE_CHARACTERS = regex.compile("[^\u0000-՗‐-⁯₠-₿　-〾ぁ-ヿ一-龥가-힣]")
