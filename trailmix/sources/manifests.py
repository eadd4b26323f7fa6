"""Identities of files: digests streamed by tasks, a manifest whose id does not depend on order, and checks of folders against it."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmix.session import shipped
from trailmix.sources import files

CHUNK = 8 << 20
RECORDS = "path string, name string, size_bytes long, sha256 string"


def opened(path: str):
    """A file as a stream of bytes, from a local or object store path."""
    if urlparse(path).scheme in ("", "file"):
        return open(unquote(urlparse(path).path), "rb")  # noqa: SIM115
    store, at = pafs.FileSystem.from_uri(path)
    return store.open_input_stream(at)


def stream_digest(path: str, chunk: int = CHUNK) -> tuple[int, str]:
    """Size and SHA-256, with one chunk in memory at a time."""
    digest, size = hashlib.sha256(), 0
    with opened(path) as stream:
        while data := stream.read(chunk):
            digest.update(data)
            size += len(data)
    return size, digest.hexdigest()


def listed(spark: SparkSession, pattern: str) -> list[tuple[str, str, int]]:
    """(path, name, size) of the files that match, folders searched; no content is read."""
    at, system = files.file_system(spark, pattern)
    found = []
    for status in system.globStatus(at) or []:
        each = system.listFiles(status.getPath(), True)
        while each.hasNext():
            f = each.next()
            name = f.getPath().getName()
            if not name.startswith(("_", ".")):
                found.append((f.getPath().toString(), name, f.getLen()))
    return sorted(found)


def _reachable(path: str) -> bool:
    """Whether Python can open the store of a path."""
    if urlparse(path).scheme in ("", "file"):
        return True
    try:
        pafs.FileSystem.from_uri(path)
    except (pa.ArrowInvalid, OSError):
        return False
    return True


def hashed(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, name, size_bytes, sha256) of each file, one task a file, large ones first; a file that grew or shrank since it was listed fails the job.

    In a store that only Spark can open, Spark's own reader takes whole files, which must be under 2 GB then.
    """
    found = listed(spark, pattern)
    if not found:
        raise FileNotFoundError(pattern)
    if not all(_reachable(path) for path, _, _ in found[:1]):
        rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(pattern)
        return rows.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"))
    shipped(spark)
    order = sorted(found, key=lambda r: (-r[2], r[0]))
    rows = spark.createDataFrame(order, "path string, name string, size_bytes long").repartition(len(order) if len(order) < 10_000 else 10_000, "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests = []
            for path, size in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                seen, digest = stream_digest(path)
                if seen != size:
                    raise OSError(f"{path} has {seen} bytes, not {size}")
                digests.append(digest)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(digests, pa.string())], names=["path", "name", "size_bytes", "sha256"])

    return rows.mapInArrow(run, RECORDS)


def manifest_id(source: str, records: list[dict]) -> str:
    """SHA-256 of the source's name and its files' names, sizes and digests, whatever their order."""
    payload = {"source": source, "files": sorted(records, key=lambda r: (r["name"], r["sha256"]))}
    return hashlib.sha256(json.dumps(payload, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def build(spark: SparkSession, patterns: list[str], source: str) -> dict:
    """The manifest of a data set: id, source and records; rows of it come to the driver, one a file."""
    if not patterns:
        raise ValueError("a manifest needs at least one path")
    records = [{k: r[k] for k in ("name", "size_bytes", "sha256")} for p in patterns for r in hashed(spark, p).collect()]
    records.sort(key=lambda r: (r["name"], r["sha256"]))
    return {"manifest_id": manifest_id(source, records), "source": source, "files": records}


def write(spark: SparkSession, manifest: dict, path: str) -> None:
    files.write_text(spark, path, json.dumps(manifest, indent=2, sort_keys=True) + "\n")


def read(spark: SparkSession, path: str) -> dict:
    """A manifest; one whose id does not fit its content is refused."""
    found = json.loads(files.read_text(spark, path))
    if found["manifest_id"] != manifest_id(found["source"], found["files"]):
        raise ValueError("the manifest was changed")
    return found


def identity(manifest: dict, name: str) -> tuple[str, str]:
    """(manifest id, SHA-256) of one source file; a name that is missing or there twice is refused."""
    found = [r for r in manifest["files"] if r["name"] == name]
    if len(found) != 1:
        raise ValueError(f"{name} is {len(found)} times in the manifest")
    return manifest["manifest_id"], found[0]["sha256"]


def differences(spark: SparkSession, manifest: dict, pattern: str) -> DataFrame:
    """(name, fault) of files that are missing, unknown or changed against the manifest; hashed only where sizes agree."""
    told = spark.createDataFrame([(r["name"], r["size_bytes"], r["sha256"]) for r in manifest["files"]], "name string, told_size long, told_sha string")
    there = hashed(spark, pattern).select("name", "size_bytes", "sha256")
    fault = (
        F.when(F.col("sha256").isNull(), "missing").when(F.col("told_sha").isNull(), "unknown")
        .when((F.col("size_bytes") != F.col("told_size")) | (F.col("sha256") != F.col("told_sha")), "changed")
    )
    return told.join(there, "name", "full").select("name", fault.alias("fault")).where("fault IS NOT NULL")


def attested(spark: SparkSession, manifest: dict, pattern: str) -> str:
    """The manifest's id, if exactly its files are there with its digests; else it raises with what differs first."""
    wrong = differences(spark, manifest, pattern).orderBy("name").limit(3).collect()
    if wrong:
        raise ValueError("the input is not that of the manifest: " + ", ".join(f"{r['name']} {r['fault']}" for r in wrong))
    return manifest["manifest_id"]
