"""File sources and sinks: Parquet, CSV and binary manifests, through Spark's readers and writers only."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession) -> str:
    """The folder shared by driver and executors, as the cluster names it. Local sessions may leave it unset, a cluster must not."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (found or tempfile.mkdtemp(prefix="trailmix-")).rstrip("/")


def file_system(spark: SparkSession, path: str):
    """The path as Hadoop sees it, and its file system."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def fingerprint(spark: SparkSession, path: str) -> tuple:
    """Names, lengths and times of the files of a table; another one tells that the table has been replaced."""
    at, system = file_system(spark, path)
    return tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in system.listStatus(at)))


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet and read back; the files go when the session's JVM ends."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at, system = file_system(spark, path)
    system.deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, there in whole or not at all: written aside, then renamed."""
    aside, system = file_system(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    out = system.create(aside, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    at, _ = file_system(spark, path)
    system.delete(at, False)
    if not system.rename(aside, at):
        raise OSError(f"cannot write {path}")


def read_text(spark: SparkSession, path: str) -> str:
    """A small file as text."""
    at, system = file_system(spark, path)
    stream = system.open(at)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def names(spark: SparkSession, folder: str, ending: str = "") -> list[str]:
    """Names of the files of a folder, in order; none if it is missing."""
    at, system = file_system(spark, folder)
    found = [f.getPath().getName() for f in system.listStatus(at)] if system.exists(at) else []
    return sorted(n for n in found if n.endswith(ending))


def write_parts(df: DataFrame, path: str, rows_per_part: int = 250_000) -> None:
    """zstd Parquet parts of bounded length; the commit protocol leaves no half-written parts."""
    df.write.mode("overwrite").option("compression", "zstd").option("maxRecordsPerFile", rows_per_part).parquet(path)


def round_trip(df: DataFrame, schema: str) -> DataFrame:
    path = f"{scratch(df.sparkSession)}/parts-{uuid.uuid4().hex}"
    write_parts(df, path)
    return df.sparkSession.read.schema(schema).parquet(path)


def write_csv(df: DataFrame, path: str, gzip: bool = True) -> None:
    df.write.mode("overwrite").option("header", True).option("compression", "gzip" if gzip else "none").csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def manifest(spark: SparkSession, pattern: str) -> DataFrame:
    """name, size and SHA-256 of files, read where they lie."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(pattern)
    return rows.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"))
