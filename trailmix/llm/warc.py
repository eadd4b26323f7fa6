"""WARC: write deduplicated archives, normalise monolithic gzip files to one member a record, read back by the index."""

from __future__ import annotations

import base64
import datetime
import gzip
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmix.llm.common import made_dir, shared_dir, stored, table

NAME = "op8_warc"
CHUNK = 1 << 20
#: The profile of revisits by equal payload; a fixed value of the format.
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def store(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI (or absolute path) and the path in it."""
    return fs.FileSystem.from_uri(uri)


def record(headers: dict[str, str], body: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in headers.items()), f"Content-Length: {len(body)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parsed(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = data.partition(b"\r\n\r\n")
    headers = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    return headers, rest[: int(headers["Content-Length"])]


def records(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records of an inflated stream; holds one record and one chunk."""
    held = bytearray()
    for chunk in chunks:
        held += chunk
        at = 0
        while True:
            end = held.find(b"\r\n\r\n", at)
            if end < 0:
                break
            size = int(held[held.index(b"Content-Length: ", at) + 16 : end].split(b"\r\n")[0])
            if len(held) < end + 4 + size + 4:
                break
            yield bytes(held[at : end + 4 + size + 4])
            at = end + 4 + size + 4
        del held[:at]
    if held:
        raise ValueError(f"{len(held)} bytes of a broken record at the end of an archive")


def inflated(stream) -> Iterator[bytes]:
    """The content of a gzip file of one or many members, inflated once from its start to its end."""
    engine = zlib.decompressobj(31)
    while data := stream.read(CHUNK):
        while data:
            yield engine.decompress(data)
            data = engine.unused_data
            if engine.eof:
                engine = zlib.decompressobj(31)


def with_first(pages: DataFrame, least_bytes: int) -> DataFrame:
    """page_id, url, payload, refers_to: the smallest page_id among equal payloads, null where the page is that one."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumn("same", F.sha2("payload", 256))
    # copies are found by digests alone; payloads then meet the revisits by page_id, which spreads the copies of one page
    keys = rows.where(F.length("payload") >= least_bytes).select("page_id", "same")
    firsts = keys.groupBy("same").agg(F.min("page_id").alias("first_id")).where("first_id IS NOT NULL")
    other = keys.distinct().join(firsts, "same").where(~F.col("page_id").eqNullSafe(F.col("first_id"))).toDF("_same", "_page", "refers_to")
    found = rows.join(other, F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("same") == F.col("_same")), "left")
    return found.select("page_id", "url", "payload", "refers_to")


def written(pages: DataFrame, folder: str, archive_bytes: int, date: str) -> DataFrame:
    """Write archives, each a single gzip stream; returns their paths. A rerun task writes files of new names, only committed rows count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = store(folder)
        system.create_dir(root, recursive=True)
        out, engine, path, size = None, None, "", 0
        paths: list[str] = []
        for batch in batches:
            for page, url, payload, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    path, size = f"{root}/raw-{uuid.uuid4().hex}.warc.gz", 0
                    out, engine = system.open_output_stream(path, compression=None), zlib.compressobj(6, zlib.DEFLATED, 31)
                digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                # a response is named by page and payload, so that revisits can name it; a revisit by its place
                name = f"page:{page}:{digest}" if first is None else f"{path}:{size}"
                headers = {
                    "WARC-Type": "response" if first is None else "revisit",
                    "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>",
                    "WARC-Date": date,
                    "Content-Type": "text/html; charset=utf-8",
                    "WARC-Target-URI": "".join((url or "").split()),
                    "WARC-Payload-Digest": f"sha1:{digest}",
                    "X-Payload-Length": str(len(payload)),
                    "X-Page-Id": "" if page is None else str(page),
                }
                if first is not None:
                    headers["WARC-Profile"] = REVISIT
                    headers["WARC-Refers-To"] = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{first}:{digest}')}>"
                    headers["X-Refers-To-Page-Id"] = str(first)
                data = record(headers, payload if first is None else b"")
                out.write(engine.compress(data))
                size += len(data)
                if size >= archive_bytes:
                    out.write(engine.flush())
                    out.close()
                    out = None
                    paths.append(path)
        if out is not None:
            out.write(engine.flush())
            out.close()
            paths.append(path)
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string())], names=["path"])

    return stored(pages.mapInArrow(run, "path string"), "warc-archives")


def normalised(archives: DataFrame, folder: str) -> DataFrame:
    """Rewrite every record of every archive as a gzip member of its own, with a sidecar of offsets.

    The sidecar (``.idx`` beside the archive) has path, offset and length as JSON lines. Returns what the sidecars of
    committed archives say; those that lost tasks left behind are not among them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = store(folder)
        for batch in batches:
            for source in batch.column(0).to_pylist():
                target = f"{root}/norm-{uuid.uuid4().hex}.warc.gz"
                offsets, lengths, at = [], [], 0
                with system.open_input_stream(source, compression=None) as raw, system.open_output_stream(target, compression=None) as out:
                    for data in records(inflated(raw)):
                        member = gzip.compress(data, 6, mtime=0)
                        out.write(member)
                        offsets.append(at)
                        lengths.append(len(member))
                        at += len(member)
                with system.open_output_stream(f"{target}.idx", compression=None) as side:
                    for offset, length in zip(offsets, lengths, strict=True):
                        side.write(json.dumps({"path": target, "offset": offset, "length": length}).encode() + b"\n")
                yield pa.RecordBatch.from_arrays([pa.array([target], pa.string()), pa.array([len(offsets)], pa.int64())], names=["path", "records"])

    width = max(1, archives.count())
    done = stored(archives.repartition(width).mapInArrow(run, "path string, records long"), "warc-normalised")
    sidecars = archives.sparkSession.read.schema("path string, offset long, length long").option("mode", "FAILFAST").option("pathGlobFilter", "*.idx").json(folder)
    return sidecars.join(done.select("path"), "path", "left_semi")


def read_back(index: DataFrame, folder: str) -> DataFrame:
    """One row per record of the index, each member read and inflated by itself.

    Digests and lengths of full payloads are verified. A revisit has the length of the response that it names, which
    must exist and have its digest.
    """
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = store(folder)
        opened, file = None, None
        for batch in batches:
            rows = []
            for path, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if path != opened:
                    if file is not None:
                        file.close()
                    opened, file = path, system.open_input_file(path)
                file.seek(offset)
                headers, body = parsed(gzip.decompress(file.read(length)))
                digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                full = headers["WARC-Type"] == "response"
                if full and (base64.b32encode(hashlib.sha1(body).digest()).decode() != digest or len(body) != int(headers["X-Payload-Length"])):
                    raise ValueError(f"{path}: the record at {offset} does not match its digest or length")
                page, first = headers["X-Page-Id"], headers.get("X-Refers-To-Page-Id")
                rows.append((int(page) if page else None, len(body) if full else None, digest, headers["WARC-Type"], int(first) if first else None, headers["WARC-Target-URI"]))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
            arrays = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(arrays, names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"])

    rows = stored(index.select("path", "offset", "length").mapInArrow(run, schema), "warc-records")
    known = rows.where("record_type = 'response'").select(F.col("page_id").alias("refers_to"), "payload_digest", F.col("payload_bytes").alias("_bytes")).distinct()
    revisits = rows.where("record_type <> 'response'").join(known, ["refers_to", "payload_digest"], "left")
    lost = F.raise_error(F.concat(F.lit("no response of this payload for the revisit of page "), F.col("page_id").cast("string"))).cast("bigint")
    revisits = revisits.withColumn("payload_bytes", F.coalesce("_bytes", lost)).select(*rows.columns)
    return rows.where("record_type = 'response'").unionByName(revisits)


def archive(pages: DataFrame, least_bytes: int = 0, archive_bytes: int = 16 << 20, date: str | None = None) -> DataFrame:
    """Write ``pages`` (page_id, url, html) to WARC files in shared storage, normalise them and read them back.

    Of records with equal payloads of ``least_bytes`` or more, those of the smallest page_id are responses (all
    rows of that id, if it repeats), the others revisits without a body. Null html is an empty payload; a null
    page_id is never the smallest, and if no other has the payload the record is a response; a null url is
    empty. ``date`` (now, if not given) is the WARC-Date of all records. Rows that repeat a page_id and its payload
    share a record id. A record is held whole in memory, an archive never. Extra columns are left out.
    """
    folder = f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    made_dir(pages.sparkSession, folder)
    date = date or datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    chosen = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    archives = written(with_first(chosen, least_bytes), folder, archive_bytes, date)
    return read_back(normalised(archives, folder), folder)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
h AS (SELECT page_id, body, sha1(body) AS hex, min(page_id) OVER (PARTITION BY body) AS first_id FROM p)
SELECT page_id, octet_length(encode(body))::BIGINT AS payload_bytes,
       list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           1 + (((('0x' || substr(hex, (i + i // 4 + 1)::INT, 2))::INT >> (3 - i % 4)::INT) & 31)), 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM h
"""
