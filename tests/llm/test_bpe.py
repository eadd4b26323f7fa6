"""Byte-level BPE against the library and as a round trip."""

import base64
import hashlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import types as T

from trailmix.llm import byte_bpe

PATH = P.path("byte_bpe_50k.tiktoken")
TEXTS = ["Hello  there, it's 12 o'clock\n\n ok", "", None, "a", "<|endoftext|>", "x" * 3000, "ab" * 500, "é𝔘ñ 　z", "tie tie tie", "tie tie tie", "word " * 20_000]


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def want(library, text):
    ids = np.array(library.encode_ordinary(text or ""), "<u4")
    return len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


@pytest.mark.parametrize("most", [0, 300_000])
def test_ids_equal_the_library(spark, library, most):
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("ids", T.StringType())])
    docs = spark.createDataFrame([(None if i == 3 else i, t, "x") for i, t in enumerate(TEXTS)], schema)
    got = byte_bpe.decode_digests(byte_bpe.encode(docs, PATH, P.PATTERN, most=most, block_chars=500), PATH).collect()
    assert sorted((r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == sorted(want(library, t) for t in TEXTS)
    assert byte_bpe.encode(docs.where("doc_id > 99"), PATH, P.PATTERN).count() == 0


def test_documents(spark, library):
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    got = byte_bpe.query(spark, "/root/testdata/sf0.001").collect()
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got} == {i: want(library, t) for i, t in docs.items()}


def test_decoding_gives_the_bytes_back(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, decoded string")
    encoded = byte_bpe.encode(docs, PATH, P.PATTERN, block_chars=500)
    got = {r.doc_id: bytes(r.decoded).decode() for r in byte_bpe.decode(encoded, PATH).collect()}
    assert got == {i: t or "" for i, t in enumerate(TEXTS)}
    odd = spark.createDataFrame([(1, None, "a"), (2, [], "b"), (3, [220], "c")], "doc_id long, ids array<int>, note string")
    assert [(r.doc_id, r.note, r.decoded) for r in byte_bpe.decode(odd, PATH).orderBy("doc_id").collect()] == [(1, "a", None), (2, "b", b""), (3, "c", b" ")]
    for wrong in (-1, 50_256, 1 << 30):
        with pytest.raises(Exception, match="not in the vocabulary"):
            byte_bpe.decode(spark.createDataFrame([(1, [wrong])], "doc_id long, ids array<int>"), PATH).collect()
